"""Readers and writers of audio files, raw samples and reports."""
