"""Conversions between units, and loudness weighting curves, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The break and slopes of the piecewise mel scale.
LINEAR_STEP, BREAK_HZ, BREAK_MEL, LOG_STEP = 200.0 / 3.0, 1000.0, 15.0, math.log(6.4) / 27.0
# Pole frequencies of the weighting curves, in Hz.
POLE_1, POLE_2, POLE_3, POLE_4 = 20.598997, 107.65265, 737.86223, 12194.217
NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def hz_to_mel(f: Column, htk: bool = False) -> Column:
    f = _d(f)
    if htk:
        return 2595.0 * F.log10(1.0 + f / 700.0)
    return F.when(f < BREAK_HZ, f / LINEAR_STEP).otherwise(BREAK_MEL + F.log(F.greatest(f, F.lit(1e-10)) / BREAK_HZ) / LOG_STEP)


def mel_to_hz(m: Column, htk: bool = False) -> Column:
    m = _d(m)
    if htk:
        return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)
    return F.when(m < BREAK_MEL, m * LINEAR_STEP).otherwise(BREAK_HZ * F.exp(LOG_STEP * (m - BREAK_MEL)))


def hz_to_mel_kaldi(f: Column) -> Column:
    return 1127.0 * F.log(1.0 + _d(f) / 700.0)


def mel_to_hz_kaldi(m: Column) -> Column:
    return 700.0 * (F.exp(_d(m) / 1127.0) - 1.0)


def power_to_db(s: Column, ref: float = 1.0, amin: float = 1e-10) -> Column:
    """Without a floor relative to the peak; see ``operators.spectral.top_db`` for that."""
    return 10.0 * F.log10(F.greatest(_d(s), F.lit(amin))) - 10.0 * math.log10(max(ref, amin))


def amplitude_to_db(s: Column, ref: float = 1.0, amin: float = 1e-5) -> Column:
    return 20.0 * F.log10(F.greatest(_d(s), F.lit(amin))) - 20.0 * math.log10(max(ref, amin))


def db_to_power(db: Column, ref: float = 1.0) -> Column:
    return ref * F.pow(F.lit(10.0), _d(db) / 10.0)


def db_to_amplitude(db: Column, ref: float = 1.0) -> Column:
    return ref * F.pow(F.lit(10.0), _d(db) / 20.0)


def times_to_frames(t: Column, sr: float, hop: int) -> Column:
    return (_d(t) * sr / hop).cast("long")


def frames_to_times(t: Column, sr: float, hop: int) -> Column:
    return _d(t) * hop / sr


def samples_to_frames(n: Column, hop: int) -> Column:
    return (_d(n) / hop).cast("long")


def frames_to_samples(t: Column, hop: int) -> Column:
    return t.cast("long") * hop


def hz_to_midi(f: Column) -> Column:
    return F.when(_d(f) > 0, 69.0 + 12.0 * F.log2(_d(f) / 440.0)).otherwise(0.0)


def midi_to_hz(m: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (_d(m) - 69.0) / 12.0)


def pitch_class_name(c: Column) -> Column:
    return F.when((c >= 0) & (c < 12), F.element_at(F.array(*map(F.lit, NAMES)), c.cast("int") + 1)).otherwise("?")


def hz_to_note(f: Column) -> Column:
    """Such as A4; "-" where there is no pitch. Negative numbers wrap to the class below."""
    m = F.round(hz_to_midi(f)).cast("int")
    return F.when(_d(f) > 0, F.concat(pitch_class_name(F.pmod(m, F.lit(12))), (F.floor(m / 12.0) - 1).cast("string"))).otherwise("-")


def note_to_hz(name: Column) -> Column:
    """Sharps and flats, octave 4 where none is given; what isn't a note is C1, 32.70 Hz."""
    step = F.lit(None).cast("int")
    for k, n in enumerate(NAMES):
        step = F.when(F.regexp_extract(F.upper(name), r"^\s*([A-G]#?)", 1) == n, k).otherwise(step)
    flat = F.when(F.regexp_extract(name, r"^\s*[A-Ga-g](b)", 1) == "b", 1).otherwise(0)
    digits = F.regexp_extract(name, r"(-?[0-9]+)\s*$", 1)
    octave = F.when(digits == "", 4).otherwise(digits.cast("int"))
    return F.when(step.isNull(), 32.70).otherwise(midi_to_hz(step - flat + 12 * (octave + 1)))


def erb(f: Column) -> Column:
    return 24.7 * (4.37 * _d(f) / 1000.0 + 1.0)


def gamma_for_erb(f: Column, bins_per_octave: int = 12) -> Column:
    q = bins_per_octave / (2 ** (1 / bins_per_octave) - 1)
    return F.greatest(F.lit(0.0), erb(f) - _d(f) / q)


def bin_to_hz(k: Column, f_min: float, bins_per_octave: int = 12) -> Column:
    return f_min * F.pow(F.lit(2.0), _d(k) / bins_per_octave)


def hz_to_bin(f: Column, f_min: float, n_bins: int, bins_per_octave: int = 12) -> Column:
    """Nearest bin, held inside the range."""
    return F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.round(bins_per_octave * F.log2(_d(f) / f_min)).cast("int")))


def bpm_to_frames(bpm: Column, frames_per_second: float) -> Column:
    return 60.0 * frames_per_second / _d(bpm)


frames_to_bpm = bpm_to_frames


def weighting(f: Column, curve: str = "a") -> Column:
    """dB of a curve at a frequency: a, b, c, d, itu468 or z; minus infinity at 0 Hz and below (z: 0 throughout)."""
    f = _d(f)
    q = f * f
    one, four = q + POLE_1**2, q + POLE_4**2
    if curve == "a":
        out = 20.0 * F.log10(POLE_4**2 * q * q / (one * F.sqrt((q + POLE_2**2) * (q + POLE_3**2)) * four)) + 1.9997
    elif curve == "b":
        out = 20.0 * F.log10(POLE_4**2 * q * f / (one * F.sqrt(q + POLE_2**2) * four)) + 0.17
    elif curve == "c":
        out = 20.0 * F.log10(POLE_4**2 * q / (one * four)) + 0.0619
    elif curve == "d":
        h = ((1037918.48 - q) * (1037918.48 - q) + 1080768.16 * q) / ((9837328.0 - q) * (9837328.0 - q) + 11723776.0 * q)
        out = 20.0 * F.log10(F.sqrt(q / ((q + 79919.29) * (q + 1345600.0)) * h) * 1000.0)
    elif curve == "itu468":
        # Coefficients of the approximation.
        even = -4.737338981378384e-24 * q * q * q + 2.043828333606125e-15 * q * q - 1.363894795463638e-7 * q + 1.0
        odd = 1.306612257412824e-19 * q * q * f - 2.118150887518656e-11 * q * f + 5.559488023498642e-4 * f
        out = 20.0 * F.log10(1.246332637532143e-4 * f / F.sqrt(even * even + odd * odd)) + 18.2
    elif curve == "z":
        return f * 0.0
    else:
        raise ValueError(f"no curve {curve!r}")
    return F.when(f > 0, out).otherwise(F.lit(float("-inf")))
