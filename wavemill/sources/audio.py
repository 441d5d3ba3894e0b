"""Audio files, raw samples and reports.

Audio is read by a Python data source that plans byte ranges from a listing alone: a task reads the header of its file and then the
sample frames that begin in its range, so a file of any size is many tasks' work and a query for headers reads nothing else.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEAD = "path string, sr int, n_channels int, n_frames long"
AUDIO = HEAD + ", start long, channels array<array<double>>"
#: Bytes of a range that one task reads, and sample frames of a row.
RANGE, CHUNK = 64 << 20, 1 << 19


@dataclass(frozen=True)
class Header:
    """Where a file's sample frames are and how they are written; kind is a numpy type, i3 for three-byte integers."""

    sr: int
    n_channels: int
    order: str
    kind: str
    at: int
    n_frames: int

    @property
    def frame_bytes(self) -> int:
        return self.n_channels * int(self.kind[1:])

    def decoded(self, raw: bytes) -> np.ndarray:
        """(channels, frames) of whole frames, integers over their largest value."""
        if self.kind == "i3":
            b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
            if self.order == ">":
                b = b[:, ::-1]
            v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
            x = np.where(v >= 1 << 23, v - (1 << 24), v) / 8388607
        else:
            v = np.frombuffer(raw, dtype=self.order + self.kind)
            x = v.astype(float)
            if self.kind == "u1":
                x = (x - 128) / 127
            elif self.kind[0] == "i":
                x = x / np.iinfo(v.dtype).max
        return x.reshape(-1, self.n_channels).T


def _kind(bits: int, is_float: bool, unsigned_bytes: bool = False) -> str:
    width = (bits + 7) // 8
    if bits % 8 or width not in ((4, 8) if is_float else (1, 2, 3, 4)):
        raise ValueError(f"no samples of {bits} bits")
    return f"{'f' if is_float else 'u' if unsigned_bytes and width == 1 else 'i'}{width}"


def header(read: Callable[[int, int], bytes], size: int) -> Header:
    """The header of a WAV (RIFF and RF64), AIFF, AIFF-C (uncompressed) or CAF (linear PCM) file; ``read`` gives some bytes from a place on."""
    try:
        return _header(read, size)
    except struct.error as e:
        raise ValueError("a header is cut off") from e


def _header(read: Callable[[int, int], bytes], size: int) -> Header:
    start = read(0, 12)
    if start[:4] == b"caff":
        at, found = 8, None
        while at + 12 <= size:
            name, length = struct.unpack(">4sq", read(at, 12))
            if name == b"desc":
                sr, code, flags, _, _, n, bits = struct.unpack(">d4sIIIII", read(at + 12, 32))
                if code != b"lpcm":
                    raise ValueError(f"no decoder for {code!r}")
                found = int(sr), n, "<" if flags & 2 else ">", _kind(bits, bool(flags & 1))
            if name == b"data" and found:
                body = (size - at - 12 if length < 0 else length) - 4
                return Header(*found, at + 16, body // (found[1] * int(found[3][1:])))
            if length < 0:
                break
            at += 12 + length
    elif start[:4] == b"FORM" and start[8:12] in (b"AIFF", b"AIFC"):
        at, found, body = 12, None, None
        while at + 8 <= size and (found is None or body is None):
            name, length = struct.unpack(">4sI", read(at, 8))
            if name == b"COMM":
                part = read(at + 8, min(length, 22))
                n, frames, bits = struct.unpack(">hIh", part[:8])
                exponent, mantissa = struct.unpack(">HQ", part[8:18])
                code = part[18:22] if start[8:12] == b"AIFC" else b"NONE"
                if code not in (b"NONE", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64"):
                    raise ValueError(f"no decoder for {code!r}")
                found = int(mantissa * 2.0 ** (exponent - 16383 - 63)), n, "<" if code == b"sowt" else ">", _kind(bits, code.lower()[:2] == b"fl"), frames
            elif name == b"SSND":
                body = at + 16 + struct.unpack(">I", read(at + 8, 4))[0]
            at += 8 + length + length % 2
        if found and body is not None:
            return Header(*found[:4], body, found[4])
    elif start[:4] in (b"RIFF", b"RF64") and start[8:12] == b"WAVE":
        at, found, long_size = 12, None, None
        while at + 8 <= size:
            name, length = struct.unpack("<4sI", read(at, 8))
            if name == b"ds64":
                long_size = struct.unpack("<QQ", read(at + 8, 16))[1]
            if name == b"fmt ":
                part = read(at + 8, min(length, 26))
                code, n, sr, _, _, bits = struct.unpack("<HHIIHH", part[:16])
                if code == 0xFFFE and len(part) >= 26:  # the true code follows
                    code = struct.unpack("<H", part[24:26])[0]
                if code not in (1, 3):
                    raise ValueError(f"no decoder for code {code}")
                found = sr, n, "<", _kind(bits, code == 3, True)
            if name == b"data" and found:
                body = long_size if length == 0xFFFFFFFF and long_size is not None else length
                return Header(*found, at + 8, min(body, size - at - 8) // (found[1] * int(found[3][1:])))
            at += 8 + length + length % 2
    raise ValueError("not a WAV, AIFF or CAF file of uncompressed samples")


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and (channels, frames) of a whole file in memory."""
    h = header(lambda at, n: data[at : at + n], len(data))
    return h.sr, h.decoded(data[h.at : h.at + h.n_frames * h.frame_bytes])


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, size of the file, from, to) of one task."""

    parts: list[tuple[str, int, int, int]]


class AudioReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.samples = options["path"], "channels" in schema.fieldNames()
        self.range, self.chunk = int(options.get("range", RANGE)), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Ranges]:
        """From names and sizes only: large files are cut, small ones put together."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out, held, size = [], [], 0
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            step = self.range if self.samples else max(f.size, 1)
            for at in range(0, max(f.size, 1), step):
                # Without samples a file counts as its header.
                load = min(step, f.size - at) if self.samples else 4096
                if held and size + load > self.range:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((f.path, f.size, at, min(f.size, at + step)))
                size += load
        return [*out, Ranges(held)] if held else [*out, Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.float64()))]
        names = ["path", "sr", "n_channels", "n_frames", "start", "channels"]
        for path, size, low, high in partition.parts:
            with store.open_input_file(path) as file:
                def some(at: int, n: int, file=file) -> bytes:
                    file.seek(at)
                    return file.read(n)

                h = header(some, size)
                row = [path, h.sr, h.n_channels, h.n_frames]
                if not self.samples:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds[:4], strict=True)], names=names[:4])
                    continue
                # Frames that begin in the range; the header's bytes belong to the first one.
                first, last = (0 if low == 0 else min(h.n_frames, max(0, -(-(low - h.at) // h.frame_bytes)))), min(h.n_frames, max(0, -(-(high - h.at) // h.frame_bytes)))
                for start in range(first, last, self.chunk) if h.n_frames else range(0, 1 if low == 0 else 0):
                    n = min(last, start + self.chunk) - start if h.n_frames else 0
                    y = h.decoded(some(h.at + start * h.frame_bytes, n * h.frame_bytes))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y).ravel()))
                    cell = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip([*row, start], kinds[:5], strict=True)), cell], names=names)


class AudioSource(DataSource):
    """Files of uncompressed audio under a path; options range (bytes a task) and chunk (sample frames a row)."""

    @classmethod
    def name(cls) -> str:
        return "wavemill_audio"

    def schema(self) -> str:
        return AUDIO if self.options.get("samples", "true") == "true" else HEAD

    def reader(self, schema: StructType) -> DataSourceReader:
        return AudioReader(schema, dict(self.options))


def read_audio(spark: SparkSession, path: str, samples: bool = True, range_bytes: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    """(path, sr, n_channels, n_frames, start, channels) of every file under a path: the sample frames from ``start`` on, ``chunk`` a row at most.

    Without ``samples`` the first four columns, a row a file, from the headers alone. An empty file has one row of empty channels. Paths are those that
    pyarrow's file systems know (local and shared folders, object stores, HDFS).
    """
    spark.dataSource.register(AudioSource)
    reader = spark.read.format("wavemill_audio").option("samples", str(samples).lower()).option("range", range_bytes).option("chunk", chunk)
    return reader.load(path)


def tall_audio(rows: DataFrame, clip_id: str = "path") -> DataFrame:
    """(clip_id, channel, n, x) from rows of ``read_audio``."""
    each = rows.select(F.col(clip_id).alias("clip_id"), "start", F.posexplode("channels").alias("channel", "y"))
    return each.select("clip_id", "channel", "start", F.posexplode("y").alias("i", "x")).select("clip_id", "channel", (F.col("start") + F.col("i")).alias("n"), "x")


def encode(y: np.ndarray, sr: int, kind: str = "wav") -> bytes:
    """WAV (16-bit little-endian), AIFF (16-bit big-endian) or CAF (32-bit float) of (channels, frames); integers are cut off at one."""
    if kind == "caf":
        x = np.atleast_2d(y).T.astype("<f4")
        desc = struct.pack(">d4sIIIII", float(sr), b"lpcm", 3, 4 * x.shape[1], 1, x.shape[1], 32)
        return b"caff" + struct.pack(">HH", 1, 0) + struct.pack(">4sq", b"desc", 32) + desc + struct.pack(">4sqI", b"data", 4 + x.nbytes, 0) + x.tobytes()
    codes = np.trunc(np.clip(np.atleast_2d(y), -1, 1) * 32767).astype(np.int16).T
    if kind == "wav":
        out = io.BytesIO()
        with wave.open(out, "wb") as file:
            file.setnchannels(codes.shape[1])
            file.setsampwidth(2)
            file.setframerate(sr)
            file.writeframes(codes.astype("<i2").tobytes())
        return out.getvalue()
    exponent = max(0, sr.bit_length() - 1)
    rate = struct.pack(">HQ", 16383 + exponent, sr << (63 - exponent))
    common = struct.pack(">hIh", codes.shape[1], len(codes), 16) + rate
    sound = struct.pack(">II", 0, 0) + codes.astype(">i2").tobytes()
    chunks = b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">I", len(sound)) + sound + b"\0" * (len(sound) % 2)
    return b"FORM" + struct.pack(">I", 4 + len(chunks)) + b"AIFF" + chunks


def with_encoded(rows: DataFrame, kind: str = "wav", channels: str = "channels", sr: str = "sr") -> DataFrame:
    """``rows`` with the file's bytes in ``content``, for a sink of whole files. Channels must be of one length."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", content binary"
    at = {n: k for k, n in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(np.array(c, dtype=float), int(r), kind) for c, r in zip(batch.column(at[channels]).to_pylist(), batch.column(at[sr]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "content"])

    return rows.mapInArrow(run, schema)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file a row in a folder that all executors share. A repeated task writes the same files again."""
    def run(part) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in part:
            with store.open_output_stream(f"{base}/{row[name]}") as out:
                out.write(bytes(row[content]))

    rows.select(name, content).foreachPartition(run)


def read_raw(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(path, y) of files of 32-bit little-endian floats; a file of another than the expected count is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [np.frombuffer(d[: len(d) // 4 * 4], dtype="<f4").astype(float) for d in batch.column(1).to_pylist()]
            if expected is not None and any(len(y) != expected for y in ys):
                raise ValueError(f"a file doesn't hold {expected} samples")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([y.tolist() for y in ys], pa.list_(pa.float64()))], names=["path", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, y array<double>")


def with_raw(rows: DataFrame, y: str = "y", bits: int = 32) -> DataFrame:
    """``rows`` with y as little-endian floats of 32 or 64 ``bits`` in ``content``."""
    at = rows.columns.index(y)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array(v, dtype=f"<f{bits // 8}").tobytes() for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "content"])

    return rows.mapInArrow(run, schema)


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """json or csv files of a report's rows."""
    {"json": lambda w: w.json(path), "csv": lambda w: w.option("header", True).csv(path)}[kind](rows.write.mode("overwrite"))


def markdown(rows: DataFrame) -> DataFrame:
    """(line): a report's rows as lines of a Markdown table, after its two head lines."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns)), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([("| " + " | ".join(rows.columns) + " |",), ("|" + "---|" * len(rows.columns),)], "line string")
    return head.unionByName(rows.select(cells.alias("line")))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline as written by ``write_report`` in json."""
    return spark.read.json(path)


