"""Recurrent layers over sequences: one row a sequence, a batch of rows a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm_cell(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gates in, forget, cell, out; rows are sequences."""
    g = x @ w["ih"].T + h @ w["hh"].T + w["bih"] + w["bhh"]
    i, f, z, o = np.split(g, 4, axis=1)
    c = sigmoid(f) * c + sigmoid(i) * np.tanh(z)
    return sigmoid(o) * np.tanh(c), c


def gru_cell(x: np.ndarray, h: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Gates reset, update, new."""
    a, b = x @ w["ih"].T + w["bih"], h @ w["hh"].T + w["bhh"]
    (ar, az, an), (br, bz, bn) = np.split(a, 3, axis=1), np.split(b, 3, axis=1)
    r, z = sigmoid(ar + br), sigmoid(az + bz)
    return (1 - z) * np.tanh(an + r * bn) + z * h


def layer(x: np.ndarray, w: dict[str, np.ndarray], kind: str, reverse: bool = False) -> np.ndarray:
    """Outputs (sequences, steps, hidden) of one direction; reversed outputs stand at their forward places."""
    n, steps, _ = x.shape
    hidden = w["hh"].shape[1]
    h, c, out = np.zeros((n, hidden)), np.zeros((n, hidden)), np.zeros((n, steps, hidden))
    for t in reversed(range(steps)) if reverse else range(steps):
        if kind == "lstm":
            h, c = lstm_cell(x[:, t], h, c, w)
        else:
            h = gru_cell(x[:, t], h, w)
        out[:, t] = h
    return out


def run_layers(sequences: DataFrame, layers: list[list[dict[str, np.ndarray]]], kind: str = "lstm") -> DataFrame:
    """(seq_id, out) for rows (seq_id, x), x an array of frames. Each layer is a list of one or two directions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            outs: list[list] = [[] for _ in xs]
            for steps in sorted({len(x) for x in xs if x}):
                at = [k for k, x in enumerate(xs) if x and len(x) == steps]
                y = np.array([xs[k] for k in at], dtype=float)
                for directions in layers:
                    y = np.concatenate([layer(y, w, kind, reverse=d == 1) for d, w in enumerate(directions)], axis=2)
                for k, o in zip(at, y, strict=True):
                    outs[k] = o.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(outs, pa.list_(pa.list_(pa.float64())))], names=["seq_id", "out"])

    return sequences.select(F.col("seq_id").cast("long"), "x").mapInArrow(run, "seq_id long, out array<array<double>>")


def random_weights(kind: str, inputs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    gates = {"lstm": 4, "gru": 3}[kind]
    bound = 1 / np.sqrt(hidden)
    return {"ih": rng.uniform(-bound, bound, (gates * hidden, inputs)), "hh": rng.uniform(-bound, bound, (gates * hidden, hidden)), "bih": rng.uniform(-bound, bound, gates * hidden), "bhh": rng.uniform(-bound, bound, gates * hidden)}


def load_weights(spark: SparkSession, folder: str, layers: int, bidirectional: bool = False, bits: int = 32) -> list[list[dict[str, np.ndarray]]]:
    """Raw files of floats of 32 or 64 ``bits``, weight_ih_l0.bin, weight_hh_l0.bin, bias_ih_l0.bin, bias_hh_l0.bin and so on, from any store that Spark reads.

    They come to the driver, as the layers' parameters go to every task with the step itself.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*_l[0-9]*.bin").load(folder).select("path", "content").collect()
    files = {r["path"].rsplit("/", 1)[1]: np.frombuffer(bytes(r["content"]), dtype=f"<f{bits // 8}").astype(float) for r in rows}
    out = []
    for n in range(layers):
        directions = []
        for suffix in ["", "_reverse"] if bidirectional else [""]:
            raw = {k: files[f"{name}_l{n}{suffix}.bin"] for k, name in (("ih", "weight_ih"), ("hh", "weight_hh"), ("bih", "bias_ih"), ("bhh", "bias_hh"))}
            size = len(raw["bih"])
            directions.append(raw | {"ih": raw["ih"].reshape(size, -1), "hh": raw["hh"].reshape(size, -1)})
        out.append(directions)
    return out


def weight_files(spark: SparkSession, layers: list[list[dict[str, np.ndarray]]]) -> DataFrame:
    """(name, y): layers' parameters as ``load_weights`` reads them, for ``with_raw`` and ``write_files``."""
    rows = []
    for n, directions in enumerate(layers):
        for w, suffix in zip(directions, ("", "_reverse"), strict=False):
            rows += [(f"{name}_l{n}{suffix}.bin", np.asarray(w[k]).ravel().tolist()) for k, name in (("ih", "weight_ih"), ("hh", "weight_hh"), ("bih", "bias_ih"), ("bhh", "bias_hh"))]
    return spark.createDataFrame(rows, "name string, y array<double>")
