"""Image features as columns, and the fused vectors of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bracketry.functions import images
from bracketry.operators.graph import stored

#: Shares of the two descriptors in the similarity of frames, and the most components of the embedding.
EDGE_SHARE, COMPONENTS = 0.65, 128
#: Rows of the matrix of products that are added up together.
ROWS = 64


def mapped(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """frame_id and an array made of each (square) tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [np.asarray(fn(square(t)), float).ravel() for t in part.column("tile").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("frame_id"), pa.array(got, pa.list_(pa.float64()))], names=["frame_id", name])

    return frames.select("frame_id", F.col("tile").cast("array<double>").alias("tile")).mapInArrow(run, f"frame_id long, {name} array<double>")


def square(tile: list[float]) -> np.ndarray:
    side = int(round(len(tile) ** 0.5))
    return np.asarray(tile, float).reshape(side, side)


def edge_descriptors(frames: DataFrame, side: int = 64) -> DataFrame:
    return mapped(frames, lambda t: images.edge_descriptor(t, side), "edges")


def wavelet_embeddings(frames: DataFrame, side: int = 128, cell: int = 16, components: int = COMPONENTS) -> DataFrame:
    """frame_id, wave: whitened principal components of the wavelet features but the first, of length 1."""
    return whitened(stored(mapped(frames, lambda t: images.wavelet_features(t, side, cell=cell), "x")), 9 * cell * cell, components)


def pixel_embeddings(frames: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """wavelet_embeddings of the pixels themselves, for tiles too small for wavelets."""
    size = frames.select(F.size("tile")).first()
    return whitened(stored(mapped(frames, lambda t: t, "x")), size[0] if size else 1, components)


def whitened(rows: DataFrame, dim: int, components: int) -> DataFrame:
    """frame_id, wave of rows (frame_id, x). Sums and products are added up by task; the driver holds one matrix of features
    by features, whatever the number of frames."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        for k in range(0, dim, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([q[k : k + ROWS].tobytes()], pa.binary())], names=["k", "n", "s", "q"])

    def added(t: pa.Table) -> pa.Table:
        s, q = (np.sum([np.frombuffer(x) for x in t.column(c).to_pylist()], axis=0).tobytes() for c in ("s", "q"))
        return pa.table({"k": pa.array([t.column("k")[0].as_py()]), "n": pa.array([sum(t.column("n").to_pylist())]), "s": pa.array([s], pa.binary()), "q": pa.array([q], pa.binary())})

    parts = rows.select("x").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    kind = "k long, n long, s binary, q binary"
    got = sorted(parts.mapInArrow(products, kind).groupBy("k").applyInArrow(added, kind).toArrow().to_pylist(), key=lambda r: r["k"])
    n = got[0]["n"] if got else 0
    mean = np.frombuffer(got[0]["s"]) / n if n else np.zeros(dim)
    square_ = np.concatenate([np.frombuffer(r["q"]) for r in got]).reshape(dim, dim) / n if n else None
    values, vectors = np.linalg.eigh(square_ - np.outer(mean, mean)) if n > 1 else (np.zeros(dim), np.eye(dim))
    keep = [k for k in np.argsort(-values, kind="stable")[: min(components, n)] if values[k] > 1e-10 * max(values.max(), 1e-300)]
    basis = vectors[:, keep] / np.sqrt(values[keep] * n / max(n - 1, 1)) if keep else np.zeros((dim, 1))
    basis = basis[:, 1:] if basis.shape[1] > 1 else basis
    sent = rows.sparkSession.sparkContext.broadcast((mean, basis))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, b = sent.value
        for batch in batches:
            x = (batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim) - m) @ b
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("frame_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["frame_id", "wave"])

    return rows.mapInArrow(project, "frame_id long, wave array<double>")


def fused_vectors(frames: DataFrame, side: int = 64) -> DataFrame:
    """vec_id, embedding: one vector a frame whose dot product is the weighted similarity of edges and wavelets."""
    a, b = (float(np.sqrt(x)) for x in (EDGE_SHARE, 1 - EDGE_SHARE))
    both = edge_descriptors(frames, side).join(wavelet_embeddings(frames), "frame_id")
    return both.select(F.col("frame_id").alias("vec_id"), F.concat(F.transform("edges", lambda x: x * a), F.transform("wave", lambda x: x * b)).alias("embedding"))
