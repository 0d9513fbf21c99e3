"""Vectors in tasks: reading them from Arrow, and streams of (query block, row block) that share a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import col


def usable(vectors: DataFrame, *, id_col: str, vec_col: str, not_zero: bool) -> DataFrame:
    """(uid, id, values as little-endian doubles) of the vectors without null or non-finite components, not null and, if asked, not zero.

    Null ids take no part. Every other row does: uid tells apart those that share an id. It is drawn as the rows are read,
    so the result must be stored before it is used twice. Empty vectors are zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, out = [], []
            for i, x in zip(col(batch, "id").to_pylist(), col(batch, "v"), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(v).all() and (v.any() or not not_zero):
                    ids.append(i)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(ids))), pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["uid", "id", "v"])
            uid += len(ids)

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, "uid long, id long, v binary")


def matrix(blobs: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros, longer ones than width are cut (their products there are 0)."""
    width = max((len(b) // 8 for b in blobs), default=0) if width is None else width
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), width)
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, "<f8")[:width]
        out[i, : len(v)] = v
    return out


def keyed_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(key, side, rows) of batches sorted by key and side; a long run comes in several slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side = col(batch, "key").to_numpy(), col(batch, "side").to_numpy()
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield int(key[a]), int(side[a]), batch.slice(a, b - a)


def met(first: DataFrame, second: DataFrame, partitions: int) -> DataFrame:
    """Both sides (key, uid and like columns) dealt by key, the first side of a key before the second."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition(partitions, "key").sortWithinPartitions("key", "side", "uid")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to smaller ids, in order."""
    if len(score) > 4 * k:
        cut = np.partition(score, k - 1)[k - 1]
        at = np.flatnonzero(score <= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], score[at]))][:k]
