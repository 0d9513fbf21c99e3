"""Exact top-k search by inner product with a three-phase uniform threshold.

A score is the sum of partial scores over `lists` groups of dimensions. Queries
and rows meet in blocks, a bounded number of queries with a stream of rows.

1. Each block gives the heads of its local score lists (the k best partial scores of
   each group); full scores are made of these heads alone. The k-th best of a query's full
   scores is a safe cutoff: at least k candidates reach it.
2. The cutoff goes out with the queries. Rows whose length can't reach any query's cutoff
   have no products at all. A candidate of a full score of the cutoff or more must have one
   partial score of cutoff / lists or more, so each block collects those entries alone.
3. The full scores of the collected entries are resolved exactly; each block returns its k
   best that reach the cutoff, and the k best of these are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.blocks import best, keyed_slices, matrix, met, usable
from tallyward.llm.common import col, stored

QUERY_BLOCK, ROW_BLOCK, LISTS = 2048, 4096, 4
#: Products of one list that a task holds at once.
HELD = 1 << 21
#: Whole numbers below this are exact as doubles; larger products are summed as Python's.
EXACT, LONG = 2.0**53, 2**63 - 1


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * v)


def _partials(q: np.ndarray, r: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores of queries by rows for each group of dimensions."""
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    if q.size and r.size and np.abs(q).max() * np.abs(r).max() * q.shape[1] >= EXACT:
        q, r = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, r))
    return [q[:, a:b] @ r[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def entries(partial: list[np.ndarray], cutoff: float | None) -> np.ndarray:
    """Positions of the candidates that must be resolved: those with a partial score of cutoff / lists or more."""
    if cutoff is None:
        return np.arange(len(partial[0]))
    return np.flatnonzero(np.logical_or.reduce([p * len(partial) >= cutoff for p in partial]))


def long_enough(queries: np.ndarray, cutoffs: list[float | None], rows: np.ndarray) -> np.ndarray:
    """Positions of the rows whose length times a query's reaches that query's cutoff."""
    if any(c is None or c <= 0 for c in cutoffs):
        return np.arange(len(rows))
    lengths = np.maximum(np.linalg.norm(queries, axis=1), 1e-300)
    return np.flatnonzero(np.linalg.norm(rows, axis=1) * (1 + 1e-9) >= (np.array(cutoffs, float) / lengths).min())


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: float = 256.0, lists: int = LISTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x), ties to the smaller id.

    Queries are the rows whose id is divisible by `every`. Candidates are all rows but the query's own; with fewer than k,
    all are returned. Null vectors, vectors with null or non-finite components and null ids take no part. Rows that share an
    id are rows of their own: each is a candidate of the others, and each gives ranks from 1 if it is a query. Vectors of
    unequal length are filled with zeros. Scores beyond 64 bits end at its limits. No query or no row gives no result. Other columns are not read.
    """
    rows = stored(usable(vectors, id_col=id_col, vec_col=vec_col, not_zero=False), "vectors")
    queries = rows.filter(F.col("id") % every == 0)
    n, nq = rows.count(), queries.count()
    nb, qb = max(1, -(-n // ROW_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    block = lambda b, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(b))
    rows_in = rows.withColumn("b", block(nb, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).select((F.col("q") * nb + F.col("b")).cast("long").alias("key"), "uid", "id", "v")

    def meet(queries: DataFrame, run, schema: str) -> DataFrame:
        dealt = queries.withColumn("q", block(qb, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("key", (F.col("q") * nb + F.col("b")).cast("long")).drop("q", "b")
        return met(dealt, rows_in, min(nb * qb, 20_000)).mapInArrow(run, schema)

    def blocks(batches: Iterator[pa.RecordBatch]):
        """(queries' uids, ids and cutoffs, rows' uids and ids, partial scores) of each piece of a block."""
        key, parts, held = None, [], None
        for at, side, batch in keyed_slices(batches):
            if at != key:
                key, parts, held = at, [], None
            if side == 0:
                parts.append(batch)
                held = None
                continue
            if not parts:
                continue
            if held is None:
                uids, ids = (np.concatenate([col(p, c).to_numpy() for p in parts]) for c in ("uid", "id"))
                cut = [c for p in parts for c in col(p, "cutoff").to_pylist()] if "cutoff" in parts[0].schema.names else [None] * len(ids)
                held = whole(matrix([b for p in parts for b in col(p, "v").to_pylist()]), scale)
            step = max(1, HELD // len(ids))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                r = whole(matrix(col(part, "v").to_pylist(), held.shape[1]), scale)
                far = long_enough(held, cut, r)
                if len(far):
                    yield uids, ids, cut, col(part, "uid").to_numpy()[far], col(part, "id").to_numpy()[far], _partials(held, r[far], lists)

    def emit(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        score = [max(-LONG - 1, min(LONG, int(s))) for *_, scores in found for s in scores]
        times = [len(v) for _, _, v, _ in found]
        out = [np.repeat([x[0] for x in found], times), np.repeat([x[1] for x in found], times), np.concatenate([v for _, _, v, _ in found] or [np.zeros(0)])]
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in out), pa.array(score, pa.int64())], ["query_uid", "query_id", "vec_id", "score"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, ids, _, other_uids, others, partial in blocks(batches):
            found = []
            most = min(k + 1, len(others))  # one more, as the query's own row may be among them
            tops = [np.argpartition(-p, most - 1, axis=1)[:, :most] for p in partial]
            for i, uid in enumerate(uids):
                at = np.unique(np.concatenate([t[i] for t in tops]))
                at = at[other_uids[at] != uid]
                full = sum(p[i, at] for p in partial)
                keep = best(-full, others[at], k)
                found.append((uid, ids[i], others[at[keep]], full[keep]))
            yield emit(found)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, ids, cut, other_uids, others, partial in blocks(batches):
            found = []
            for i, uid in enumerate(uids):
                mine = [p[i] for p in partial]
                at = entries(mine, cut[i])
                at = at[other_uids[at] != uid]
                full = sum(m[at] for m in mine)
                if cut[i] is not None:
                    at, full = at[full >= cut[i]], full[full >= cut[i]]
                keep = best(-full, others[at], k)
                found.append((uid, ids[i], others[at[keep]], full[keep]))
            yield emit(found)

    schema = "query_uid long, query_id long, vec_id long, score long"
    w = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = meet(queries, heads, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    # a score at a 64-bit limit is no cutoff: the true score may differ
    cutoffs = ranked.filter((F.col("rank") == k) & F.col("score").between(-LONG, LONG - 1)).select(F.col("query_uid").alias("uid"), F.col("score").alias("cutoff"))
    armed = stored(queries.join(stored(cutoffs, "cutoffs"), "uid", "left"), "armed")
    found = meet(armed, collect, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
