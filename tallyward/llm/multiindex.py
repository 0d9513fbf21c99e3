"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, each to the nearest of K
centroids, so K * K cells part the space finely with 2 * K centroids. A query
sorts both lists of centroid distances and walks the pairs in order of their
summed distance with a heap, until the cells met hold enough vectors; these are
reranked by exact distance. How many are enough is measured, at every size alike: for
PROBES vectors the exact neighbours among all rows are found in one pass, and the
number is that up to which TARGET of them are met.

Centroids are fitted on a bounded sample: SAMPLE vectors, those whose hashed row
number is smallest. Every vector is indexed. K follows the number of vectors, so that a
cell holds about PER_CELL of them, up to MOST_K. The driver holds centroids and a
count for each cell, K * K at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.blocks import best, keyed_slices, matrix, met, usable
from tallyward.llm.common import col, stored

SAMPLE, PER_CELL, MOST_K, ROUNDS = 20_000, 4, 1024, 12
#: The recall that the number of vectors met is chosen for, measured for so many vectors against all rows.
TARGET, PROBES = 0.95, 200
#: Vectors that a task holds at once, about; the vectors of one left centroid are split by hash beyond.
BLOCK = 4_096


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1))


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k centroids of the rows of x (fewer, if x has fewer rows); empty ones stay where they were."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _squared(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Index:
    width: int
    left: np.ndarray
    right: np.ndarray

    @property
    def k(self) -> int:
        return len(self.right)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.width // 2
        return _squared(x[:, :h], self.left), _squared(x[:, h : self.width], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1).astype(np.int64) * self.k + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> dict[int, int]:
        """How many of the right centroids, nearest first, are met with each left one, if pairs are met in order of summed distance until their cells hold the wanted number of vectors."""
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[oa].tolist(), b[ob].tolist()
        heap, next_in_row, held = [(sa[0] + sb[0], 0, 0)], [0] * len(sa), 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            held += int(counts[int(oa[i]) * self.k + int(ob[j])])
            # the neighbours whose other forerunner has been taken too
            next_in_row[i] = j + 1
            if j + 1 < len(sb) and (i == 0 or next_in_row[i - 1] > j + 1):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if i + 1 < len(sa) and next_in_row[i + 1] == j:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        return {int(oa[i]): n for i, n in enumerate(next_in_row) if n}


def sample(rows: DataFrame, n: int, most: int = SAMPLE) -> DataFrame:
    """About `most` of rows (uid, id, v), n in all."""
    draw = (F.xxhash64("uid", F.lit("multi-index")) % (1 << 30) + (1 << 30)) / float(1 << 31)
    return rows.filter(draw <= min(1.0, max(most, 100) / n))


def fit(x: np.ndarray, n: int) -> Index:
    """Centroids of the sample x for n vectors."""
    c = int(min(MOST_K, max(1, round(np.sqrt(n / PER_CELL)))))
    h = x.shape[1] // 2
    return Index(x.shape[1], k_means(x[:, :h], c), k_means(x[:, h:], c))


def exact_neighbours(rows: DataFrame, uids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """(probe, cell) of the k rows (uid, cell, v) nearest to each probe but its own, in one pass; ties as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                d = _squared(x, matrix(col(part, "v").to_pylist(), x.shape[1]))
                d[uids[:, None] == col(part, "uid").to_numpy()] = np.inf
                most = min(k, d.shape[1])
                best_at = np.argpartition(d, most - 1, axis=1)[:, :most]
                score, cell = np.take_along_axis(d, best_at, 1).ravel(), col(part, "cell").to_numpy()[best_at.ravel()]
                probe = np.repeat(np.arange(len(x)), most)
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(probe[ok]), pa.array(cell[ok]), pa.array(score[ok])], ["probe", "cell", "score"])

    w = Window.partitionBy("probe").orderBy("score")
    return rows.mapInArrow(run, "probe long, cell long, score double").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("probe", "cell")


def needed(index: Index, x: np.ndarray, near: list[tuple[int, int]], counts: np.ndarray, target: float = TARGET) -> int:
    """How many vectors the probes x must meet so that the target share of near (probe, cell of a neighbour) is among them."""
    met_at, (a, b) = [], index.halves(x)
    cells: dict[int, list[int]] = {}
    for probe, cell in near:
        cells.setdefault(probe, []).append(cell)
    for i, own in cells.items():
        far = (a[i][:, None] + b[i][None, :]).ravel()
        order = np.argsort(far, kind="stable")
        upto = np.empty(len(order))
        upto[order] = np.cumsum(counts[order])
        met_at += upto[own].tolist()
    return int(np.ceil(np.quantile(met_at, target, method="higher"))) if met_at else 1


def nearest(vectors: DataFrame, *, every: int = 100, k: int = 10, wanted: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates all rows but the query's own. A query meets `wanted`
    vectors or more, by default as many as the probes need. Null and zero vectors, vectors with null or non-finite
    components and null ids take no part. Rows that share an id are rows of their own: each is a candidate of the others,
    and each gives ranks from 1 if it is a query. Vectors of unequal length are filled with zeros up to the longest. With k
    candidates or fewer, all are returned. No query or no row gives no result. Other columns are not read.
    """
    schema = "query_uid long, query_id long, vec_id long, score double"
    rows = stored(usable(vectors, id_col=id_col, vec_col=vec_col, not_zero=True), "vectors")
    n, size = rows.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = sample(rows, n).toPandas().sort_values("uid")
    if not len(got):  # few rows, none drawn
        got = rows.orderBy("uid").limit(100).toPandas()
    got = got.iloc[np.random.default_rng(2).permutation(len(got))]
    x = matrix(list(got["v"]), size // 8)
    index = fit(x, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(matrix(col(batch, "v").to_pylist(), index.width)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), *(col(batch, c) for c in ("uid", "id", "v"))], ["cell", "uid", "id", "v"])

    indexed = stored(rows.mapInArrow(assign, "cell long, uid long, id long, v binary"), "index")
    counts = np.zeros(len(index.left) * index.k, np.int64)
    for r in indexed.groupBy("cell").count().collect():
        counts[r[0]] = r[1]
    if wanted is None:
        probes = x[:PROBES]
        near = exact_neighbours(indexed, got["uid"].to_numpy()[:PROBES], probes, k).collect()
        wanted = needed(index, probes, [(r.probe, r.cell) for r in near], counts)
    wanted = max(wanted, k + 1)
    # blocks of about BLOCK vectors in order of their left centroid, so that a query travels once to each
    of_left = counts.reshape(-1, index.k).sum(1)
    before = np.cumsum(of_left) - of_left
    first = before // BLOCK
    blocks = np.maximum(first, (before + of_left - 1) // BLOCK) - first + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = col(batch, "cell").to_numpy() // index.k
            key = first[left] + col(batch, "salt").to_numpy() % blocks[left]
            yield pa.RecordBatch.from_arrays([pa.array(key), *(col(batch, c) for c in ("uid", "id", "v", "cell"))], ["key", "uid", "id", "v", "cell"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block, with the left centroids met there and how many right ones with each."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = index.halves(matrix(col(part, "v").to_pylist(), index.width))
                keys, lefts, reaches, own = [], [], [], []
                for i in range(part.num_rows):
                    by_block: dict[int, list[tuple[int, int]]] = {}
                    for left, reach in index.walk(a[i], b[i], counts, wanted).items():
                        for block in range(int(first[left]), int(first[left] + blocks[left])):
                            by_block.setdefault(block, []).append((left, reach))
                    keys += by_block
                    lefts += [[x for x, _ in v] for v in by_block.values()]
                    reaches += [[y for _, y in v] for v in by_block.values()]
                    own += [i] * len(by_block)
                own = pa.array(own, pa.int64())
                lists = [pa.array(v, pa.list_(pa.int32())) for v in (lefts, reaches)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(col(part, c).take(own) for c in ("uid", "id", "v")), *lists], ["key", "uid", "id", "v", "lefts", "reaches"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds a block of vectors (side 0 of its key) and takes its queries as they come."""
        key, parts, held = None, [], None
        for at, side, batch in keyed_slices(batches):
            if at != key:
                key, parts, held = at, [], None
            if side == 0:
                parts.append(batch)
                continue
            if not parts:
                continue
            if held is None:
                held = matrix([b for p in parts for b in col(p, "v").to_pylist()], index.width)
                uids, others, cells = (np.concatenate([col(p, c).to_numpy() for p in parts]) for c in ("uid", "id", "cell"))
                left, right = cells // index.k, cells % index.k
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            x = matrix(col(batch, "v").to_pylist(), index.width)
            _, far = index.halves(x)
            for i, (uid, q, lefts, reaches) in enumerate(zip(*(col(batch, c).to_pylist() for c in ("uid", "id", "lefts", "reaches")), strict=True)):
                reach, nth = np.zeros(len(index.left), np.int32), np.empty(index.k, np.int32)
                reach[lefts] = reaches
                nth[np.argsort(far[i], kind="stable")] = np.arange(index.k)
                mine = np.flatnonzero((nth[right] < reach[left]) & (uids != uid))
                d = np.sqrt(((held[mine] - x[i]) ** 2).sum(1))
                keep = best(d, others[mine], k)
                out.append((uid, q, others[mine[keep]], d[keep]))
            times = [len(v) for _, _, v, _ in out]
            ids = [pa.array(np.repeat([o[c] for o in out], times).astype(np.int64)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.concatenate([o[c] for o in out])) for c in (2, 3))], ["query_uid", "query_id", "vec_id", "score"])

    salted = indexed.withColumn("salt", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(1 << 30)))
    asked = rows.filter(F.col("id") % every == 0).mapInArrow(visits, "key long, uid long, id long, v binary, lefts array<int>, reaches array<int>")
    partitions = int(max(1, min(int((first + blocks).max()), 20_000)))
    w = Window.partitionBy("query_uid").orderBy("score", "vec_id")
    found = met(salted.mapInArrow(keyed, "key long, uid long, id long, v binary, cell long"), asked, partitions).mapInArrow(rerank, schema).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
