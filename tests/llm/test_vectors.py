"""Exact top-k and the multi-index against brute force."""

import numpy as np
import pytest

from tallyward.llm import blocks, multiindex, topk


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=12).astype(np.float32).round(2).tolist()) for i in range(400)]
    out += [(i, out[3][1]) for i in range(400, 700)]  # many equal vectors, so many ties
    out += [(700, None), (750, [1.0, None, *[0.0] * 10]), (800, [float("nan"), *[0.0] * 11]), (850, [float("inf"), *[0.0] * 11]), (900, [0.0] * 12), (None, [1.0] * 12), (0, out[0][1]), (950, [])]
    return out


def usable(rows, zero):
    """(id, vector) of every row that takes part."""
    return [(i, np.array([*v, *[0.0] * (12 - len(v))], np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def brute(known, every, k, score):
    """Query id -> the sorted answers of the rows of that id."""
    out = {}
    for at, (q, x) in enumerate(known):
        if q % every == 0:
            found = sorted((score(x, v), i) for j, (i, v) in enumerate(known) if j != at)[:k]
            out.setdefault(q, []).append(found)
    return {q: sorted(v) for q, v in out.items()}


def answers(got, sign=1):
    """The like of brute() from a result; rows that share an id are told apart by their ranks."""
    out = {}
    for q, g in got.groupby("query_id"):
        times = (g["rank"] == 1).sum()
        assert all((g["rank"] == r).sum() == times for r in g["rank"].unique())
        out[q] = [[(sign * s, i) for s, i in zip(part["score"], part["vec_id"], strict=True)] for part in ([g.sort_values("rank")] if times == 1 else [])] or times
    return out


def test_exact_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    known = [(i, np.floor(256 * v).astype(int)) for i, v in usable(rows, True)]
    want = brute(known, 50, 5, lambda x, v: -int(x @ v))
    got = answers(topk.top_k(vectors(spark, rows)).toPandas(), -1)
    assert got.keys() == want.keys() and got[0] == 2  # id 0 stands in two rows
    assert {q: v for q, v in got.items() if q} == {q: v for q, v in want.items() if q}


def test_cutoff_leaves_most_entries_unresolved():
    rng = np.random.default_rng(5)
    q, r = np.floor(256 * rng.normal(size=(20, 64))), np.floor(256 * rng.normal(size=(3000, 64)))
    partial = topk._partials(q, r, 4)
    full, resolved = q @ r.T, 0
    for i in range(20):
        tops = np.unique(np.concatenate([np.argsort(-p[i])[:6] for p in partial]))
        cut = np.sort(full[i, tops])[-5]
        at = topk.entries([p[i] for p in partial], cut)
        assert set(np.flatnonzero(full[i] >= cut)) <= set(at.tolist())
        resolved += len(at)
    assert resolved < 0.6 * full.size
    r[::2] /= 50  # short rows can't reach the cutoff
    assert set(topk.long_enough(q, [float(np.sort(x)[-5]) for x in q @ r.T], r).tolist()) <= set(range(1, 3000, 2))
    assert len(topk.long_enough(q, [None] * 20, r)) == 3000


def test_top_k_of_few_large_and_no_rows(spark):
    few = topk.top_k(vectors(spark, [(0, [1.0]), (1, [2.0]), (2, [-3.0])])).toPandas()
    assert few[["rank", "vec_id", "score"]].values.tolist() == [[1, 1, 512 * 256], [2, 2, -768 * 256]]
    big = float(np.float32(3e9))
    large = topk.top_k(vectors(spark, [(0, [big, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.5])])).toPandas().sort_values("rank")
    assert large[["vec_id", "score"]].values.tolist() == [[2, 256 * int(big) * 256 + 256 * 128], [1, 256 * int(big) * 256]]
    beyond = topk.top_k(vectors(spark, [(0, [3e30]), (1, [1e30]), (2, [-1e30])])).toPandas().sort_values("rank")
    assert beyond["score"].tolist() == [2**63 - 1, -(2**63)]
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0


def test_multi_index_is_exact_when_all_is_met(spark, rows):
    known = usable(rows, False)
    want = brute(known, 100, 10, lambda x, v: np.sqrt(((x - v) ** 2).sum()))
    got = answers(multiindex.nearest(vectors(spark, rows), wanted=len(known)).toPandas())
    assert got.keys() == want.keys() and got[0] == 2
    for q in want.keys() - {0}:
        assert [i for _, i in got[q][0]] == [i for _, i in want[q][0]]
        assert np.allclose([d for d, _ in got[q][0]], [d for d, _ in want[q][0]], rtol=1e-12)
    assert multiindex.nearest(vectors(spark, [])).count() == 0
    assert multiindex.nearest(vectors(spark, [(0, [0.0]), (1, [1.0])])).count() == 0


def test_long_vectors_are_compared_whole(spark):
    few = [(i, [float(i), 0.0]) for i in range(1, 200)] + [(0, [0.0, 0.0, 0.0, 5.0]), (1000, [0.0, 0.0, 0.0, 5.5])]
    got = multiindex.nearest(vectors(spark, few)).filter("query_id = 0 AND rank <= 2").orderBy("rank").toPandas()
    assert got[["vec_id", "score"]].values.tolist() == [[1000, 0.5], [1, np.sqrt(26)]]


@pytest.mark.parametrize("kind", ["clusters", "given"])
def test_recall(spark, kind, monkeypatch):
    """At the registered parameters, against brute force; blocks are made small, so that there are many."""
    monkeypatch.setattr(multiindex, "BLOCK", 300)
    if kind == "clusters":
        rng = np.random.default_rng(1)
        centres = rng.normal(size=(30, 16)) * 3
        x = (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
        table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    else:
        table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        x = np.array(table.orderBy("vec_id").toPandas()["embedding"].tolist())
    got = multiindex.nearest(table).toPandas()
    x, hit = x.astype(float), 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(g["vec_id"]) & set(np.argsort(d)[:10].tolist()))
    assert hit / len(got) >= 0.9 and len(got) == len(x) // 10


def test_walk_takes_cells_in_order():
    rng = np.random.default_rng(2)
    index = multiindex.Index(4, np.zeros((9, 2)), np.zeros((7, 2)))
    a, b = rng.random(9), rng.random(7)
    counts = rng.integers(0, 3, 63)
    order = np.argsort((a[:, None] + b).ravel())
    right = np.argsort(b)
    for wanted in (1, 5, 20, 10**9):
        got = index.walk(a, b, counts, wanted)
        cells = {left * 7 + int(r) for left, n in got.items() for r in right[:n]}
        assert cells == set(order[: len(cells)].tolist())
        last = order[len(cells) - 1]
        assert wanted > 10**6 or counts[list(cells)].sum() >= wanted > counts[list(cells)].sum() - counts[last]


def test_best_breaks_ties_by_id():
    assert blocks.best(np.array([1.0, 0.0, 1.0, 1.0]), np.array([9, 5, 3, 1]), 3).tolist() == [1, 3, 2]
