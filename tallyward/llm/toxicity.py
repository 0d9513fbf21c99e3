"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and clean training documents under an
informative Dirichlet prior; a word too rare for that takes those of its longest
prefix that has them among the other words. All other words cost a little. A
linear-time scan finds the segments of a text whose sum is greatest. The greatest
sum in clean text follows an extreme-value law, fitted on clean training documents
(Karlin and Altschul's root for its slope, maximum likelihood for its scale), which
makes a p-value of a sum and a length; a logistic curve over its logarithm gives the score.
Near copies would lend every word of theirs the label, so of training
documents that are alike one is counted.

The classifier is fitted on a bounded sample of labelled rows: MOST_TOXIC and
MOST_CLEAN documents, those whose hashed id is smallest. All else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import claim, col, drop, hash64, mixed, small_batches, stored, text_steps

MOST_TOXIC, MOST_CLEAN = 6_000, 12_000
#: Prefixes that a rare word falls back to; documents' worth of the prior; least z value and log-odds; cost of other words.
PREFIXES, PRIOR, LEAST_Z, LEAST_ODDS, COST = (5, 4, 3), 50.0, 3.0, 1.5, 0.15
#: Sketch values of a training document, and how many two documents share to count as one.
SKETCH, ALIKE = 24, 4
#: Tasks over which the sample's documents are dealt.
SAMPLE_PARTS = 32
#: A passage counts as significant under this p-value.
SIGNIFICANT = 0.01
KEPT_WORDS = 500_000
_WORD = re.compile(r"\w+")


def prefixes(word: str) -> list[str]:
    """The features that a rare word falls back to, longest first."""
    return [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]


@dataclass
class Model:
    """log_odds of the significant words and prefixes; the law's slope and scale; the curve's place and slope."""

    log_odds: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    scale: float = 1.0
    at: float = -2.0
    by: float = 0.0

    def word_score(self, chunk: str) -> float:
        """Of a run of characters without white space: the best of its words."""
        best = -COST
        for w in _WORD.findall(chunk.lower()):
            for f in (w, *prefixes(w)):
                if (x := self.log_odds.get(f)) is not None:
                    best = max(best, x)
                    break
        return best

    def surprise(self, most: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Minus the logarithm of the p-value of a greatest sum in a text of so many words."""
        with np.errstate(divide="ignore"):
            t = np.log(self.scale) + np.log(np.maximum(length, 1)) - self.slope * most
        known = np.where(t < -30, -t, -np.log(np.maximum(-np.expm1(-np.exp(np.minimum(t, 30))), 1e-300)))
        return np.where(most > 0, known, 0.0)  # any text has a sum of 0

    def score(self, most: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.at + self.by * np.log1p(self.surprise(most, length)), -30, 30)))


class Scores(dict):
    """Runs of characters to their score, kept within a task up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, chunk: str) -> float:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[chunk] = x = self.model.word_score(chunk)
        return x


def greatest(scores: np.ndarray) -> float:
    """The greatest sum of a segment, 0 for none."""
    if not len(scores):
        return 0.0
    total = np.cumsum(scores)
    return float(max(0.0, (total - np.minimum(0, np.minimum.accumulate(np.concatenate([[0.0], total[:-1]])))).max()))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in linear time.

    Candidates are kept with the sums before and at their end. Each also knows the last candidate before it with a lesser
    sum before: those in between can't be the one that a later candidate looks for, so the search jumps over them.
    """
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []
    right: list[float] = []
    lesser: list[int] = []
    plus = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i, low, high in zip(plus.tolist(), sums[plus].tolist(), sums[plus + 1].tolist(), strict=True):
        start, j = i, len(starts) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = lesser[j]
            if j < 0 or right[j] >= high:
                break
            # j and all behind it become one with the new one
            start, low, k = starts[j], left[j], lesser[j]
            for x in (starts, ends, left, right, lesser):
                del x[j:]
            j = k
        starts.append(start)
        ends.append(i + 1)
        left.append(low)
        right.append(high)
        lesser.append(j)
    return [(a, b, r - v) for a, b, v, r in zip(starts, ends, left, right, strict=True)]


def _root(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive x with sum(weights * exp(x * values)) = 1: mean below 0, largest value above."""
    low, high = 1e-6, 1.0
    grown = lambda x: float((weights * np.exp(np.minimum(x * values, 600))).sum())
    while grown(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's steps with a little ridge."""
    x1 = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + np.array([0, 0.1]) * w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag([1e-6, 0.1])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def sample(labels: DataFrame, most_toxic: int, most_clean: int, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic) of a bounded sample; a document labelled twice is toxic if one label says so; null labels teach nothing."""
    once = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col)).alias("toxic"))
    n = {r[0]: r[1] for r in once.groupBy("toxic").count().collect()}
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity")) % (1 << 30) + (1 << 30)) / float(1 << 31)
    share = F.when(F.col("toxic") == 1, min(1.0, most_toxic / max(1, n.get(1, 0)))).otherwise(min(1.0, most_clean / max(1, n.get(0, 0))))
    return once.filter(draw <= share)


def sketch(text: str) -> np.ndarray:
    """Least hashes of the text's word triples under SKETCH mixings; empty for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hash64(w.encode()) for w in words), np.uint64, len(words))
    size = min(3, len(h))
    h = np.unique(mixed(sum(h[j : len(h) - size + 1 + j] * np.uint64(2 * j + 1) for j in range(size))))
    return np.array([mixed(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)).min() for k in range(SKETCH)], np.uint64)


def unlike(ids: list, sketches: list[np.ndarray]) -> list:
    """One id of each group of documents that share ALIKE sketch values, in the order given; documents without words all stay."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for i, values in zip(ids, sketches, strict=True):
        keys = [(k, int(v)) for k, v in enumerate(values)]
        if max(Counter(seen[x] for x in keys if x in seen).values(), default=0) < ALIKE:
            for x in keys:
                seen.setdefault(x, len(out))
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model; without labelled documents of both kinds every text scores alike.

    The sample of ids is the only broadcast, bounded by most_toxic + most_clean. Its documents are stored once; rows that
    share an id are one document, with the least of their texts. Features are counted by document, first
    within each task; the driver gets the significant ones and two numbers for each document of the sample.
    """
    sampled = labelled(docs, sample(labels, most_toxic, most_clean, id_col, label_col), id_col, text_col)
    try:
        return _fitted(sampled, id_col, text_col)
    finally:
        drop(sampled)


def labelled(docs: DataFrame, drawn: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toxic, text) of the drawn documents, stored, so that the passes of the fit read the sample and not the corpus.

    Documents that share an id are one, with the least of their texts; copies are brought together before the shuffle.
    """
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)
    return stored(rows.groupBy(id_col, "toxic").agg(F.min(text_col).alias(text_col)).repartition(SAMPLE_PARTS), "labelled")


def _fitted(sampled: DataFrame, id_col: str, text_col: str) -> Model:
    """The model of a sample (id, toxic, text) with one row an id."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches, text_col):
            yield pa.RecordBatch.from_arrays([col(part, id_col), col(part, "toxic").cast(pa.int64()), pa.array([sketch(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], [id_col, "toxic", "sketch"])

    kind = sampled.schema[id_col].dataType.simpleString()
    got = sampled.mapInArrow(sketches, f"{id_col} {kind}, toxic long, sketch array<long>").toPandas().sort_values(id_col)
    kept = {t: unlike(got[id_col][got["toxic"] == t].tolist(), got["sketch"][got["toxic"] == t].tolist()) for t in (0, 1)}
    n0, n1 = len(kept[0]), len(kept[1])
    model = Model()
    if not n0 or not n1:
        return model
    known = sampled.join(F.broadcast(sampled.sparkSession.createDataFrame([(i,) for t in (0, 1) for i in kept[t]], f"{id_col} {kind}")), id_col, "left_semi")

    def significant(of_words: Callable[[set[str]], set[str]]) -> dict[str, float]:
        """Features with their log-odds, of those that of_words takes from the words of each document."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides: tuple[Counter, Counter] = (Counter(), Counter())
            for part, texts in text_steps(batches, text_col):
                for text, toxic in zip(texts, col(part, "toxic").to_pylist(), strict=True):
                    sides[toxic == 1].update(of_words(set(_WORD.findall(text.lower()))))
            names = list(sides[0].keys() | sides[1].keys())
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([s[f] for f in some], pa.int64()) for s in sides)], ["feature", "clean", "toxic"])

        counts = known.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        a = PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1)
        odds = lambda y, n: F.log((y + a) / (n + PRIOR - y - a + 1))
        delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
        z = delta / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
        found = counts.filter("toxic >= 3").select("feature", delta.alias("delta"), z.alias("z")).filter((F.col("z") >= LEAST_Z) & (F.col("delta") >= LEAST_ODDS))
        return {r.feature: r.delta for r in found.collect()}

    words = significant(lambda ws: ws)
    model.log_odds = words | significant(lambda ws: {f for w in ws if w not in words for f in prefixes(w)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Scores(model)
        for part, texts in text_steps(batches, text_col):
            got = [np.fromiter(map(held.__getitem__, words), float, len(words)) for words in map(str.split, texts)]
            plus = [x[x > 0] for x in got]
            out = [pa.array([greatest(x) for x in got]), pa.array([len(x) for x in got], pa.int64()), pa.array(plus, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([col(part, id_col), col(part, "toxic").cast(pa.int64()), *out], [id_col, "toxic", "most", "words", "plus"])

    got = known.mapInArrow(scan, f"{id_col} {kind}, toxic long, most double, words long, plus array<double>").toPandas().sort_values(id_col)
    most, words, toxic = got["most"].to_numpy(float), got["words"].to_numpy(float), got["toxic"].to_numpy() == 1
    plus = np.concatenate([np.zeros(0), *got["plus"][~toxic]])
    top = max([1.0, *model.log_odds.values()])
    values = np.concatenate([plus, [top, -COST]])
    rest = max(1.0, words[~toxic].sum() - len(plus))
    weights = np.concatenate([np.ones(len(plus)), [1.0, rest]]) / (len(plus) + 1 + rest)
    # where clean words don't lose on average, the law has no root; a small slope then stands for it
    model.slope = _root(values, weights) if (values * weights).sum() < 0 else 0.05
    model.scale = float((~toxic).sum() / max(1e-300, (np.maximum(words[~toxic], 1) * np.exp(-model.slope * most[~toxic])).sum()))
    model.at, model.by = _logistic(np.log1p(model.surprise(most, words)), toxic.astype(float))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per row of docs: id (or the columns of keep), toxicity, p_value, passages (start and end in characters, sum); prefix goes before these three names.

    Null and empty texts have no words and get the score of that; equal texts get equal scores. Passages are the maximal
    segments that are significant in a text of that length. Very long texts are scored whole, in time linear in their words; an
    empty table gives no rows. The model travels with the tasks; it holds significant features alone.
    """
    keep = keep or [id_col]
    columns = list(dict.fromkeys([*keep, text_col]))
    span = f"{prefix}passages array<struct<start:int,end:int,sum:double>>"
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", {prefix}toxicity double, {prefix}p_value double, {span}"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        held = Scores(model)
        for part, texts in text_steps(batches, text_col):
            got = [np.fromiter(map(held.__getitem__, words), float, len(words)) for words in map(str.split, texts)]
            most, words = np.array([greatest(x) for x in got]), np.array([len(x) for x in got])
            p = np.exp(-model.surprise(most, words))
            passages: list[list[dict]] = [[] for _ in texts]
            for i in np.flatnonzero((p < SIGNIFICANT) & (most > 0)):
                spots = [m.span() for m in re.finditer(r"\S+", texts[i])]
                segments = maximal_segments(got[i])
                sure = np.exp(-model.surprise(np.array([s for *_, s in segments]), np.full(len(segments), words[i]))) < SIGNIFICANT
                passages[i] = [{"start": spots[a][0], "end": spots[b - 1][1], "sum": s} for (a, b, s), ok in zip(segments, sure, strict=True) if ok]
            out = [pa.array(model.score(most, words)), pa.array(p), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*(col(part, c) for c in keep), *out], [*keep, *(f"{prefix}{c}" for c in ("toxicity", "p_value", "passages"))])

    return small_batches(docs.select(*columns)).mapInArrow(run, schema)
