"""Language identification by hierarchical discrimination.

A linear support vector machine for each family (one against the rest) chooses
the language family; machines for every pair of a family's languages (one
against one) then vote between the closely related ones. Features are hashed
letter pairs and triples of the whole text, in lower case, square roots of
their counts, scaled to length one.

The machines are fitted on a bounded sample of labelled rows: PER_LANGUAGE rows
of each language (fewer where MOST_ROWS rows in all would be passed), those whose hashed id is smallest, of the MOST_LANGUAGES languages
with most rows. All else covers all rows. The driver holds the sample's features as positions and values
(about 100 MB at MOST_ROWS). Up to SPAN_ROWS rows, all machines are fitted in the span of the rows; beyond, each by
dual coordinate descent over its sparse rows, to the same optimum, a family's from so many rows of its own and of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.common import claim, col, gather, small_batches, text_steps

#: Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl",
}
PER_LANGUAGE, MOST_LANGUAGES, DIMS, UNKNOWN = 600, 200, 1 << 13, "und"
#: Rows of the sample in all, and rows of one machine (their inner products take 36 MB).
MOST_ROWS, SPAN_ROWS = 12_000, 3_000
DECAY = 1e-3
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


_letter: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def features(text: str) -> np.ndarray | None:
    """The feature vector of a text, None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = is_letter()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one space stays of each run of other characters
    points = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)
    pairs = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)
    triples = pairs[:-1] * np.uint32(0xC2B2AE35) + points[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.bincount((pairs ^ (pairs >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=DIMS)
    counts += np.bincount((triples ^ (triples >> np.uint32(15))) * np.uint32(0x297A2D39) >> shift, minlength=DIMS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.linalg.norm(x)


def linear_svm(gram: np.ndarray, y: np.ndarray, decay: float = DECAY, rounds: int = 300, enough: float = 1e-5) -> np.ndarray:
    """How much each row adds to the weights of a linear machine with squared hinge loss; y of 1 and -1, both sides weighted alike.

    Accelerated gradient steps, which never leave the span of the rows: with the rows' inner products (and 1 for the bias)
    a step takes rows by rows numbers and not rows by features. It ends when steps are `enough` small.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(len(y))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (gram @ ahead.astype(np.float32)))
        new = ahead - (decay * ahead - 2 * share * y * slack) / (4 + decay)
        moved = np.abs(new - w).max()
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
        if moved <= enough * np.abs(w).max():
            break
    return w


@dataclass
class Rows:
    """Sparse rows one behind the other: positions and values, and where each row starts."""

    starts: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Rows:
        lens = np.diff(self.starts)[rows]
        return Rows(np.concatenate([[0], np.cumsum(lens)]), gather(self.at, self.starts[rows], lens), gather(self.value, self.starts[rows], lens))

    def dense(self, first: int, last: int) -> np.ndarray:
        out = np.zeros((last - first, DIMS), np.float32)
        own = slice(self.starts[first], self.starts[last])
        out[np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1])), self.at[own]] = self.value[own]
        return out

    def gram(self, block: int = 500) -> np.ndarray:
        """Inner products and 1 for the bias, by blocks of dense rows."""
        n = len(self)
        out = np.ones((n, n), np.float32)
        for i in range(0, n, block):
            x = self.dense(i, min(n, i + block))
            for j in range(i, n, block):
                out[i : i + block, j : j + block] += x @ (x if i == j else self.dense(j, min(n, j + block))).T
                out[j : j + block, i : i + block] = out[i : i + block, j : j + block].T
        return out

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the rows times their weights."""
        return np.bincount(self.at, self.value * np.repeat(weights, np.diff(self.starts)), minlength=DIMS)


def sparse_svm(x: Rows, y: np.ndarray, decay: float = DECAY, rounds: int = 20, enough: float = 0.02) -> np.ndarray:
    """As linear_svm, by dual coordinate descent: memory is that of the rows and one weight vector.

    Rows are taken in an order drawn anew each round, with a fixed seed; it ends when no row is further than `enough` from its condition.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    soft = decay / (2 * share)
    squares = np.add.reduceat(x.value.astype(np.float64) ** 2, x.starts[:-1]) + 1 + soft
    parts = [(x.at[a:b], x.value[a:b].astype(np.float64)) for a, b in zip(x.starts[:-1], x.starts[1:], strict=True)]
    alpha, w, bias, rng = np.zeros(len(y)), np.zeros(DIMS), 0.0, np.random.default_rng(1)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, value = parts[i]
            slope = y[i] * (w[at] @ value + bias) - 1 + soft[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            new = max(0.0, alpha[i] - slope / squares[i])
            w[at] += (new - alpha[i]) * y[i] * value
            bias += (new - alpha[i]) * y[i]
            alpha[i] = new
        if worst <= enough:
            break
    return alpha * y


@dataclass
class Model:
    """Weights by row; families and pairs say what each row tells apart."""

    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores (0 to 1) of the rows of x."""
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.weights.T + self.bias
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        nf, rows = len(self.families), np.arange(len(x))
        chosen = margins[:, :nf].argmax(1) if nf > 1 else np.zeros(len(x), int)
        score = sure(margins[rows, chosen]) if nf > 1 else np.ones(len(x))
        out = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            at = np.flatnonzero(chosen == f)
            own = [lang for lang in self.languages if family(lang) == name]
            votes, sums, weakest = np.zeros((len(at), len(own))), np.zeros((len(at), len(own))), np.full((len(at), len(own)), 8.0)
            for k, (a, b) in enumerate(self.pairs):
                if a in own:
                    m = margins[at, nf + k]
                    for lang, side in ((a, m), (b, -m)):
                        i = own.index(lang)
                        votes[:, i] += side > 0
                        sums[:, i] += side
                        weakest[:, i] = np.minimum(weakest[:, i], side)
            best = (votes + np.tanh(sums) / 4).argmax(1)
            out[at] = np.array(own, object)[best]
            if len(own) > 1:
                score[at] *= sure(weakest[np.arange(len(at)), best])
        return out.tolist(), score


def sample(docs: DataFrame, per_language: int, id_col: str, lang_col: str, most: int = MOST_LANGUAGES, most_rows: int = MOST_ROWS) -> DataFrame:
    """About per_language rows, or an equal share of most_rows, of each of the most frequent languages: those whose hashed id lies under the language's share."""
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.lit("language")) % (1 << 30) + (1 << 30)) / float(1 << 31)
    counts = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(most)
    wanted = F.least(F.lit(per_language), F.lit(most_rows) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy())))
    counts = counts.withColumn("_wanted", wanted)  # a window over `most` rows at most
    return docs.join(F.broadcast(counts), F.col(lang_col) == F.col("_lang")).filter(draw <= F.col("_wanted") / F.col("_n")).drop("_lang", "_n", "_wanted")


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits a model to the labelled rows of docs; rows without language or letters teach nothing; no rows give a model that answers `und`.

    The driver gets the features of the bounded sample alone, as position and value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches, text_col):
            xs = [features(t) for t in texts]
            at = [np.flatnonzero(x).astype(np.int32) if x is not None else None for x in xs]
            rows = [pa.array(at, pa.list_(pa.int32())), pa.array([x[i] if x is not None else None for x, i in zip(xs, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([col(part, lang_col), *rows], ["lang", "at", "value"])

    drawn = sample(docs.select(id_col, text_col, lang_col), per_language, id_col, lang_col)
    got = drawn.mapInArrow(run, "lang string, at array<int>, value array<float>").filter("at IS NOT NULL").toArrow()
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    rows = Rows(np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))]).astype(np.int64), at.flatten().to_numpy(), value.flatten().to_numpy())
    return fit_rows(np.array(got.column("lang").to_pylist(), object), rows)


def _spread(rows: np.ndarray, most: int) -> np.ndarray:
    """`most` of the rows at equal steps (rows lie by language, so each keeps its share), or all."""
    return rows if len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).astype(np.int64)]


def fit_rows(langs: np.ndarray, x: Rows) -> Model:
    """The machines for labelled rows of features."""
    # rows arrive in any order; sorted, the sums of the fit come out alike
    project = np.bincount(np.repeat(np.arange(len(langs)), np.diff(x.starts)), x.value * x.at.astype(np.float64), minlength=len(langs))
    order = np.lexsort((project, langs.astype(str))) if len(langs) else np.zeros(0, np.int64)
    x, langs = x.take(order), langs[order]
    m = Model(languages=sorted(set(langs)))
    m.families = sorted({family(lang) for lang in m.languages})
    m.pairs = [(a, b) for a, b in combinations(m.languages, 2) if family(a) == family(b)]
    groups = np.array([family(lang) for lang in langs], object)
    fits = []

    def fitted(rows: Rows, ones: np.ndarray, gram: np.ndarray | None) -> None:
        y = np.where(ones, 1, -1)
        w = linear_svm(gram, y) if gram is not None else sparse_svm(rows, y)
        fits.append((rows.summed(w), w.sum()))

    whole = x.gram() if 0 < len(langs) <= SPAN_ROWS else None
    if len(m.families) > 1:
        for name in m.families:
            if whole is not None:
                fitted(x, groups == name, whole)
                continue
            own, others = _spread(np.flatnonzero(groups == name), SPAN_ROWS // 2), np.flatnonzero(groups != name)
            at = np.concatenate([own, _spread(others, SPAN_ROWS - len(own))])
            fitted(x.take(at), groups[at] == name, None)
    else:
        fits += [(np.zeros(DIMS), 0.0)] * len(m.families)
    for a, b in m.pairs:
        at = np.flatnonzero((langs == a) | (langs == b))
        own = x.take(at)
        fitted(own, langs[at] == a, whole[np.ix_(at, at)] if whole is not None else None)
    if fits:
        m.weights, m.bias = np.array([w for w, _ in fits], np.float32), np.array([b for _, b in fits], np.float32)
    return m


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per row of docs: id (or the columns of keep), lang_pred, lang_score; prefix goes before these two names.

    Null texts and texts without a letter are `und` with score 0. Whole texts are read; equal texts get equal answers; an empty table gives no rows.
    The model travels with the tasks: a row of DIMS numbers for each machine.
    """
    keep = keep or [id_col]
    columns = list(dict.fromkeys([*keep, text_col]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", {prefix}lang_pred string, {prefix}lang_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        for part, texts in text_steps(batches, text_col):
            xs = [features(t) for t in texts]
            known = [i for i, x in enumerate(xs) if x is not None]
            langs, scores = [UNKNOWN] * len(xs), np.zeros(len(xs))
            if known:
                found, scores[known] = model.predict(np.array([xs[i] for i in known]))
                for i, lang in zip(known, found, strict=True):
                    langs[i] = lang
            yield pa.RecordBatch.from_arrays([*(col(part, c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], [*keep, f"{prefix}lang_pred", f"{prefix}lang_score"])

    return small_batches(docs.select(*columns)).mapInArrow(run, schema)
