"""URL filter: rules first, then gradient-boosted trees over lexical features. Column expressions and aggregations alone.

The trees are grown level by level from histograms: a bounded sample of labelled URLs is
binned once and stored, each level is one aggregation of its rows by (node, feature, bin), and
the driver gets those sums (nodes x features x bins) and picks the splits. The finished trees
are CASE expressions, so every URL is judged in the scan's own stage, without a shuffle.

Features: lengths (URL, host, path), depth, labels of the host, digit ratio, hyphens of the host, entropy of host
and path, number of parameters, and suffix statistics: how bad the sample's URLs with the same
last one, two and three labels of the host are, as smoothed log-odds. While the trees are fitted,
a row's statistics come from the rows of the other FOLDS, so that its label isn't among them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import drop, stored

#: Most labelled URLs of each label that the trees are fitted on (drawn by hash).
MOST = 10_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 12, 3, 16, 0.4, 1.0, 5
BLOCK_FROM = 0.5
#: Weight of the prior in a suffix's log-odds, in rows.
PRIOR_ROWS = 4.0
SUFFIXES = (1, 2, 3)
FOLDS = 4
#: Most rules that are matched as one expression.
MOST_RULES = 500
#: Words that, as a part of a host between dots and hyphens, mark a URL as bad where no labels are given.
BAD_WORDS = ("ads", "adult", "bets", "betting", "casino", "dating", "farm", "free", "loans", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


@dataclass(frozen=True)
class Rule:
    """An action (block or allow) for a host with its subdomains and paths that start alike."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines such as `block example.com/de/`; the path begins with the first slash."""
    out = []
    for line in lines:
        action, _, place = line.partition(" ")
        host, slash, path = place.partition("/")
        if action not in ("block", "allow") or not host:
            raise ValueError(f"no rule: {line}")
        out.append(Rule(action, host, slash + path))
    return out


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, parameters): host after the first `://`, A-Z lower-cased, up to `/`, `?`, `#` or the end; path up to `?`, `#` or the end. All empty for null or where `://` lacks."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path, F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule's text, its action) of the longest rule that fits; nulls where none does. Of rules of one length the first counts."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def entropy(text: Column) -> Column:
    """Bits a character, over letters (any case), digits, dot, hyphen and all others as one; 0 for an empty text."""
    known = [*_LOWER, *_DIGITS, ".", "-"]

    def of(t: Column) -> Column:
        part = lambda c: F.when(c > 0, -c / F.length(t) * F.log2(c / F.length(t))).otherwise(0.0)
        others = part(F.length(F.translate(t, "".join(known), "")))
        return F.aggregate(F.array(*map(F.lit, known)), others, lambda sum_, c: sum_ + part(F.length(t) - F.length(F.replace(t, c))))

    # as an element of an array the lower-cased text is made once, not once a character
    return F.transform(F.array(F.translate(text, _UPPER, _LOWER)), of)[0]


LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "host_entropy", "path_entropy", "parameters")
FEATURES = (*LEXICAL, *(f"suffix_{k}" for k in SUFFIXES))


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls (already without clashing names) with _host, _path, the lexical features and the suffixes, each under an underscore."""
    host, path, query = split_url(F.col(url))
    cut = urls.withColumns({"_url": F.coalesce(F.col(url), F.lit("")), "_host": F.coalesce(host, F.lit("")), "_path": F.coalesce(path, F.lit("")), "_query": F.coalesce(query, F.lit(""))})
    n = F.length("_url")
    made = {
        "url_length": n, "host_length": F.length("_host"), "path_length": F.length("_path"), "depth": F.regexp_count("_path", F.lit("[^/]+")),
        "labels": F.regexp_count("_host", F.lit(r"[^.]+")), "digit_ratio": F.when(n > 0, _without(F.col("_url"), _DIGITS) / n).otherwise(0.0), "hyphens": _without(F.col("_host"), "-"),
        "host_entropy": entropy(F.col("_host")), "path_entropy": entropy(F.col("_path")), "parameters": F.regexp_count("_query", F.lit("[^&;]+")),
    }
    tails = {f"_tail_{k}": F.substring_index("_host", ".", -k) for k in SUFFIXES}
    return cut.withColumns({f"_{k}": x.cast("double") for k, x in made.items()} | tails).drop("_query")


def bad_words_label(host: Column) -> Column:
    """1 where a part of the host is one of BAD_WORDS, else 0: the labels where none are given."""
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, BAD_WORDS))).cast("int")


@dataclass
class Model:
    """trees: nested (feature, threshold, left, right) or a leaf's number; suffixes: k, key, bad, n and these of each fold, over the sample (at most MOST x 2 x 3 rows)."""

    base: float = 0.0
    bad_share: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None


def _tree(node, value) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, most, left, right = node
    return F.when(value(name) <= most, _tree(left, value)).otherwise(_tree(right, value))


def _raw(model: Model, value=lambda name: F.col(f"_{name}")) -> Column:
    return reduce(Column.__add__, [_tree(t, value) for t in model.trees], F.lit(model.base))


def _log_odds(bad: Column, n: Column, share: float) -> Column:
    return F.log((bad + PRIOR_ROWS * share) / (n - bad + PRIOR_ROWS * (1 - share)))


def _with_suffix_statistics(rows: DataFrame, suffixes: DataFrame, share: float, fold: Column | None = None) -> DataFrame:
    """Adds _suffix_k. fold: the row's, to be left out of its statistics. The table of suffixes is bounded by the sample, so it is broadcast."""
    out = rows
    for k in SUFFIXES:
        side = suffixes.filter(F.col("k") == k).select(F.col("key").alias("_key"), F.col("bad").alias("_bad"), F.col("n").alias("_n"), F.col("by_fold").alias("_by_fold"))
        out = out.join(F.broadcast(side), F.col(f"_tail_{k}") == F.col("_key"), "left")
        bad, n = F.coalesce("_bad", F.lit(0)), F.coalesce("_n", F.lit(0))
        if fold is not None:
            bad, n = bad - F.coalesce(F.col("_by_fold")[fold]["bad"], F.lit(0)), n - F.coalesce(F.col("_by_fold")[fold]["n"], F.lit(0))
        out = out.withColumn(f"_suffix_{k}", _log_odds(bad, n, share)).drop("_key", "_bad", "_n", "_by_fold")
    return out


def fit(labelled: DataFrame, *, url: str = "url", label: str = "label", most: int = MOST, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Trees from labelled URLs (label 1: bad, 0: good; null: not used). Rows are drawn by a hash of URL and label, `most` of each label; equal URLs are drawn together and all count.

    An empty table or one label alone gives a model without trees, which lets everything pass.
    """
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    # copies of a URL are one row of a weight, so that a hot URL can't fill the sample
    rows = rows.groupBy("url", "y").agg(F.count("*").alias("n"))
    kinds = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("url", "y"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, most / kinds[1])).otherwise(min(1.0, most / kinds[0]))
    drawn = stored(with_features(rows.filter(draw < share)).drop("url", "_url", "_path"), "urls")
    got = drawn.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("bad")).first()
    if not got.n or not 0 < got.bad < got.n:
        drop(drawn)
        return Model()
    bad_share = got.bad / got.n
    fold = F.pmod(F.xxhash64("_host", F.lit("fold")), F.lit(FOLDS)).cast("int")
    drawn_folds = drawn.withColumn("fold", fold)
    tails = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_tail_{k}").alias("key")) for k in SUFFIXES)))
    own = lambda i, x: F.coalesce(F.sum(F.when(F.col("fold") == i, x)), F.lit(0))
    by_fold = F.array(*(F.struct(own(i, F.col("y") * F.col("n")).alias("bad"), own(i, F.col("n")).alias("n")) for i in range(FOLDS)))
    suffixes = stored(drawn_folds.select(tails.alias("t"), "y", "n", "fold").groupBy("t.k", "t.key").agg(F.sum(F.col("y") * F.col("n")).alias("bad"), F.sum("n").alias("n"), by_fold.alias("by_fold")), "suffixes")
    whole = _with_suffix_statistics(drawn_folds, suffixes, bad_share, F.col("fold"))
    asked = [i / BINS for i in range(1, BINS)]
    edges = {f: sorted(set(e)) for f, e in zip(FEATURES, whole.agg(*(F.percentile_approx(f"_{f}", asked, 1000) for f in FEATURES)).first(), strict=True)}
    binned = {f: reduce(Column.__add__, [(F.col(f"_{f}") > e).cast("int") for e in edges[f]]) for f in FEATURES}
    sample = stored(whole.select("y", "n", *(b.alias(f"_{f}") for f, b in binned.items())), "bins")
    model = Model(base=math.log(bad_share / (1 - bad_share)), bad_share=bad_share, suffixes=suffixes)
    bins = Model(base=model.base)  # the same trees over numbers of bins
    for _ in range(trees):
        found = _grow(sample, bins, depth, {f: len(edges[f]) for f in FEATURES})
        if not isinstance(found, tuple):
            break
        bins.trees.append(found)
    real = lambda t: (t[0], edges[t[0]][t[1]], real(t[2]), real(t[3])) if isinstance(t, tuple) else t
    model.trees = [real(t) for t in bins.trees]
    drop(drawn, sample)
    return model


def _grow(sample: DataFrame, bins: Model, depth: int, most: dict[str, int]):
    """One more tree over bins. The sample is bounded, so one task sums a level."""
    p = 1 / (1 + F.exp(-_raw(bins)))
    rows = sample.coalesce(1).withColumns({"_g": (p - F.col("y")) * F.col("n"), "_h": p * (1 - p) * F.col("n")})
    splits: dict[int, tuple[str, int]] = {}
    value = {1: 0.0}
    where = F.lit(1)
    for _ in range(depth):
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"_{f}").alias("b")) for f in FEATURES)))
        sums = rows.select(where.alias("node"), "_g", "_h", "n", pairs.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.sum("n").alias("n")).collect()
        new = _best_splits([tuple(r) for r in sums], most, value)
        new = {node: s for node, s in new.items() if node not in splits}
        if not new:
            break
        splits |= new
        for node, (f, b) in new.items():
            where = F.when(where == node, F.when(F.col(f"_{f}") <= b, 2 * node).otherwise(2 * node + 1)).otherwise(where)
    build = lambda k: (*splits[k], build(2 * k), build(2 * k + 1)) if k in splits else value[k]
    return build(1)


def _best_splits(sums: list[tuple], most: dict[str, int], value: dict[int, float]) -> dict[int, tuple[str, int]]:
    """node -> (feature, last bin on the left) of the greatest gain from (node, feature, bin, g, h, n); puts the values of both children into value."""
    table: dict[int, dict[str, dict[int, tuple]]] = {}
    for node, f, b, g, h, n in sums:
        table.setdefault(node, {}).setdefault(f, {})[b] = (g, h, n)
    out = {}
    for node, features in sorted(table.items()):
        best = (1e-6, None)
        for f in FEATURES:
            own = features.get(f, {})
            total = [math.fsum(x[i] for x in own.values()) for i in range(3)]
            left = [0.0, 0.0, 0]
            for b in range(most[f]):
                left = [a + x for a, x in zip(left, own.get(b, (0.0, 0.0, 0)), strict=True)]
                right = [t - a for t, a in zip(total, left, strict=True)]
                if min(left[2], right[2]) < LEAST_ROWS:
                    continue
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, b, -RATE * left[0] / (left[1] + RIDGE), -RATE * right[0] / (right[1] + RIDGE)))
        if best[1]:
            f, b, low, high = best[1]
            out[node] = (f, b)
            value[2 * node], value[2 * node + 1] = low, high
    return out


def judge(pages: DataFrame, rules: list[Rule], model: Model, *, id_col: str = "page_id", url_col: str = "url", block_from: float = BLOCK_FROM) -> DataFrame:
    """A row a row of pages: id, host, path, rule (null where none fits), verdict, score.

    Null URLs count as empty; those and URLs without `://` have an empty host and path and are left to the trees. Very long URLs are read
    whole. Repeated rows get a row each, an empty table gives none, other columns are not read. score is the trees'
    probability of a bad URL (0 where no model could be fitted); the verdict is the rule's action or else `block` from block_from up.
    """
    rows = with_features(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_given")), "_given")
    if model.trees:
        rows = _with_suffix_statistics(rows, model.suffixes, model.bad_share)
    score = 1 / (1 + F.exp(-_raw(model))) if model.trees else F.lit(0.0)
    rule, action = matching_rule(F.col("_host"), F.col("_path"), rules)
    scored = rows.withColumns({"_rule": rule, "_action": action, "_score": score})
    verdict = F.coalesce("_action", F.when(F.col("_score") >= block_from, "block").otherwise("allow"))
    return scored.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score"))


def with_word_labels(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """url and label by bad_words_label; URLs without a host have none."""
    host, _, _ = split_url(F.col(url_col))
    return pages.select(F.col(url_col).alias("url"), F.when(host != "", bad_words_label(host)).alias("label"))
