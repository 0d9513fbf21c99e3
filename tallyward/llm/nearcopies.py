"""Near copies by DartMinHash signatures, banded joins and exact checks.

1. One pass over the texts: the hashed shingles (five words, lower case, without outer
   punctuation), each weighted by how often it occurs, a fingerprint of that weighted set
   (the document's node: copies share one), a DartMinHash signature and the keys of its
   bands. Similarity is the weighted Jaccard similarity: the sum of the lesser weights by
   the sum of the greater ones.
2. Nodes that share a band key form a bucket. Each bucket's most connected node is its
   pivot; every member is compared with the pivot, exactly, which makes as many pairs as
   members and never all pairs. Links of 0.8 or more give components.
3. What this leaves open are pairs in a bucket of which one is outside the pivot's
   component. A shingle that no other such node has can't be shared, and that bounds how
   similar the pair can be: it shares at most o, the sum over classes of hash of the lesser
   weight of other shingles, so similarity <= o / (|x| + |y| - o). Only pairs within the bound
   are joined (by bucket and size class) and compared exactly.

Groups of copies and stars of many links can be large: they are aggregated before they are
joined, and rows of one node or centre are dealt over SLOTS tasks.

So every pair that shares a band and is similar enough links its documents' classes, and
with 32 bands of 4 values a pair of similarity 0.8 shares none with probability 5e-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.common import claim, col, drop, hash64, mixed, small_batches, stored, text_steps

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 4
#: Hashed words that a task keeps, and characters whose signatures it makes at once.
KEPT_WORDS, STEP = 200_000, 200_000
#: A list of candidate rows is broadcast up to so many (16 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 300_000
#: Ratio of neighbouring size classes.
SIZE_STEP = 1.02
#: Classes of hash by which shared shingles are bounded.
BINS = 64
#: Tasks over which the rows of one join key are dealt.
SLOTS = 64
_OUTER = re.compile(r"^\W+|\W+$")
_GOLD = 0x9E3779B97F4A7C15


class _Words(dict):
    """Runs of characters to the 64-bit hash of their word, 0 for those without a word."""

    def __missing__(self, chunk: str) -> int:
        word = _OUTER.sub("", chunk.lower())
        self[chunk] = h = (hash64(word.encode()) | 1) if word else 0
        return h


_words = _Words()


def _tidy() -> None:
    """Bounds the kept words. A function of the module, as functions that travel to a worker bring copies of the globals they name."""
    claim("near copies", _words.clear)
    if len(_words) > KEPT_WORDS:
        _words.clear()


def word_hashes(text: str) -> np.ndarray:
    chunks = text.split()
    h = np.fromiter(map(_words.__getitem__, chunks), np.uint64, len(chunks))
    return h[h != 0]


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The text's hashed shingles in order, and how often each occurs; a text of fewer words has one shingle of them all, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0, np.int64)
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(_GOLD) + w[j : len(w) - size + 1 + j]
    return np.unique(mixed(h), return_counts=True)


@cache
def _poisson(area: float) -> np.ndarray:
    """Distribution function of a Poisson variable, for inverting."""
    k = np.arange(int(area + 12 * np.sqrt(area) + 20))
    logs = k * np.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(k[1:], 1)))])
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """DartMinHash signatures (sets, size) of weighted sets that lie one behind the other; none may be empty.

    Each element owns a plane of weight by rank over which darts lie at random (a Poisson process of density one, drawn
    from the element's hash alone, in cells that double in size). A set sees the darts under its weights and up to a rank
    that leaves size * (ln(size) + 2) of them on average; a dart falls to one coordinate, and each coordinate keeps the
    dart of least rank. Sets with an empty coordinate look up to twice the rank, again and again. Two sets agree in a
    coordinate with the probability of their weighted Jaccard similarity; the work hardly grows with a set's size.
    """
    counts = np.diff([*starts, len(elements)])
    owner = np.repeat(np.arange(len(starts)), counts)
    total = np.add.reduceat(weights, starts)
    rank_end = size * (np.log(size) + 2) / total
    out = np.zeros((len(starts), size), np.uint64)
    todo = np.arange(len(starts))
    while len(todo):
        wanted = np.zeros(len(starts), bool)
        wanted[todo] = True
        mine = np.flatnonzero(wanted[owner])
        got: list[tuple[np.ndarray, ...]] = []
        level = 0
        while len(mine):
            low_w, high_w = (0.0 if level == 0 else 2.0 ** (level - 1)), 2.0**level
            mine = mine[weights[mine] > low_w]
            cell, here = 0, mine
            while len(here):
                wide = high_w - low_w
                low_r, high_r = (0.0 if cell == 0 else 2.0 ** (cell - 4) / wide), 2.0 ** (cell - 3) / wide
                here = here[rank_end[owner[here]] > low_r]
                if not len(here):
                    break
                h = mixed(elements[here] ^ np.uint64(((seed * 64 + level) * 4096 + cell + 1) * _GOLD % 2**64))
                n = np.searchsorted(_poisson((high_r - low_r) * wide), _unit(h), side="right")
                at = np.repeat(np.arange(len(here)), n)
                nth = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64)
                dart = mixed(h[at] + nth * np.uint64(_GOLD))
                i = here[at]
                rank = low_r + (high_r - low_r) * _unit(mixed(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                weight = low_w + wide * _unit(mixed(dart ^ np.uint64(0x5BD1E9955BD1E995)))
                ok = (rank < rank_end[owner[i]]) & (weight < weights[i])
                got.append((owner[i[ok]], rank[ok], dart[ok]))
                cell += 1
            level += 1
        sets, rank, dart = (np.concatenate(x) for x in zip(*got, strict=True))
        place = sets * size + (mixed(dart ^ np.uint64(0xC3A5C85C97CB3127)) % np.uint64(size)).astype(np.int64)
        least = np.full(len(starts) * size, np.inf)
        np.minimum.at(least, place, rank)
        first = rank == least[place]
        flat = out.reshape(-1)
        flat[place[first]] = np.maximum(dart[first], np.uint64(1))
        todo = todo[(out[todo] == 0).any(1)]
        rank_end[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) of 64-bit keys: of the rows of a band and its number."""
    parts = signatures.reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD)), parts.shape[:2])
    for j in range(rows):
        h = mixed(h ^ parts[:, :, j])
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)


def _node(s: np.ndarray, counts: np.ndarray, text: str) -> bytes:
    """16 bytes that stand for a weighted set of shingles; texts without words are alike only if equal."""
    if not len(s):
        return b"\0" * 8 + hash64(text.encode()).to_bytes(8, "little")
    times = counts.astype(np.uint64)
    return b"".join(int((mixed(s ^ np.uint64(k)) * times).sum(dtype=np.uint64)).to_bytes(8, "little") for k in (0x1234567, 0x89ABCDEF))


def signed(docs: DataFrame, *, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (xxhash64 of the text), node, shingles (their number), bands (array of keys), slot (by which a node's rows are dealt) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for part, texts in text_steps(batches, text_col, STEP):
            _tidy()
            sets = [shingles(t, size) for t in texts]
            full = [i for i, (s, _) in enumerate(sets) if len(s)]
            keys: list[np.ndarray | None] = [None] * len(sets)
            if full:
                flat, weights = (np.concatenate([sets[i][k] for i in full]) for k in (0, 1))
                starts = np.cumsum([0, *(len(sets[i][0]) for i in full[:-1])])
                for i, k in zip(full, band_keys(dart_signatures(flat, weights.astype(float), starts, bands * rows), bands, rows), strict=True):
                    keys[i] = k
            nodes = [_node(*s, t) for s, t in zip(sets, texts, strict=True)]
            slot = np.arange(at, at + len(texts), dtype=np.int32) % SLOTS
            at = (at + len(texts)) % SLOTS
            out = [pa.array(nodes, pa.binary()), pa.array([int(c.sum()) for _, c in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(slot)]
            yield pa.RecordBatch.from_arrays([col(part, id_col), col(part, "text_key"), *out], [id_col, "text_key", "node", "shingles", "bands", "slot"])

    rows_ = docs.select(id_col, text_col, text_key(text_col).alias("text_key"))
    return small_batches(rows_).mapInArrow(run, f"{id_col} {kind}, text_key long, node binary, shingles long, bands array<long>, slot int")


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def spread(rows: DataFrame, side: DataFrame, key: str, slot: Column) -> DataFrame:
    """rows joined to side, which has one row a key: the rows of a key are dealt over slots, so that no task gets all of a hot one."""
    slotted = rows.withColumn("slot", slot)
    return slotted.join(slotted.select(key, "slot").distinct().join(side, key), [key, "slot"]).drop("slot")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes with links: root is the least node of the component. Alternates large and small stars until nothing changes."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    state, by_end = None, F.pmod(F.xxhash64("v"), F.lit(SLOTS)).cast("int")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u join u's least neighbour
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = stored(spread(both.filter("v > u"), least, "u", by_end).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
        drop(edges, least)
        # small star: u and its neighbours below join the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = spread(large, least, "u", by_end).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "links")
        drop(large, least)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if new == state:
            break
        state = new
    roots = edges.select("v").distinct()
    found = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root"))), "components")
    drop(edges)
    return found


def _arrays(batch: pa.RecordBatch, hashes: str, counts: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for h, c in zip(col(batch, hashes), col(batch, counts), strict=True):
        yield h.values.to_numpy().view(np.uint64), c.values.to_numpy()


def similarity(x: np.ndarray, x_counts: np.ndarray, y: np.ndarray, y_counts: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets, each of ordered hashes and their counts; neither is empty."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    both = int(np.minimum(x_counts[hit], y_counts[at[hit]]).sum())
    return both / (int(x_counts.sum()) + int(y_counts.sum()) - both)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes: exact weighted Jaccard similarity of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [similarity(*x, *y) for x, y in zip(_arrays(batch, "x", "x_counts"), _arrays(batch, "y", "y_counts"), strict=True)]
            yield pa.RecordBatch.from_arrays([col(batch, "a"), col(batch, "b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h), F.col("counts").alias(f"{h}_counts")) for n, h in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "x_counts", "y", "y_counts").mapInArrow(run, "a binary, b binary, similarity double")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size, common (weight of shingles that another node has too) and the common ones' weight by BINS classes of hash, from hashes, counts and the low bits of those alone."""
    for batch in batches:
        sizes, common, bins = [], [], []
        for (h, n), alone in zip(_arrays(batch, "hashes", "counts"), col(batch, "alone"), strict=True):
            if alone.is_valid:
                shared = ~np.isin((h & np.uint64(0x7FFFFFFF)).astype(np.int32), alone.values.to_numpy())
                rest, times = h[shared], n[shared]
            else:
                rest, times = h, n
            sizes.append(int(n.sum()))
            common.append(int(times.sum()))
            bins.append(np.bincount((rest & np.uint64(BINS - 1)).astype(np.int64), weights=times, minlength=BINS).astype(np.int32))
        yield pa.RecordBatch.from_arrays([col(batch, "node"), pa.array(sizes, pa.float64()), pa.array(common, pa.float64()), pa.array(bins, pa.list_(pa.int32()))], ["node", "size", "common", "bins"])


def shingle_sets(docs: DataFrame, rows: DataFrame, *, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes, counts) of the nodes of rows, each from the document that rows (node, id, text_key) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches, text_col, STEP):
            _tidy()
            sets = [shingles(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays([col(part, "node"), pa.array([s.view(np.int64) for s, _ in sets], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in sets], pa.list_(pa.int32()))], ["node", "hashes", "counts"])

    few = rows.count() <= BROADCAST_ROWS
    wanted = rows.select("node", F.col(id_col).alias("_id"), F.col("text_key").alias("_key"))
    keyed = docs.select(id_col, text_col, text_key(text_col).alias("text_key"))
    found = keyed.join(F.broadcast(wanted) if few else wanted, (F.col("text_key") == F.col("_key")) & F.col(id_col).eqNullSafe(F.col("_id")))
    return found.select("node", text_col).mapInArrow(run, "node binary, hashes array<long>, counts array<int>").dropDuplicates(["node"])


@dataclass
class Parameters:
    size: int = SHINGLE
    similarity: float = SIMILARITY
    bands: int = BANDS
    rows: int = ROWS


def links(docs: DataFrame, signs: DataFrame, p: Parameters, *, id_col: str, text_col: str) -> DataFrame:
    """(node, root): the classes of all nodes that have a link to another node. signs is what signed() gave, stored."""
    named = F.min(F.struct(F.col(id_col), F.col("text_key"))).alias("r")
    nodes = stored(signs.filter("shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"), named), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stored(members.join(shared, "key"), "members")
    central = stored(members.groupBy("node").agg(F.sum("n").alias("central")), "central")
    rows = stored(nodes.join(central, "node", "left_semi").select("node", f"r.{id_col}", "r.text_key"), "rows")
    drop(nodes, shared)
    sets = stored(shingle_sets(docs, rows, size=p.size, id_col=id_col, text_col=text_col), "sets")
    drop(rows)

    pivots = stored(members.join(central, "node").groupBy("key").agg(F.max(F.struct("central", "node")).alias("p")).select("key", F.col("p.node").alias("pivot")), "pivots")
    drop(central)
    pairs = members.join(pivots, "key").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    near = F.col("similarity") >= p.similarity
    first = stored(similarities(pairs, sets).filter(near), "linked")
    roots = components(first)

    # what is open: members outside the component of their bucket's pivot
    own = F.coalesce("root", "node")
    rooted = members.select("node", "key").join(roots, "node", "left").select("key", "node", own.alias("root"))
    at = pivots.join(roots, F.col("pivot") == F.col("node"), "left").select("key", "pivot", F.coalesce("root", "pivot").alias("pivot_root"))
    at = stored(at, "pivot-roots")
    rooted = stored(rooted.join(at, "key").withColumn("outside", F.col("root") != F.col("pivot_root")), "rooted")
    drop(members, pivots, at)
    open_keys = stored(rooted.filter("outside").select("key").distinct(), "open")
    all_rooted, rooted = rooted, stored(rooted.join(open_keys, "key").filter("node <> pivot"), "open-members")
    drop(all_rooted, open_keys)
    kept = sets.join(rooted.select("node").distinct(), "node", "left_semi")
    # 31 bits of a hash: shingles that fall together count as shared, which loosens the bound and keeps it true
    low = F.col("h").bitwiseAND(0x7FFFFFFF).cast("int").alias("h")
    alone = kept.select("node", F.explode("hashes").alias("h")).select("node", low).groupBy("h").agg(F.count("*").alias("n"), F.first("node").alias("node")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.collect_list("h").alias("alone"))
    sizes = kept.join(alone, "node", "left").mapInArrow(_profiles, "node binary, size double, common double, bins array<int>")
    # o >= s / (1 + s) * (|x| + |y|) must hold for a link, and o is at most the common shingles of either
    least_share = p.similarity / (1 + p.similarity) - 1e-9
    sizes = sizes.withColumn("cap", F.col("common") / least_share - F.col("size")).filter(F.col("cap") >= F.col("size") * p.similarity - 1e-6)
    sizes = stored(sizes, "sizes")
    open_ = rooted.select("key", "node", "root", "outside").join(sizes, "node")
    step = lambda x: F.floor(F.log(x) / float(np.log(SIZE_STEP))).cast("long")
    xs = open_.filter("outside").select("key", F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), F.col("cap").alias("x_cap"), F.col("bins").alias("x_bins"), F.explode(F.sequence(step(F.col("size") * p.similarity) - 1, step(F.greatest(F.col("cap"), F.lit(1.0))) + 1)).alias("class"))
    ys = open_.select("key", F.col("node").alias("y"), F.col("root").alias("y_root"), F.col("size").alias("y_size"), F.col("cap").alias("y_cap"), F.col("bins").alias("y_bins"), step(F.col("size")).alias("class"))
    fits = (F.col("x_root") != F.col("y_root")) & (F.col("y_size") <= F.col("x_cap")) & (F.col("x_size") <= F.col("y_cap"))
    shared_most = F.aggregate(F.zip_with("x_bins", "y_bins", lambda m, k: F.least(m, k)), F.lit(0), lambda n, k: n + k)
    fits = fits & (shared_most >= least_share * (F.col("x_size") + F.col("y_size")) - 1e-6)
    rest = xs.join(ys, ["key", "class"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = stored(rest, "rest")
    second = stored(similarities(rest, sets).filter(near), "linked")
    found = roots
    if second.limit(1).count():
        found = components(first.union(second))
        drop(roots)
    drop(rest, sizes, rooted, sets, first, second)
    return found


def _order(id_col: str) -> Column:
    """The order of a class's rows: null ids last."""
    return F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("text_key"))


def classes_of(docs: DataFrame, p: Parameters, *, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signs; (node, root) of every node; and of every root class_id, class_size and first (see _order); all stored."""
    signs = stored(signed(docs, size=p.size, bands=p.bands, rows=p.rows, id_col=id_col, text_col=text_col), "signs")
    found = links(docs, signs, p, id_col=id_col, text_col=text_col)
    # copies first: one row a node goes on
    one = signs.groupBy("node").agg(F.min(id_col).alias("least"), F.count("*").alias("n"), F.min(_order(id_col)).alias("first"))
    rooted = stored(one.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    drop(found)
    return signs, rooted, stored(rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min("first").alias("first")), "classes")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parameters: Parameters | None = None) -> DataFrame:
    """One row per row of docs: id, text_key, class_id (least id of the class), class_size, kept (it is the class's first row).

    A class holds the documents that chains of links join: equal shingle sets, or sets of similarity 0.8 or more. Null
    text counts as empty; texts without words are alike only if equal. Texts of fewer than five words are one shingle.
    Repeated rows belong to one class; kept marks the rows with the least (id, text_key), all of them where a row is
    repeated. Null ids are rows as others are; a class of null ids alone has a null class_id. Other columns are not read.
    """
    signs, rooted, classes = classes_of(docs, parameters or Parameters(), id_col=id_col, text_col=text_col)
    by_node = stored(rooted.select("node", "root").join(classes, "root").drop("root"), "by-node")
    drop(rooted, classes)
    rows = spread(signs.select(id_col, "text_key", "node", "slot"), by_node, "node", F.col("slot"))
    found = stored(rows.select(id_col, "text_key", "class_id", "class_size", (_order(id_col) == F.col("first")).alias("kept")), "near-copies")
    drop(signs, by_node)
    return found


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parameters: Parameters | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class; one row of each class."""
    id_, key, mine, nth = (f"__near_copies_{c}" for c in ("id", "key", "mine", "nth"))  # docs may have any columns
    signs, rooted, classes = classes_of(docs, parameters or Parameters(), id_col=id_col, text_col=text_col)
    drop(signs, rooted)
    kept = classes.select(F.col(f"first.{id_col}").alias(id_), F.col("first.text_key").alias(key))
    keyed = docs.withColumn(mine, text_key(text_col))
    # the kept rows are as many as the classes: they are merged at every size, and never broadcast
    found = keyed.join(kept.hint("merge"), (keyed[mine] == kept[key]) & keyed[id_col].eqNullSafe(kept[id_]), "left_semi")
    w = Window.partitionBy(mine, id_col).orderBy(F.lit(1))
    return found.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).select(*docs.columns)
