"""Phrases (collocations) by multikey quicksort of suffix pointers.

1. Words are counted, a sum for each task and word first. A bitmap of fixed size marks the frequent ones by hash; a wrongly set bit only lets more through.
2. Neighbouring frequent words are counted by a hash of the pair, which gives a second bitmap, and triples of marked pairs
   likewise. A suffix starts at every word that begins a marked pair and goes on for at most LONGEST words of its piece
   while every three in a row are marked: nothing else can lie in a frequent phrase, and most suffixes end behind their
   pair. Equal suffixes of a task become one row with a count. As every task meets the same frequent pairs, there is one long task
   for each core, which forgets rare words to keep on summing up, not one for each split.
3. Suffixes are routed by ranges of their leading words, so that every task has about RANGE_ROWS of them, however
   often a word or a phrase occurs. Each task sorts pointers to its suffixes by multikey three-way quicksort: partitions of
   equal words give the counts, those under the limit are abandoned. Only phrases that a range's first or last suffix starts with can be cut by
   the range's edge; their parts are added up afterwards.
4. Counts of phrases and words are joined to every cut of every candidate. All arithmetic is in integers or decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.common import claim, col, drop, mixed, small_batches, stored, text_steps

LONGEST, LEAST, SCALE, PER_LANG = 5, 100, 1000, 2000
UNKNOWN = "und"
#: Bits of the bitmaps of frequent words, pairs and triples: 8 MB each, whatever the corpus.
BITS = 1 << 26
#: Words of the longest runs that are counted before suffixes are made.
COUNTED = 3
#: Distinct words, runs and suffixes that a task keeps before it hands on their counts.
KEPT_WORDS, KEPT_ROWS = 500_000, 1_500_000
#: Words of text that a task reads at most where each core has but one task.
TASK_WORDS = 50_000_000
#: Suffixes that a task sorts.
RANGE_ROWS = 200_000
#: Languages up to which their totals are broadcast.
MOST_LANGS = 10_000
#: Tasks over which a language's phrases are dealt before the last ranking.
SLOTS = 32
_TABLE = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256)).translate(bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n "))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Codes of an empty run between blanks and of a piece's end; words come behind them.
_EMPTY, _END = 0, 1


class Words(dict):
    """A task's words of one language: bytes to numbers in order of first sight."""

    def __init__(self) -> None:
        super().__init__({b"": _EMPTY, b"\n": _END})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def codes(self, text: str) -> np.ndarray:
        """The words of a text of pieces; _END stands between pieces."""
        parts = text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        return ids[ids != _EMPTY]

    def texts(self, first: int = 0) -> list[bytes]:
        return list(self)[first:]


def split_words(text: str) -> list[list[str]]:
    """The pieces of one text with their words: what the array code below does, for tests and small uses."""
    words = Words()
    out: list[list[str]] = [[]]
    ids = words.codes(text)
    names = [w.decode() for w in words.texts()]
    for i in ids:
        if i == _END:
            out.append([])
        else:
            out[-1].append(names[i])
    return [p for p in out if p]


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    """As Spark's xxhash64(lang, word)."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def bitmap_of(hashes: DataFrame, name: str) -> np.ndarray:
    """A bitmap (BITS bits) of a column of 64-bit hashes. The driver gets one row for each of its words of 64 bits that is not empty: at most BITS / 64 rows of 16 bytes."""
    place = F.pmod(F.col(name), F.lit(BITS))
    rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({name}, {BITS}) & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _GOLD + b)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(language, texts joined by a piece's end) of bounded size."""
    for part, texts in text_steps(batches):
        langs = [UNKNOWN if x is None else x for x in col(part, "lang").to_pylist()]
        for lang in dict.fromkeys(langs):
            yield lang, "\n".join(t for t, x in zip(texts, langs, strict=True) if x == lang)


def _texts(docs: DataFrame, tasks: int = 0) -> DataFrame:
    """lang, text, in that many tasks at most (0: one for each split)."""
    out = small_batches(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    return out.coalesce(tasks) if tasks else out


def few_tasks(docs: DataFrame, words: int = 0) -> int:
    """Tasks in which to sum up what is frequent in so many words: one for each core, as every task hands on its own sum of the same few things, but more where one would have TASK_WORDS."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-words // TASK_WORDS))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word), a (long): how often each word occurs. Tasks hand on sums; null texts count as empty, null languages as `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("phrases")
        held: dict[str, tuple[Words, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (words, counts) in held.items():
                at = np.flatnonzero(counts[_END + 1 :])
                texts = words.texts(_END + 1)
                for i in range(0, len(at), 50_000):
                    now = at[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(now), pa.string()), pa.array([texts[j].decode() for j in now], pa.string()), pa.array(counts[now + _END + 1])], ["lang", "phrase", "a"])
            held.clear()

        for lang, text in by_language(batches):
            words, counts = held.get(lang) or (Words(), np.zeros(0, np.int64))
            new = np.bincount(words.codes(text), minlength=len(words))
            new[: len(counts)] += counts
            held[lang] = (words, new)
            if sum(len(w) for w, _ in held.values()) > KEPT_WORDS:
                yield from out()
        yield from out()

    return _texts(docs).mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


class _Seen:
    """A task's words of one language with their hashes and whether they are frequent."""

    def __init__(self, lang: str, frequent: np.ndarray) -> None:
        self.lang, self.frequent, self.words = lang, frequent, Words()
        self.hashes, self.often = np.zeros(_END + 1, np.uint64), np.zeros(_END + 1, bool)

    def codes(self, text: str) -> np.ndarray:
        ids = self.words.codes(text)
        if len(self.words) > len(self.hashes):
            new = _hashes(self.words.texts(len(self.hashes)), self.lang)
            self.hashes, self.often = np.concatenate([self.hashes, new]), np.concatenate([self.often, marked(self.frequent, new)])
        return ids

    def shed(self) -> np.ndarray:
        """Forgets the words that are not frequent. Returns the new numbers of the others by their old ones."""
        keep = self.often.copy()
        keep[: _END + 1] = True
        texts, self.words = self.words.texts(), Words()
        for i in np.flatnonzero(keep):
            self.words[texts[i]]
        self.hashes, self.often = self.hashes[keep], self.often[keep]
        return np.cumsum(keep) - 1

    def runs(self, ids: np.ndarray, maps: list[np.ndarray], open_end: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, hashes) of the runs of two words and more that are marked, as are all their parts: a length for each bitmap, and with open_end one more, whose parts alone are marked."""
        words = self.hashes[ids]
        ok, hashes = self.often[ids], words
        for bitmap in [*maps, None] if open_end else maps:
            start = np.flatnonzero(ok[:-1] & ok[1:])
            longer = pair_hashes(hashes[start], words[start + len(words) - len(ok) + 1])
            ok, hashes = np.zeros(len(ok) - 1 if len(ok) else 0, bool), np.zeros(len(ok) - 1 if len(ok) else 0, np.uint64)
            if bitmap is not None:
                good = marked(bitmap, longer)
                start, longer = start[good], longer[good]
            ok[start], hashes[start] = True, longer
            yield start, longer


def run_counts(docs: DataFrame, maps: list[np.ndarray], tasks: int = 0) -> DataFrame:
    """h (hash of a run of words and its language), c: how often it occurs. maps: bitmaps of the frequent words, pairs and so on; runs are a word longer than those of the last one, and their parts are marked.

    Runs of three and more are counted in `tasks` tasks (0: few_tasks); most pairs are rare and occur in one task, however many there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("phrases")
        seen: dict[str, _Seen] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["h", "c"])

        for lang, text in by_language(batches):
            if sum(len(x.words) for x in seen.values()) > KEPT_WORDS:
                seen.clear()
            if lang not in seen:
                seen[lang] = _Seen(lang, shared.value[0])
            own = seen[lang]
            *_, (_, hashes) = own.runs(own.codes(text), shared.value[1:], open_end=True)
            held.append(np.unique(hashes, return_counts=True))
            if sum(len(k) for k, _ in held) > KEPT_ROWS:
                held = [merged()]
                if len(held[0][0]) > KEPT_ROWS // 2:
                    yield from out(*held.pop())
        if held:
            yield from out(*merged())

    return _texts(docs, (tasks or few_tasks(docs)) if len(maps) > 1 else 0).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def same_rows(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers below 2^31, with the sums of their counts."""
    key = rows[:, 0]
    for j in range(1, rows.shape[1]):
        key = np.unique(key * (1 << 31) + rows[:, j], return_inverse=True)[1]
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], np.bincount(at, counts).astype(np.int64)


_W = tuple(f"w{i}" for i in range(1, LONGEST + 1))


def suffixes(docs: DataFrame, maps: list[np.ndarray], tasks: int = 0) -> DataFrame:
    """lang, w1 to w5 (null behind the end), c: the suffixes of two words and more whose runs are marked in maps (of frequent words, pairs and so on), equal ones of a task together. tasks: as in run_counts."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("phrases")
        seen: dict[str, _Seen] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            return same_rows(np.concatenate([r for r, _ in held[lang]]), np.concatenate([c for _, c in held[lang]]))

        def full(part: int = 1) -> bool:
            return sum(len(r) for x in held.values() for r, _ in x) > KEPT_ROWS // part or sum(len(x.words) for x in seen.values()) > KEPT_WORDS // part

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            rows, counts = merged(lang)
            texts = np.array([None, None, *(w.decode() for w in seen[lang].words.texts(_END + 1))], object)
            for i in range(0, len(rows), 50_000):
                now = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(now), pa.string()), *(pa.array(texts[now[:, j]], pa.string()) for j in range(LONGEST)), pa.array(counts[i : i + 50_000])], ["lang", *_W, "c"])

        for lang, text in by_language(batches):
            if lang not in seen:
                seen[lang] = _Seen(lang, shared.value[0])
            own = seen[lang]
            ids = own.codes(text)
            ok = [np.zeros(len(ids) + LONGEST, bool) for _ in shared.value[1:]]
            for n, (at, _) in enumerate(own.runs(ids, shared.value[1:])):
                ok[n][at] = True
            start = np.flatnonzero(ok[0])
            rows = np.zeros((len(start), LONGEST), np.int64)
            rows[:, 0], rows[:, 1] = ids[start], ids[start + 1]
            going = np.ones(len(start), bool)
            for j in range(2, LONGEST):
                n = min(j, len(ok))  # the longest marked run that ends with this word has n + 1 words
                going &= ok[n - 1][start + j - n]
                rows[going, j] = ids[start[going] + j]
            held.setdefault(lang, []).append(same_rows(rows, np.ones(len(rows), np.int64)))
            if full():
                for x, at in seen.items():
                    rows, counts = merged(x)
                    held[x] = [(at.shed()[rows], counts)]  # suffixes hold frequent words alone
                if full(part=2):
                    for x in held:
                        yield from out(x)
                    held.clear()
                    seen.clear()
        for x in held:
            yield from out(x)

    return _texts(docs, tasks or few_tasks(docs)).mapInArrow(run, ", ".join(["lang string", *(f"{w} string" for w in _W), "c long"]))


def quicksort_counts(symbols: np.ndarray, counts: np.ndarray, least: int, edges: list[int]) -> Iterator[tuple[int, int, int]]:
    """(a row that starts so, number of symbols, count) of the prefixes that occur `least` times, by multikey three-way quicksort of pointers to the rows.

    symbols: rows of symbols, negative ones behind the end. Prefixes of the rows in edges are given at any count.
    """
    edge = np.zeros(len(symbols), bool)
    edge[edges] = True
    work = [(np.arange(len(symbols)), 0)]
    while work:
        rows, depth = work.pop()
        if not len(rows) or (counts[rows].sum() < least and not edge[rows].any()):
            continue  # whatever lies in here is too rare
        now = symbols[rows, depth]
        pivot = np.sort(now[[0, len(now) // 2, -1]])[1]
        equal = rows[now == pivot]
        total = int(counts[equal].sum())
        if pivot >= 0 and (total >= least or edge[equal].any()):
            yield int(equal[0]), depth + 1, total
            if depth + 1 < symbols.shape[1]:
                work.append((equal, depth + 1))
        work.append((rows[now < pivot], depth))
        work.append((rows[now > pivot], depth))


def _first_and_last(symbols: np.ndarray) -> list[int]:
    """The rows that come first and last in order of symbols."""
    out = []
    for pick in (np.min, np.max):
        at = np.arange(len(symbols))
        for j in range(symbols.shape[1]):
            now = symbols[at, j]
            at = at[now == pick(now)]
        out.append(int(at[0]))
    return out


def phrase_counts(found: DataFrame, least: int = LEAST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """lang, phrase, words (how many), a of the phrases of two words and more that occur `least` times, from a stored table of suffixes.

    A task holds its range of suffixes: pointers and numbers of words. Ranges come from a sample of the rows that Spark takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        columns = [c.combine_chunks() for c in table.select(["lang", *_W]).columns]
        names = pc.unique(pa.chunked_array(columns)).drop_null()
        names = names.take(pc.sort_indices(pc.cast(names, pa.binary())))  # in order of bytes, as the ranges are
        symbols = np.stack([pc.fill_null(pc.index_in(c, names), -1).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        texts, counts = names.to_pylist(), table.column("c").to_numpy()
        rows: list[tuple[str, str, int, int]] = []
        for row, n, total in quicksort_counts(symbols, counts, least, _first_and_last(symbols)):
            if n > 2:  # the language is the first symbol
                lang, *words = (texts[s] for s in symbols[row, :n])
                rows.append((lang, " ".join(words), n - 1, total))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "phrase", "words", "a"])

    ranges = max(1, -(-found.count() // range_rows))
    routed = found.repartitionByRange(ranges, *(F.col(c).asc_nulls_first() for c in ("lang", *_W))) if ranges > 1 else found.coalesce(1)
    return routed.mapInArrow(run, "lang string, phrase string, words long, a long").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (lang, phrase, words, a) with l, r, n and score of their lowest cut; ties go to the shorter first part."""
    counts = phrases.select("lang", "phrase", "a").unionByName(words.select("lang", "phrase", "a"))
    parts = F.split("phrase", " ", -1)
    cut = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))).alias("k"))
    cut = cut.withColumns({"_l": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "_r": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words").cast("int")), " ")})
    for side in ("l", "r"):
        own = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias(side))
        cut = cut.join(own, (F.col("lang") == F.col("_lang")) & (F.col(f"_{side}") == F.col("_part"))).drop("_lang", "_part")
    few = totals.count() <= MOST_LANGS
    cut = cut.join(F.broadcast(totals) if few else totals, "lang")
    # 30 and 27 digits at ten trillion words, of 38; whole division drops the rest
    cut = cut.withColumn("score", F.expr(f"(cast(a * {SCALE} AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))"))
    best = F.min(F.struct("score", "k", "l", "r", "n")).alias("b")
    return cut.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "b.l", "b.r", "b.n", "b.score")


def not_inside_longer(rows: DataFrame, phrases: DataFrame, percent: int = 100) -> DataFrame:
    """rows without those whose words lie inside a longer phrase that occurs at least percent/100 times as often.

    One word more is enough to look at: what lies between a phrase and a longer one occurs at least as often as the longer one.
    """
    parts = F.split("phrase", " ", -1)
    n = F.col("words").cast("int")
    ends = F.array(F.array_join(F.slice(parts, F.lit(1), n - 1), " "), F.array_join(F.slice(parts, F.lit(2), n - 1), " "))
    longer = phrases.filter("words > 2").select(F.col("lang").alias("_lang"), F.explode(ends).alias("_inner"), F.col("a").alias("_a")).groupBy("_lang", "_inner").agg(F.max("_a").alias("_most"))
    joined = rows.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_inner")), "left")
    return joined.filter(F.coalesce(100 * F.col("_most") < percent * F.col("a"), F.lit(True))).select(*rows.columns)


def collocations(docs: DataFrame, *, least: int = LEAST, per_lang: int = PER_LANG) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's per_lang best phrases of 2 to 5 words that occur at least `least` times.

    docs needs text and lang. A-Z count as a-z; texts are cut at `[.,;:!?]` and line ends into pieces, and those at blanks and tabs into words. Null
    texts are empty, null languages are `und`, repeated rows count each time, very long texts are read whole, an empty table gives no rows, and
    other columns are not read. Ties of score go to the greater count, then to the lesser phrase by bytes, so ranks are unique.
    """
    words = stored(word_counts(docs), "words")
    often = words.filter(F.col("a") >= least)
    maps = [bitmap_of(often.select(F.xxhash64("lang", "phrase").alias("h")), "h")]
    tasks = few_tasks(docs, words.agg(F.sum("a")).first()[0] or 0)
    while len(maps) < COUNTED:
        maps.append(bitmap_of(run_counts(docs, maps, tasks).filter(F.col("c") >= least).select("h"), "h"))
    found = stored(suffixes(docs, maps, tasks), "suffixes")
    phrases = stored(phrase_counts(found, least), "phrases")
    drop(found)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    kept = not_inside_longer(scored(phrases, often, totals), phrases)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # in two steps, so that no task ranks all phrases of a language
    dealt = kept.withColumn("_slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)))
    first = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slot").orderBy(*order))).filter(F.col("_rank") <= per_lang)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= per_lang)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
