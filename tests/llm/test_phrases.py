"""Phrases against brute force by definition, and the quicksort by itself."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tallyward.llm import phrases


def brute(docs, least, per_lang):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        inside = any(x == lang and len(q) > len(p) and a <= b and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in cands.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    rows = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:per_lang]
        rows += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return rows


def some_docs():
    rng = random.Random(4)
    words = ["a", "B", "é", "c'", "\x01d", "x-y", "zz", "ü", "\x85q", "the", "of", "THE"]
    out = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", "\r\n", "!"]) for _ in range(rng.randrange(80)))) for _ in range(120)]
    return [*out, ("en", None), (None, ""), ("fr", "..!"), *[("es", "one very same line of text again")] * 60, ("en", "of the " * 4000), ("und", "a B a B"), ("", "a a a a")]


def test_collocations_equal_brute_force(spark):
    docs = some_docs()
    df = spark.createDataFrame([(lang, text, "c", 1, "p") for lang, text in docs], "lang string, text string, _c string, a int, phrase string").repartition(7)
    for least, per_lang in ((20, 2000), (8, 15)):
        got = [tuple(r) for r in phrases.collocations(df, least=least, per_lang=per_lang).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert sorted(got) == sorted(brute(docs, least, per_lang))
    assert phrases.collocations(df.limit(0)).count() == 0


def test_ranges_and_flushes_change_nothing(spark, monkeypatch):
    docs = some_docs()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    words = phrases.word_counts(df).filter("a >= 8")
    maps = [phrases.bitmap_of(words.selectExpr("xxhash64(lang, phrase) AS h"), "h")]
    key = lambda x: sorted(map(tuple, x.collect()))
    want, made = None, []
    for _ in range(phrases.LONGEST - 1):
        maps.append(phrases.bitmap_of(phrases.run_counts(df, maps).filter("c >= 8").select("h"), "h"))
        found = phrases.stored(phrases.suffixes(df, maps), "suffixes")
        made.append(found.count())
        want = want or key(phrases.phrase_counts(found, 8))
        assert want and key(phrases.phrase_counts(found, 8, range_rows=40)) == want
    assert made == sorted(made, reverse=True) and made[1] < made[0]  # counted triples end most suffixes
    monkeypatch.setattr(phrases, "KEPT_ROWS", 300)
    assert key(phrases.phrase_counts(phrases.stored(phrases.suffixes(df, maps[:3]), "suffixes"), 8)) == want


def test_suffixes_do_not_grow_with_partitions_or_rare_words(spark, monkeypatch):
    cores, least = spark.sparkContext.defaultParallelism, 8
    docs = [("en", f"one very same line of text, here and there in every part of it; rare{i} x{i}y z{i}") for i in range(40 * cores)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(8 * cores)
    words = phrases.word_counts(df).filter(f"a >= {least}")
    maps = [phrases.bitmap_of(words.selectExpr("xxhash64(lang, phrase) AS h"), "h")]
    while len(maps) < phrases.COUNTED:
        maps.append(phrases.bitmap_of(phrases.run_counts(df, maps).filter(f"c >= {least}").select("h"), "h"))
    keys = ["lang", *phrases._W]
    key = lambda x: sorted(map(tuple, x.groupBy(*keys).sum("c").collect()), key=str)
    found = phrases.stored(phrases.suffixes(df, maps), "suffixes")
    want, distinct = key(found), found.select(*keys).distinct().count()
    assert distinct > 10 and sum(x[-1] for x in want) == 12 * len(docs)
    assert found.count() <= cores * distinct  # not once for each partition
    monkeypatch.setattr(phrases, "KEPT_WORDS", 60)  # rare words go, suffixes stay
    monkeypatch.setattr(phrases, "text_steps", lambda batches: ((b.slice(i, 1), [b.column(1)[i].as_py()]) for b in batches for i in range(b.num_rows)))
    found = phrases.stored(phrases.suffixes(df, maps), "suffixes")
    assert key(found) == want and found.count() <= cores * distinct
    monkeypatch.setattr(phrases, "KEPT_WORDS", 9)  # the frequent ones alone are too many
    assert key(phrases.suffixes(df, maps)) == want
    assert phrases.few_tasks(df) == phrases.few_tasks(df, phrases.TASK_WORDS) == cores
    assert phrases.few_tasks(df, 3 * cores * phrases.TASK_WORDS + 1) == 3 * cores + 1


def test_words_that_are_shed_get_new_numbers():
    words = [b"w%d" % i for i in range(9)]
    bitmap = np.zeros(phrases.BITS // 64, np.uint64)
    for h in phrases._hashes(words[::2], "en"):
        bitmap[int(h & np.uint64(phrases.BITS - 1)) >> 6] |= np.uint64(1) << (h & np.uint64(63))
    own = phrases._Seen("en", bitmap)
    before = own.codes("w0 w1 w2 w3 w4 w5 w6 w7 w8").tolist()
    new = own.shed()
    assert list(own.words) == [b"", b"\n", *words[::2]] and new[0] == 0
    assert own.codes("w8 w1 w0 w2\nw4").tolist() == [new[before[8]], len(own.words) - 1, new[before[0]], new[before[2]], phrases._END, new[before[4]]]
    assert len(own.hashes) == len(own.often) == len(own.words) and own.often.tolist() == [False] * 2 + [True] * 5 + [False]


def test_runs_are_those_whose_parts_are_marked():
    rng = np.random.default_rng(3)
    maps = [np.zeros(phrases.BITS // 64, np.uint64) for _ in range(3)]
    words = [b"w%d" % i for i in range(6)]
    own = phrases._Seen("en", maps[0])
    hashes = phrases._hashes(words, "en")

    def mark(bitmap, h):
        bitmap[int(h & np.uint64(phrases.BITS - 1)) >> 6] |= np.uint64(1) << (h & np.uint64(63))

    for h in hashes[:5]:
        mark(maps[0], h)
    for i in range(5):
        for j in range(5):
            if (i + j) % 3:
                mark(maps[1], phrases.pair_hashes(hashes[i : i + 1], hashes[j : j + 1])[0])
    for n in (0, 1, 2, 3, 40):
        seq = rng.integers(0, 6, n).tolist()
        ids = own.codes(" ".join(f"w{i}" for i in seq))
        (pairs, _), (triples, got) = own.runs(ids, maps[1:2], open_end=True)
        good = [i for i in range(n - 1) if max(seq[i], seq[i + 1]) < 5 and (seq[i] + seq[i + 1]) % 3]
        assert pairs.tolist() == good
        assert triples.tolist() == [i for i in good if i + 1 in good]
        both = [(seq[i], seq[i + 1], seq[i + 2]) for i in triples]
        assert len(set(got.tolist())) == len(set(both))


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=4), min_size=1, max_size=60), st.integers(1, 9))
def test_quicksort_counts(rows, least):
    symbols = np.full((len(rows), 4), -1)
    for i, r in enumerate(rows):
        symbols[i, : len(r)] = r
    counts = np.arange(len(rows)) % 3 + 1
    got = {tuple(symbols[i, :n].tolist()): total for i, n, total in phrases.quicksort_counts(symbols, counts, least, [])}
    want = Counter()
    for r, c in zip(rows, counts.tolist(), strict=True):
        for n in range(1, len(r) + 1):
            want[tuple(r[:n])] += c
    assert got == {k: v for k, v in want.items() if v >= least}


def test_hashes_agree_with_spark(spark):
    words = ["the", "é", "", "x" * 100]
    df = spark.createDataFrame([("en", w) for w in words], "lang string, w string").selectExpr("w", "xxhash64(lang, w) AS h")
    got = {r.w: r.h for r in df.collect()}
    assert [got[w] for w in words] == phrases._hashes([w.encode() for w in words], "en").view(np.int64).tolist()
