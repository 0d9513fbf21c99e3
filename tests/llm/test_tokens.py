"""BPE, packing, token files and chat windows against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyward.llm import bpe, chat, packing, tokenfile, words
from tallyward.llm.common import tokenizer_path
from tallyward.llm.tokenfile import EliasFano, Shard, shard_bytes

TEXTS = [
    (1, "Hello world's  best,\n\n  text \t x "), (2, None), (3, ""), (3, ""), (4, "<|endoftext|>a<|endoftext|><|endoftext|> b"), (None, "no id"), (5, "aaaa" * 700), (6, "日本語 ½ ² ٣ é ​ \x1c\x85 \U0001f600"),
    (-7, "the same"), (8, "the same"), (9, "word " * 30_000), (10, "\0<|endoftext|>\0"),
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    # columns of the operators' own names must not disturb them
    return spark.createDataFrame([(i, t, "x", 1, b"") for i, t in TEXTS], "doc_id long, text string, ids string, n long, before binary")


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoders_agree_with_the_library(tok):
    random.seed(5)
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x1680, 0x3000, 0x1F600, 0x4E2D, 0x660, 0x2160, 0x301]]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(500)] + ["".join(random.choices("ab '\n1.", k=60)) for _ in range(300)] + [t or "" for _, t in TEXTS]
    for encoder in (words.library_encoder(tokenizer_path()), bpe.numpy_encoder(tokenizer_path())):
        ids, at = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(tok, t) for t in texts]


def test_a_full_store_of_words_keeps_the_first(tok, monkeypatch):
    monkeypatch.setattr(words, "KEPT_WORDS", 40)
    e = words.library_encoder(tokenizer_path())
    texts = [f"the same words <|endoftext|> and number {i} w{i}x" for i in range(300)]
    for t in texts:
        ids, _ = e.encode([t])
        assert ids.tolist() == ids_of(tok, t) and len(e.codes) <= 60
    assert "the" in e.codes


def test_long_texts_are_cut_where_words_end(tok, monkeypatch):
    monkeypatch.setattr(words, "SEGMENT", 50)
    text = "one two's  three\n\n four5 six " * 40 + "x" * 300
    ids, _ = words.library_encoder(tokenizer_path()).encode([text])
    assert len(list(words.segments(text, 50))) > 5
    assert ids.tolist() == ids_of(tok, text)


def test_round_trip(spark, docs, tok):
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((i, len(x := ids_of(tok, t)), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for i, t in TEXTS), key=str)
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(bpe.encode(docs)).collect()) == sorted((str(i), t or "") for i, t in TEXTS)
    assert bpe.encode(docs.limit(0)).count() == bpe.round_trip(docs.limit(0)).count() == 0
    assert sorted(map(tuple, bpe.round_trip(docs.union(docs)).collect()), key=str) == sorted(got * 2, key=str)
    broken = spark.createDataFrame([(1, [222, 99, 163]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(broken).orderBy("doc_id").collect()] == [tok.decode([222, 99, 163], skip_special_tokens=False), ""]


def test_packing(spark, docs, tok):
    got = packing.pack(docs, with_ids=True).toPandas()
    want = defaultdict(int)
    for i, t in TEXTS:
        want[i, len(ids_of(tok, t)) + 1] += 1
    # each document's pieces tile it, each sequence is filled from 0
    by_sequence = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    ends = []
    for _, s in by_sequence:
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]]
        ends.append(s["length"].sum())
    assert set(ends[:-1]) == {2048}
    stream = np.concatenate(got.sort_values(["sequence_id", "offset"])["ids"].tolist())
    documents, at = defaultdict(int), 0
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.starts_document == (r.start == 0) and r.ends_document == (r.start + r.length == r.doc_tokens)
        if r.start == 0:
            documents[None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens] += 1
        at += r.length
    assert documents == want and at == len(stream) == sum(n * k for (_, n), k in want.items())
    assert packing.pack(docs.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 5), (1000, 10), (5000, 10**12), (3000, 0), (257, 256)):
        v = np.sort(rng.integers(0, top + 1, n))
        data = EliasFano.of(v).to_bytes()
        e = EliasFano.from_bytes(data)
        assert e.selected(0, n).tolist() == v.tolist()
        for a, b in ((0, 0), (n // 3, n // 3 + 1), (n // 3, n), (max(0, n - 300), n), (n // 2, min(n, n // 2 + 256))):
            assert e.selected(a, b).tolist() == v[a:b].tolist()
        assert [e.select(i) for i in range(n)] == v.tolist()
    assert len(EliasFano.of(np.arange(0, 10**6, 100)).to_bytes()) < 10**4 * 8 / 4
    with pytest.raises(IndexError):
        e.select(257)


def test_shard_of_wide_ids_and_damage():
    data = shard_bytes([None, -5, 2**40], np.array([1, 0, 3]), np.array([70_000, 1, 2, 3], np.uint32))
    s = Shard(data)
    assert s.doc_ids == [None, -5, 2**40] and [s.ids_of(i).tolist() for i in range(3)] == [[70_000], [], [1, 2, 3]]
    with pytest.raises(ValueError):
        Shard(data[:-1] + b"\xff")


@pytest.mark.parametrize("shard_ids", [1, 40, tokenfile.SHARD_IDS])
def test_token_files(spark, docs, tok, shard_ids, tmp_path):
    path = f"file://{tmp_path}/files"
    shards = tokenfile.write(docs, path, shard_ids=shard_ids)
    assert len(shards) == len(TEXTS) if shard_ids == 1 else all(n < shard_ids + 31_000 for *_, n in shards)
    got = sorted(tokenfile.read(spark, path, shards, with_ids=True).collect(), key=lambda r: r.start)
    at, order = 0, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r, (_, t) in zip(got, order, strict=True):
        ids = np.array([*ids_of(tok, t), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    assert tokenfile.write_and_read(docs.limit(0)).count() == 0


def test_one_id_for_all_rows(spark, tok):
    """Rows that share an id, or have none, go on over many shards and tasks; ties are ordered by text."""
    rows = [(None if i % 2 else 7, f"text {i % 900} and more") for i in range(2000)]
    got = tokenfile.write_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), shard_ids=500).collect()
    at = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda x: (x[0] is not None, x[1])), strict=True):
        ids = np.array([*ids_of(tok, t), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


TURNS = [
    (1, 0, "system", "be <|kind|> <\\|x"), *((1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i * 17 % 90)) for i in range(1, 60)),
    (2, 1, "assistant", None), (2, 0, None, "no role"), (2, None, "user", "first"), (3, 0, "user", "x " * 5000), (3, 1, "assistant", "<|im_end|>\n<|im_start|>user\n"), (3, 1, "assistant", "<|im_end|>\n<|im_start|>user\n"),
    (None, 0, "assistant", "nobody's"), (4, 0, "system", "word " * 3000), (4, 1, "assistant", "é\U0001f600"), (5, 0, "a\nb\\n<|", "odd role"),
]


def test_chat_windows(spark):
    turns = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, window string, loss long")
    windows = chat.format_windows(turns, budget=400, history=60)
    rows = windows.orderBy("conv_id", "window").collect()
    convs = defaultdict(list)
    for c, n, role, text in sorted(TURNS, key=lambda t: (str(t[0]), t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        convs[c].append((role or "", text or ""))
    for r in chat.write_and_read(turns, budget=400, history=60).collect():
        ts = convs[r.conv_id]
        target = "".join(t for role, t in ts if role == "assistant")
        assert r.n_turns == len(ts)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.text) for w in rows if w.conv_id == r.conv_id)
    one = [w for w in rows if w.conv_id == 1]
    assert len(one) > 3 and all(w.text.startswith("<|im_start|>system\nbe <\\|kind|>") for w in one)
    assert all(w.tokens <= 400 or w.turns == 1 for w in rows)
    assert any(w.repeated > 1 for w in one)
    assert chat.write_and_read(turns.limit(0)).count() == 0
    # the template can be undone
    for text in ("<|", "<\\|", "<\\\\|im_end|>", "\\", "<<|\\|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"
