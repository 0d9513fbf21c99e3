"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. Each round looks
up every neighbouring pair by binary search over the sorted pair keys, takes
each word's lowest rank, and merges all places of that pair in the word, from
the left where they overlap. (In a well-formed vocabulary a pair that holds a
merged symbol ranks behind the merge that made it, so merging all places at once
equals merging them one after another.) Words without a further pair leave.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyward.llm.common import col, small_batches, text_steps, tokenizer_path
from tallyward.llm.words import WordEncoder, added_tokens, held_encoder

_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class MergeTable:
    """A vocabulary file as arrays: sorted pair keys with rank and merged id, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, letters = data["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.base = np.array([vocab[x] for x in letters], np.int64)
        self.size = max([*vocab.values(), *(x["id"] for x in data["added_tokens"])]) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        back = {x: bytes([b]) for b, x in enumerate(letters)}
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = b"".join(back[x] for x in token)
        for x in data["added_tokens"]:
            self.pieces[x["id"]] = x["content"].encode()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per word), word after word."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            rank = np.full(len(flat), _NONE)
            key = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(0, np.int64)
            if len(self.keys):
                hit = (word[:-1] == word[1:]) & (self.keys[at] == key)
                rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff([*first, len(flat)]))
            open_ = lowest < _NONE
            if not open_.all():
                done.append((flat[~open_], word[~open_]))
            places = np.flatnonzero(open_ & (rank == lowest))
            if not len(places):
                break
            # of neighbouring places (a pair of like symbols in a row) every second one, from the left
            run = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
            nth = np.arange(len(places)) - np.repeat(run, np.diff([*run, len(places)]))
            places = places[nth % 2 == 0]
            flat[places] = self.merged[at[places]]
            keep = open_
            keep[places + 1] = False
            flat, word = flat[keep], word[keep]
        if not done:
            return np.empty(0, np.int32), lens
        flat, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return flat[order].astype(np.int32), np.bincount(word, minlength=len(raw)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_tables: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def numpy_encoder(path: str) -> WordEncoder:
    return WordEncoder(merge_table(path).encode_words, added_tokens(path))


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (array of int).

    Null text counts as empty and gives no ids. Repeated rows and null ids stay, a row each; other columns are
    not read. Texts of any length are whole: they are cut into segments only where a word ends.
    """
    path = path or tokenizer_path()
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(path, "numpy")
        for part, texts in text_steps(batches, text_col):
            ids, at = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([col(part, id_col), pa.array(np.diff(at)), lists], [id_col, "n_tokens", "ids"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, *, id_col: str = "doc_id") -> DataFrame:
    """One row per row of encoded (id, ids): id and text. Null ids count as none; ids outside the vocabulary raise an error."""
    path = path or tokenizer_path()
    schema = f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merge_table(path)
        for batch in batches:
            ids = [np.asarray(x.values if x.is_valid else [], np.int64) for x in col(batch, "ids")]
            yield pa.RecordBatch.from_arrays([col(batch, id_col), pa.array([merges.decode(x) for x in ids], pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and returns digests, so that neither ids nor texts leave the task.

    id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8). One row per row, so
    repeated rows give repeated rows, and null ids stay. Null text is empty; an empty text has no ids and the digests of
    nothing. Very long texts are encoded whole. An empty table gives no rows; other columns are not read.
    """
    path = path or tokenizer_path()
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, merges = held_encoder(path, "numpy"), merge_table(path)
        for part, texts in text_steps(batches, text_col):
            ids, at = encoder.encode(texts)
            ids = ids.astype("<u4")
            each = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            digests = [[hashlib.sha256(x).hexdigest() for x in each], [hashlib.sha256(merges.decode(x).encode()).hexdigest() for x in each]]
            yield pa.RecordBatch.from_arrays([col(part, id_col), pa.array(np.diff(at)), *(pa.array(x, pa.string()) for x in digests)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
