"""Texts to token ids by way of their distinct words: the pattern of byte-level BPE cuts a text into words, no merge crosses a word, and so each distinct word of a task is encoded once."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import regex

from tallyward.llm.common import claim, gather

#: White space by Unicode's property, as the tokenizers library takes \s (Python's \s also holds four separators of ASCII).
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CAREFUL = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + "]+"
)
#: For texts of these characters alone, where Python's classes agree with the above, the faster engine serves.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ]")
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
#: Characters of one text that are cut into words at once, and distinct words that a task keeps.
SEGMENT, KEPT_WORDS = 1_000_000, 600_000


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the library finds in a text before the pattern cuts it."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of a very long text, cut before a space between letters, where a word always ends."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class _Codes(dict):
    """word -> number in order of first sight; new holds those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """encode_words turns distinct words into (all ids, ids per word). Words are kept between calls, a bounded number of them."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int]) -> None:
        self.encode_words = encode_words
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.flat = np.empty(0, np.int32)
        self.lens = np.empty(0, np.int64)
        for word in self.added:  # a control string is one word with one id
            self.codes[f"\0{word}"] = len(self.codes)
        if self.added:
            self.flat = np.fromiter(self.added.values(), np.int32, len(self.added))
            self.lens = np.ones(len(self.added), np.int64)

    def trim(self, n: int) -> None:
        """Keeps the n words that were seen first: the frequent ones are among them, and need not be encoded again."""
        kept = _Codes()
        kept.update(islice(self.codes.items(), n))
        self.codes, self.lens = kept, self.lens[:n]
        self.flat = self.flat[: int(self.lens.sum())].copy()

    def cut(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self.cut_plain(text[at : m.start()]) + [f"\0{m[0]}"]
                at = m.end()
            return out + self.cut_plain(text[at:])
        return self.cut_plain(text)

    @staticmethod
    def cut_plain(text: str) -> list[str]:
        # a word that begins with the zero character can't be taken for a control string: it has at most one such character
        pattern = _CAREFUL if _OTHER.search(text) else _QUICK
        if len(text) <= SEGMENT:
            return pattern.findall(text)
        return [w for s in segments(text) for w in pattern.findall(s)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids begin and end (one more than texts)."""
        if len(self.codes) > KEPT_WORDS:
            self.trim(KEPT_WORDS // 2)
        words, ends = [], [0]
        for t in texts:
            words += self.cut(t)
            ends.append(len(words))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if new := self.codes.new:
            flat, lens = self.encode_words(new)
            self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
            self.codes.new = []
        lens = self.lens[codes]
        starts = (np.cumsum(self.lens) - self.lens)[codes]
        before = np.concatenate([[0], np.cumsum(lens)])
        return gather(self.flat, starts, lens), before[ends]


def library_encoder(path: str) -> WordEncoder:
    """Words go through the tokenizers library: no added special tokens, no truncation, no padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum())), lens

    return WordEncoder(encode_words, added_tokens(path))


_held: dict[tuple[str, str], WordEncoder] = {}


def held_encoder(path: str, kind: str = "library") -> WordEncoder:
    """This worker's encoder, which later tasks of the same worker use again."""
    claim("words", _held.clear)
    if (kind, path) not in _held:
        from tallyward.llm.bpe import numpy_encoder

        _held[kind, path] = library_encoder(path) if kind == "library" else numpy_encoder(path)
    return _held[kind, path]
