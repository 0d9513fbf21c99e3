"""Token files: a concatenated id array with Elias-Fano encoded document boundaries.

A shard file (little-endian throughout) holds, in ascending order of document id:

    8 bytes   magic "TALLYEF1"
    9 uint64  documents, documents without an id, ids, bytes an id (2 or 4), least document id,
              bytes of the boundary index and of the document-id index, crc32 of all sections, 0
    boundary index, document-id index   Elias-Fano sequences, see EliasFano.to_bytes
    ids       documents * bytes an id

The boundary index is the running count of ids after each document; select(i) finds
one, and selected(a, b) a range of them, without reading the others, in two bits and
the low bits a document instead of a table of 64-bit offsets. A task closes a shard once
it holds SHARD_IDS ids, so neither writer nor reader holds more, whatever the corpus.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import col, small_batches, text_steps, tokenizer_path, work_dir
from tallyward.llm.words import held_encoder

MAGIC, HEAD, END_ID = b"TALLYEF1", struct.Struct("<8s9Q"), 2
#: Every so many ones the select structure keeps a position.
SAMPLE = 256
#: Ids at which a shard is closed; the document that brings it there is still whole in it. Documents that are read back at once.
SHARD_IDS, READ = 8_000_000, 4_096
#: Characters of the text by which rows of one id are dealt.
_TIE = 64


class EliasFano:
    """A non-decreasing sequence of numbers from 0: low bits packed, high bits in unary, with sampled positions for select."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4Q", self.count, self.low_bits, len(self.low), len(self.high))
        return head + self.samples.astype("<u8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        count, bits, low, high = struct.unpack_from("<4Q", data)
        at = 32 + 8 * (samples := -(-count // SAMPLE))
        return cls(count, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u8", samples, 32))

    def _low(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.int64)
        first = a * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-b * self.low_bits // 8)], bitorder="little")[first % 8 :][: (b - a) * self.low_bits]
        return bits.reshape(b - a, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value i, from the nearest sampled position on; reads a few bytes of the high bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at // 8, -1
        skip = at % 8
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:]) + skip
            if seen + len(bits) >= left:
                place = 8 * byte + int(bits[left - seen - 1])
                return ((place - i) << self.low_bits) | int(self._low(i, i + 1)[0])
            seen, byte, skip = seen + len(bits), byte + 64, 0

    def selected(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, as far as there are so many: the sampled position before a, and of the high bits only the bytes up to value b - 1."""
        b = min(b, self.count)
        if a >= b:
            return np.zeros(0, np.int64)
        at = int(self.samples[a // SAMPLE])
        last = -(-b // SAMPLE)  # the first sample at or behind b
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[at // 8 : end], bitorder="little")[at % 8 :])[a % SAMPLE :][: b - a] + at
        return ((places - np.arange(a, b)) << self.low_bits) | self._low(a, b)


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of documents in ascending id order, those without an id first."""
    nulls = sum(x is None for x in doc_ids)
    known = doc_ids[nulls:]
    least = known[0] if known else 0
    bounds = EliasFano.of(np.cumsum(counts)).to_bytes()
    keys = EliasFano.of(np.array([x - least for x in known], np.uint64)).to_bytes()
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    body = bounds + keys + ids.astype(f"<u{width}").tobytes()
    return HEAD.pack(MAGIC, len(doc_ids), nulls, len(ids), width, least % 2**64, len(bounds), len(keys), zlib.crc32(body), 0) + body


class Shard:
    """A shard file read back: doc_ids, bounds (EliasFano) and ids; ids_of(i) takes one document through select, ends(a, b) where documents a to b - 1 end."""

    def __init__(self, data: bytes) -> None:
        magic, self.documents, nulls, n, width, least, bounds, keys, crc, _ = HEAD.unpack_from(data)
        body = memoryview(data)[HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("no token file, or a damaged one")
        least = least - 2**64 if least >= 2**63 else least
        self.bounds = EliasFano.from_bytes(body[:bounds])
        known = EliasFano.from_bytes(body[bounds : bounds + keys])
        self.doc_ids: list[int | None] = [None] * nulls + [least + x for x in known.selected(0, known.count).tolist()]
        self.ids = np.frombuffer(body, f"<u{width}", n, bounds + keys)

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]

    def ends(self, a: int, b: int) -> np.ndarray:
        return self.bounds.selected(a, b)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> list[tuple[int, int, int, int]]:
    """Encodes docs and writes shard-PPPPPP-SSSSSS.tef files below path; returns (part, shard, documents, ids) of each, in order.

    Documents are dealt out by ranges of their id (an integer) and, where many share one, of their text, so the files' order
    is the ids' order; ties are ordered by text. Null text is empty: the end id alone. Rows with a null id come first.
    Repeated rows are written as often as they occur. A shard is written under another name and then renamed, so a task that
    runs twice leaves one file of each name. An empty table writes no shard. Other columns are not read. A task holds the
    ids of one shard, shard_ids and a document at most.
    """
    vocabulary = vocabulary or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = held_encoder(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal shard
            n, ids = np.concatenate(counts), np.concatenate(held)
            files, name = _file_system(f"{path}/shard-{part:06d}-{shard:06d}.tef")
            files.create_dir(name.rpartition("/")[0], recursive=True)
            with files.open_output_stream(draft := f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}") as out:
                out.write(shard_bytes(keys, n, ids))
            files.move(draft, name)
            row = (part, shard, len(keys), len(ids))
            shard += 1
            for x in (keys, counts, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["part", "shard", "documents", "ids"])

        size = 0
        for rows, texts in text_steps(batches, text_col):
            ids, at = encoder.encode(texts)
            own, n = col(rows, id_col).to_pylist(), np.diff(at) + 1
            ids = np.insert(ids, at[1:], end_id).astype(np.uint16 if end_id < 1 << 16 and (not len(ids) or ids.max() < 1 << 16) else np.uint32)
            ends, first = np.cumsum(n), 0
            while first < len(own):
                done = int(ends[first - 1]) if first else 0
                last = min(len(own), int(np.searchsorted(ends, done + shard_ids - size, side="left")) + 1)
                keys += own[first:last]
                counts.append(n[first:last])
                held.append(ids[done : int(ends[last - 1])])
                size += int(ends[last - 1]) - done
                first = last
                if size >= shard_ids:
                    yield close()
                    size = 0
        if keys:
            yield close()

    order = [F.col(id_col).asc_nulls_first(), F.col("_tie").asc_nulls_first()]
    tied = small_batches(docs.select(id_col, text_col, F.substring(text_col, 1, _TIE).alias("_tie")))
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(order[0], F.col(text_col).asc_nulls_first()).select(id_col, text_col)
    return sorted(tuple(r) for r in dealt.mapInArrow(run, "part long, shard long, documents long, ids long").collect())


def read(spark: SparkSession, path: str, shards: list[tuple[int, int, int, int]], *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The documents of the files below path: id, start (ids of all documents before), n_tokens, ids_crc32; with_ids adds the ids.

    shards is what write() returned: the driver holds four numbers a file. Documents are read READ at a time, their
    boundaries selected from the file's index.
    """
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)
    starts = dict(zip(((p, s) for p, s, _, _ in shards), np.cumsum([0, *(n for *_, n in shards)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(col(batch, "path").to_pylist(), col(batch, "content"), strict=True):
                shard, before = Shard(content.as_buffer()), 0
                part, _, nth = name.rpartition("shard-")[2][:-4].partition("-")
                first = starts[int(part), int(nth)]
                for a in range(0, shard.documents, READ):
                    b = min(a + READ, shard.documents)
                    ends = shard.ends(a, b)
                    begins = np.concatenate([[before], ends[:-1]])
                    ids = shard.ids[before : int(ends[-1])].astype("<u4")
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip((begins - before).tolist(), (ends - before).tolist(), strict=True)]
                    out = [pa.array(shard.doc_ids[a:b], pa.int64()), pa.array(first + begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[before], ends]) - before, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                    before = int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tef").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def write_and_read(docs: DataFrame, vocabulary: str | None = None, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """write() to a new folder of the shared work folder, then read()."""
    path = work_dir(docs.sparkSession, "token-files")
    return read(docs.sparkSession, path, write(docs, path, vocabulary, end_id=end_id, shard_ids=shard_ids))
