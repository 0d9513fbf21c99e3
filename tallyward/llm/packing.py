"""Packing by concatenation and cutting.

The documents' ids form one stream that fixed windows cut into sequences. Pass
one encodes each partition, stores its ids and the running count inside it;
the partitions' totals (a number each) give by prefix sum where each partition
begins; pass two cuts every document at the window borders on its own, so no
task needs another's rows. The stored table makes the order fixed: a task that
runs again gives the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import col, small_batches, stored, text_steps, tokenizer_path
from tallyward.llm.words import held_encoder

WINDOW, END_ID = 2048, 1


def tokens(docs: DataFrame, path: str | None = None, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, stored: part, place (in the part), id, n, before (ids of the part's earlier documents), ids (little-endian 32-bit integers, the end id last)."""
    path = path or tokenizer_path()
    schema = f"part int, place long, {id_col} {docs.schema[id_col].dataType.simpleString()}, n long, before long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place, before = held_encoder(path), TaskContext.get().partitionId(), 0, 0
        for rows, texts in text_steps(batches, text_col):
            ids, at = encoder.encode(texts)
            data = np.insert(ids, at[1:], end_id).astype("<u4").tobytes()
            ends = at + np.arange(len(at))
            n = np.diff(ends)
            blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(place, place + len(n))), col(rows, id_col), pa.array(n), pa.array(before + ends[:-1]), blobs],
                ["part", "place", id_col, "n", "before", "ids"],
            )
            place, before = place + len(n), before + int(ends[-1])

    return stored(small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema), "packing-ids")


def offsets(ids: DataFrame) -> dict[int, int]:
    """Where each part begins in the stream; one number a partition is all that the driver gets."""
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in totals)])
    return {p: int(s) for (p, _), s in zip(totals, starts, strict=False)}


def pack(docs: DataFrame, path: str | None = None, *, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, starts_document, ends_document; with_ids adds the ids.

    Sequences are windows of the stream, full but for the last one. starts_document and ends_document are the boundary
    record: a piece without them continues from, or in, the neighbouring sequence. Null text is empty (a document of the
    end id alone); repeated rows and null ids are packed as often as they occur; other columns are not read; an empty
    table gives no piece. A document longer than a window becomes several pieces.
    """
    stream = tokens(docs, path, end_id=end_id, id_col=id_col, text_col=text_col)
    begins = offsets(stream)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "starts_document", "ends_document"]
    kinds = [docs.schema[id_col].dataType.simpleString(), *["long"] * 6, "boolean", "boolean"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = col(batch, "n").to_numpy()
            first = col(batch, "before").to_numpy() + np.array([begins[p] for p in col(batch, "part").to_pylist()], np.int64)
            count = (first + n - 1) // window - first // window + 1  # pieces of each document
            doc = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            sequence = first[doc] // window + nth
            a = np.maximum(first[doc], sequence * window)
            b = np.minimum(first[doc] + n[doc], (sequence + 1) * window)
            start = a - first[doc]
            blobs = [memoryview(x.as_buffer()) for x in col(batch, "ids")]
            cut = [blobs[d][4 * s : 4 * e] for d, s, e in zip(doc.tolist(), start.tolist(), (start + b - a).tolist(), strict=True)]
            out = [
                col(batch, id_col).take(pa.array(doc)), pa.array(start), pa.array(b - a), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[doc]),
                pa.array(sequence), pa.array(a - sequence * window), pa.array(start == 0), pa.array(b == first[doc] + n[doc]),
            ]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [*names, *["ids"] * with_ids])

    return stream.mapInArrow(run, schema)
