"""Work packs and the write-back of computed checksums."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.sources.store import kept_table

MOST_BYTES, MOST_FILES = 5 << 20, 1000
#: Ranges whose entries (32 bytes each) are broadcast.
MOST_RANGES = 200_000


def pack_ends(sizes: np.ndarray, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> list[int]:
    """Where packs end in a row of sizes: a pack closes with the file that brings it to most_bytes or makes most_files. The last end may fall short of the row's."""
    total, ends, at = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while True:
        by_size = int(np.searchsorted(total, total[at] + most_bytes, side="left"))
        end = min(max(by_size, at + 1), at + most_files)
        if end > len(sizes):
            return ends
        ends.append(end)
        at = end


def place(sizes: np.ndarray, held: int = 0, n: int = 0, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Goes on packing with a pack that holds n files of held bytes (0: none is open): (each file's pack, counted from the open or next one, its position, packs closed, bytes and files of the pack that is open behind)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = min(int(np.searchsorted(total, most_bytes - held)), most_files - n) if n else 0
    if first > len(sizes):
        return np.zeros(len(sizes), np.int64), n + np.arange(len(sizes)), 0, held + int(total[-1]), n + len(sizes)
    bounds = np.array(([first] if n else []) + [first + e for e in pack_ends(sizes[first:], most_bytes, most_files)], np.int64)
    pack = np.searchsorted(bounds, np.arange(len(sizes)), side="right")
    starts = np.concatenate([[-n], bounds])
    last = int(starts[-1])
    return pack, np.arange(len(sizes)) - starts[pack], len(bounds), int(total[-1] - total[max(last, 0)]), len(sizes) - last if len(bounds) or not n else n + len(sizes)


def jumps(sizes: np.ndarray, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a range does to the walk, for each file (of the first most_files, or the range's end) with which a new pack may begin in it: bytes before it, packs closed from there on, bytes and files of the pack open at the range's end.

    Where a pack ends depends on its start alone; the ends are followed for all starts at once, twice as far each round.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    m = len(sizes)
    at = np.arange(m + 1)
    to = np.minimum(np.maximum(np.searchsorted(total, total + most_bytes), at + 1), at + most_files)
    closed = (to <= m).astype(np.int64)
    to = np.where(to <= m, to, at)
    while (to[to] != to).any():
        closed, to = closed + closed[to], to[to]
    head = min(m, most_files) + 1
    return total[:head], closed[:head], (total[m] - total[to])[:head], (m - to)[:head]


#: Files of a range whose packs are tabulated and then built by one task.
RANGE_FILES = 500_000
_RANGE_TABLE = "range long, files long, bytes long, before array<long>, closed array<long>, held array<long>, open array<long>"
_RANGE_ENTRY = "range long, entry_pack long, entry_held long, entry_open long"


def build_packs(files: DataFrame, *, ranges: int | None = None, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """id, path, file_size, pack_id, position of the files to be read: the packs of a single walk in the order of (rand, id), numbered from 0.

    The walk is one of ranges of rand (RANGE_FILES files each; their number changes no pack). A range tabulates what it makes of the walk for every place where its
    first new pack may begin, which is within its first most_files files; composing these tables in order, a few thousand times less than the files, gives
    the pack that is open where each range starts, and then all ranges are packed at once. A task keeps a range's sizes, then the open pack's numbers.
    """
    ready = files.filter("to_be_read").select("rand", "id", "path", F.coalesce("file_size", F.lit(0)).alias("file_size"))
    ranges = ranges or max(1, -(-ready.count() // RANGE_FILES))
    ready = ready.withColumn("range", F.least(F.floor(F.col("rand") * ranges), F.lit(ranges - 1)).cast("bigint"))
    in_order = lambda rows: (rows.repartition("range") if ranges > 1 else rows.coalesce(1)).sortWithinPartitions("range", "rand", "id")

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, sizes in _by_range(batches):
            yield pd.DataFrame([(r, len(sizes), int(sizes.sum()), *jumps(sizes, most_bytes, most_files))], columns=[c.split()[0] for c in _RANGE_TABLE.split(", ")])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, held, n = 0, 0, 0
        for batch in batches:
            out = []
            for t in batch.itertuples():
                out.append((t.range, pack, held, n))
                at = 0
                if n:
                    at = min(int(np.searchsorted(t.before, most_bytes - held)), most_files - n)
                    if at > t.files:
                        held, n = held + t.bytes, n + t.files
                        continue
                    pack += 1
                pack, held, n = pack + int(t.closed[at]), int(t.held[at]), int(t.open[at])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RANGE_ENTRY.split(", ")])

    if ranges > 1:
        tables = kept_table(in_order(ready.select("range", "rand", "id", "file_size")).mapInPandas(tabulate, _RANGE_TABLE), "pack-ranges")
        entries = kept_table(tables.coalesce(1).sortWithinPartitions("range").mapInPandas(compose, _RANGE_ENTRY), "pack-entries").withColumnRenamed("range", "_range")
        dealt = ready.join(F.broadcast(entries) if ranges <= MOST_RANGES else entries, F.col("range") == F.col("_range")).drop("_range")
    else:
        dealt = ready.withColumns({c: F.lit(0).cast("bigint") for c in ("entry_pack", "entry_held", "entry_open")})
    schema = f"id {files.schema['id'].dataType.simpleString()}, path {files.schema['path'].dataType.simpleString()}, file_size long, pack_id long, position long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pack, held, n = -1, 0, 0, 0
        for batch in batches:
            for r, own in batch.groupby("range", sort=False):
                if r != now:
                    now, pack, held, n = r, *(int(own[c].iloc[0]) for c in ("entry_pack", "entry_held", "entry_open"))
                number, position, closed, held, n = place(own["file_size"].to_numpy(np.int64), held, n, most_bytes, most_files)
                yield own[["id", "path", "file_size"]].assign(pack_id=pack + number, position=position)
                pack += closed

    return in_order(dealt).mapInPandas(run, schema)


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray]]:
    """The sizes of each range of a sorted stream."""
    now, held = None, []
    for batch in batches:
        for r, own in batch.groupby("range", sort=False):
            if held and r != now:
                yield now, np.concatenate(held)
                held = []
            now = r
            held.append(own["file_size"].to_numpy(np.int64))
    if held:
        yield now, np.concatenate(held)


def pack_totals(packs: DataFrame) -> DataFrame:
    return packs.groupBy("pack_id").agg(F.count("*").alias("files"), F.sum("file_size").alias("total_size"))


def collect_packs(packs: DataFrame) -> DataFrame:
    """A row a pack with its files (id, path) in order; packs are bounded, so the arrays are."""
    entry = F.struct("position", "id", "path")
    return packs.groupBy("pack_id").agg(F.array_sort(F.collect_list(entry)).alias("f")).select("pack_id", F.transform("f", lambda x: F.struct(x["id"].alias("id"), x["path"].alias("path"))).alias("files"))


def _arrivals(order: tuple[str, ...]) -> Column:
    return F.row_number().over(Window.partitionBy("id").orderBy(*order))


def first_result(results: DataFrame, order: tuple[str, ...] = ("pack_id", "pos")) -> DataFrame:
    """The first arrival of each file's results."""
    return results.withColumn("_n", _arrivals(order)).filter("_n = 1").drop("_n")


def later_results(results: DataFrame, order: tuple[str, ...] = ("pack_id", "pos")) -> DataFrame:
    """The results that first_result leaves out."""
    return results.withColumn("_n", _arrivals(order)).filter("_n > 1").drop("_n")


def unknown_results(results: DataFrame, files: DataFrame) -> DataFrame:
    return results.join(files.select("id"), "id", "left_anti")


def _found(files: DataFrame, first: DataFrame) -> DataFrame:
    return files.join(first.select("id", F.col("checksum").alias("_actual")), "id")


def checksum_mismatches(files: DataFrame, first: DataFrame, run: int, created: datetime | None = None) -> DataFrame:
    """Warnings: results of files to be read and to be compared whose stored checksum differs. created is given, so that runs repeat."""
    differ = F.col("to_be_read") & F.col("to_be_compared") & F.col("checksum").isNotNull() & (F.col("checksum") != F.col("_actual"))
    return _found(files, first).filter(differ).select(
        F.col("id").alias("file_id"), "path", "modification_time", "file_size", F.col("checksum").alias("expected_checksum"), F.col("_actual").alias("actual_checksum"),
        F.lit(run).cast("bigint").alias("discovered"), F.coalesce("last_read", F.lit(0).cast("bigint")).alias("last_read"), *([F.lit(created).alias("created")] if created else []),
    )


def write_back(files: DataFrame, first: DataFrame, run: int) -> DataFrame:
    """The files table with the results of the files still to be read; all other rows as they were."""
    joined = files.join(first.select("id", F.col("checksum").alias("_actual"), F.lit(True).alias("_got")), "id", "left")
    now = F.col("_got").isNotNull() & F.col("to_be_read")
    changed = {"checksum": F.col("_actual"), "last_read": F.lit(run).cast("bigint"), "to_be_read": F.lit(False), "to_be_compared": F.lit(False)}
    return joined.select(*(F.when(now, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in files.columns))


def refuse_unknown(results: DataFrame, files: DataFrame) -> None:
    if some := unknown_results(results, files).limit(1).collect():
        raise ValueError(f"result of an unknown file: {some[0]['id']}")
