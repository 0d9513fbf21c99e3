"""Synchronising the files table with a run's inventory.

Flags come from the old row against the new inventory. A row is pending when it is to be
read and not to be compared (a run was aborted before it was read); it stays that way.
All joins are by path; with files bucketed by it (store.write_bucketed) only the inventory moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.functions.columns import short_enough, uniform_rand
from tallyward.sources.store import kept_table

FULL, INCREMENTAL = "full", "incremental"
#: Hexadecimal digits of a digest by which rows are counted in one pass (65,536 cells), and rows of a cell that are ranked.
CELL_DIGITS, MOST_RANKED = 4, 20_000


def _flags(incremental: bool, old_time: str, new_time: str, read: str = "to_be_read", compared: str = "to_be_compared") -> tuple[Column, Column]:
    """(to_be_read, to_be_compared) after an update."""
    pending, same = F.col(read) & ~F.col(compared), F.col(old_time).eqNullSafe(F.col(new_time))
    if incremental:
        return pending | ~same, F.lit(False)
    return F.lit(True), ~pending & same


def _mode(mode: str) -> bool:
    """Any mode but incremental works as full."""
    return mode == INCREMENTAL


def sync_update(files: DataFrame, inventory: DataFrame, run: int, mode: str = FULL) -> DataFrame:
    """The rows of files that the inventory has and this run has not seen yet, as they are after the update."""
    new = inventory.select("path", F.col("modification_time").alias("_time"), F.col("file_size").alias("_size"))
    read, compared = _flags(_mode(mode), "modification_time", "_time")
    joined = files.filter(F.col("last_seen") != run).join(new, "path")
    changed = {"modification_time": F.col("_time"), "file_size": F.col("_size"), "last_seen": F.lit(run).cast("bigint"), "to_be_read": read, "to_be_compared": compared}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in files.columns))


def new_ids(new: DataFrame, first_id: int) -> DataFrame:
    """path and _id of rows with new, unique paths: from first_id on without gaps, in the order of (md5 of the path, path), so ids are a function of the rows.

    Two passes: the rows of each of CELLS ranges of the digest are counted, prefix sums give where a range's ids begin, and rows are ranked within their range.
    """
    drawn = new.select("path", F.md5(F.col("path").cast("binary")).alias("_draw")).withColumn("_cell", F.substring("_draw", 1, CELL_DIGITS))
    counts = drawn.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over 65,536 rows at most
    ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", "path")))
    return ranked.join(F.broadcast(counts.select("_cell", before.alias("_before"))), "_cell").select("path", (F.lit(first_id) + F.col("_before") + F.col("_rank") - 1).alias("_id"))


def sync_insert(files: DataFrame, inventory: DataFrame, run: int, *, seed: str = "", first_id: int = 0) -> DataFrame:
    """Rows for the paths that files lacks: to be read, not to be compared, without checksum. Ids as new_ids gives them from first_id (one above the greatest so far); equal inputs get equal rands."""
    rows = kept_table(inventory.join(files.select("path"), "path", "left_anti"), "new-files")
    return rows.join(new_ids(rows, first_id), "path").select(*(_new_row(c, files, run, seed) for c in files.columns))


def _new_row(c: str, files: DataFrame, run: int, seed: str, time: str = "modification_time", size: str = "file_size") -> Column:
    kind = files.schema[c].dataType
    values = {
        "id": F.col("_id").cast(kind),
        "rand": uniform_rand(seed, F.col("path").cast("string")),
        "path": F.col("path"), "modification_time": F.col(time), "file_size": F.col(size), "last_seen": F.lit(run).cast("bigint"), "to_be_read": F.lit(True), "to_be_compared": F.lit(False),
    }
    return values.get(c, F.lit(None).cast(kind)).alias(c)


def sync_delete(files: DataFrame, inventory: DataFrame, run: int) -> DataFrame:
    """The rows of files that neither this run has seen nor the inventory has: those to remove."""
    return files.filter(F.col("last_seen") != run).join(inventory.select("path"), "path", "left_anti")


def checked_inventory(inventory: DataFrame, duplicates: str = "reject") -> DataFrame:
    """One row a path: a path that occurs twice is refused, or with `latest` the row of the latest time counts."""
    if duplicates not in ("reject", "latest"):
        raise ValueError(duplicates)
    best = F.max(F.struct("modification_time", "file_size")).alias("b")
    grouped = inventory.groupBy("path").agg(best, F.count("*").alias("n"))
    if duplicates == "reject":
        grouped = grouped.filter(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("path twice in inventory: "), F.col("path").cast("string"))).cast("boolean")).otherwise(True))
    return grouped.select("path", "b.modification_time", "b.file_size")


def sync_files(files: DataFrame, inventory: DataFrame, run: int, mode: str = FULL, *, seed: str = "", first_id: int = 0, duplicates: str | None = None) -> DataFrame:
    """The whole merge as one full outer join: files' columns and action (update, insert, delete, unchanged). Rows of action delete are as they were.

    duplicates as in checked_inventory; None where paths are known to be unique, which saves the grouping. New rows have ids as
    new_ids gives them, which takes a pass over the paths alone before.
    """
    if duplicates:
        inventory = checked_inventory(inventory, duplicates)
    fresh = kept_table(inventory.select("path").join(files.select("path"), "path", "left_anti"), "new-paths")
    new = inventory.join(new_ids(fresh, first_id), "path", "left").select("path", F.col("modification_time").alias("_time"), F.col("file_size").alias("_size"), "_id", F.lit(True).alias("_new"))
    joined = files.withColumn("_old", F.lit(True)).join(new, "path", "full_outer")
    seen = F.col("last_seen") == run
    action = F.when(F.col("_old").isNull(), "insert").when(seen, "unchanged").when(F.col("_new").isNull(), "delete").otherwise("update")
    joined = joined.withColumn("action", action)
    read, compared = _flags(_mode(mode), "modification_time", "_time")
    updated = {"modification_time": F.col("_time"), "file_size": F.col("_size"), "last_seen": F.lit(run).cast("bigint"), "to_be_read": read, "to_be_compared": compared}
    pick = lambda c: F.when(F.col("action") == "insert", _new_row(c, files, run, seed, "_time", "_size")).when(F.col("action") == "update", updated.get(c, F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*(F.col(c) if c == "path" else pick(c) for c in files.columns), "action")


def next_files(synced: DataFrame) -> DataFrame:
    """The files table after sync_files."""
    return synced.filter("action <> 'delete'").drop("action")


def next_files_by_union(files: DataFrame, inventory: DataFrame, run: int, mode: str = FULL, *, seed: str = "", first_id: int = 0) -> DataFrame:
    """The same table from its three parts; a plan of several joins that checks the other."""
    seen = files.filter(F.col("last_seen") == run)
    return seen.unionByName(sync_update(files, inventory, run, mode)).unionByName(sync_insert(files, inventory, run, seed=seed, first_id=first_id))


def sync_counts(synced: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """action and n: rows updated, inserted, deleted and unchanged, and of the listing (with its cleaned paths) those listed and, for too long a path, skipped."""
    actions = synced.select("action")
    if listed is not None:
        actions = actions.unionByName(listed.select(F.when(short_enough(F.col("path")), "listed").otherwise("skipped").alias("action")))
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def files_to_be_read(files: DataFrame) -> DataFrame:
    return files.filter("to_be_read").select("id", "rand", "path", "file_size")


def with_rand_ranges(files: DataFrame, ranges: int) -> DataFrame:
    """files with rand_range, their range of equal ranges of rand: a table partitioned by it is paged by reading each folder about once."""
    return files.withColumn("rand_range", F.least(F.floor(F.col("rand") * ranges), F.lit(ranges - 1)).cast("int"))


def next_files_page(files: DataFrame, after_rand: float, after_id: int, limit: int, *, ranges: int | None = None) -> DataFrame:
    """The next files to be read in the order of (rand, id), behind a given place.

    With ranges, files is laid out by with_rand_ranges: the folders from the place on are taken, one and then four times as many,
    until they hold a page; the others aren't listed for it.
    """
    behind = (F.col("rand") >= after_rand) & ((F.col("rand") > after_rand) | (F.col("id") > after_id))
    page = lambda rows: files_to_be_read(rows.filter(behind)).orderBy("rand", "id").limit(limit)
    if ranges is None:
        return page(files)
    first, n = max(0, min(int(after_rand * ranges), ranges - 1)), 1
    while True:
        found = page(files.filter(F.col("rand_range").between(first, first + n - 1)))
        if first + n >= ranges or found.count() == limit:
            return found
        n *= 4


def files_by_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id"), "id", "left_semi")


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("files"), F.sum("file_size").alias("total_size"))


def path_length_stats(inventory: DataFrame) -> DataFrame:
    n = F.octet_length("path")
    return inventory.agg(F.min(n).cast("bigint").alias("min_length"), F.max(n).cast("bigint").alias("max_length"), F.avg(n).alias("mean_length"))


def sample_inventory(inventory: DataFrame, n: int, seed: str, most: int = MOST_RANKED) -> DataFrame:
    """n rows at random, the same for the same seed: those of least digest, ties by path.

    The rows are counted by the digest's first digits; where the n-th lies, by more of them, until that cell holds `most` rows or fewer. What lies below
    the cell is taken as it is, and only the cell's rows are ranked, so no task sends n rows.
    """
    drawn = inventory.withColumn("_draw", F.md5(F.concat(F.lit(seed), F.col("path").cast("string"))))
    edge, before, inside = "", 0, most + 1
    while inside > most and len(edge) < 32:
        cells = drawn.filter(F.col("_draw").startswith(edge)).groupBy(F.substring("_draw", 1, len(edge) + CELL_DIGITS).alias("_cell")).agg(F.count("*").alias("_n"))
        upto = cells.withColumn("_upto", F.sum("_n").over(Window.orderBy("_cell")))  # over 65,536 rows at most
        cell = upto.filter(F.col("_upto") >= n - before).orderBy("_cell").first()
        if cell is None or n <= 0:
            return inventory.limit(0) if n <= 0 else inventory
        edge, before, inside = cell["_cell"], before + cell["_upto"] - cell["_n"], cell["_n"]
    whole = drawn.filter(F.col("_draw") < edge)
    last = drawn.filter(F.col("_draw").startswith(edge)).orderBy("_draw", "path").limit(n - before)
    return whole.unionByName(last).drop("_draw")


def first_n(inventory: DataFrame, n: int, order: str = "position") -> DataFrame:
    return inventory.orderBy(order).limit(n)


def duplicate_paths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
