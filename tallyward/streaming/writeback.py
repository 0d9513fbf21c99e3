"""Results that arrive as a stream.

Parquet has no upsert, so each micro-batch is kept as a folder of the result log
named by its batch id: a batch that runs again writes the same folders. The log holds the
results that count, each file's first if the file is still to be read. Warnings come out
with each batch. The next table is made from the files table and the log, so a streamed run
ends with the same table as one batch, and a result for a file that was written before changes nothing.

A batch costs what it holds: its ids are broadcast (a number of them that is checked) and cut
the files table once, without moving it; in a table laid out by ids the ids' range also prunes files and row groups.
A batch of more ids goes range by range of ids, and its cut is stored, so it doesn't move the table either.
Everything else joins the batch with that cut. Earlier results are looked up in the log since the last
folding: a new files table is written that has the log up to there. Whether it is time is looked at every `fold_every` batches;
it is if the log has as many rows as the table, so that foldings write no more rows for each result than one or two, however
many batches the stream has, and a batch's lookup in the log reads no more ids than its cut of the table does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.writeback import checksum_mismatches, first_result, refuse_unknown, unknown_results, write_back
from tallyward.sources.store import BatchFolder, work_folder

#: Most ids of a micro-batch that are broadcast at once (16 bytes each). A larger batch is cut range by range.
MOST_BROADCAST = 1_000_000
#: Batches after which it is looked at whether the log is to be folded into a new files table.
FOLD_EVERY = 500
#: The log is folded when it has FOLD_SHARE times the table's rows, or MOST_UNFOLDED batches.
FOLD_SHARE, MOST_UNFOLDED = 1.0, 5_000


def laid_out_by_id(files: DataFrame, parts: int | None = None) -> DataFrame:
    """files in ranges of ids, so that file and row-group statistics tell where an id can be."""
    return (files.repartitionByRange(parts, "id") if parts else files.repartitionByRange("id")).sortWithinPartitions("id")


def files_of(files: DataFrame, ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows of files with one of ids. One pass over ids gives their number and range; files are read by range, and a number of ids up to `most` is broadcast."""
    got = ids.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest")).first()
    if not got.n or got.least is None:
        return files.limit(0)
    near = files.filter(F.col("id").between(got.least, got.greatest))
    wanted = ids.select("id").distinct()
    return near.join(F.broadcast(wanted) if got.n <= most else wanted, "id", "left_semi")


def id_ranges(ids: DataFrame, most: int | None = None) -> list[tuple[int, int]]:
    """Ranges (both ends in them) that cover distinct ids, with `most` (MOST_BROADCAST) of them or fewer in each."""
    most = most or MOST_BROADCAST
    got = ids.agg(F.count("id").alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest")).first()
    parts = -(-4 * got.n // (3 * most))  # quantiles are off by a tenth of a part at most
    if got.n <= most:
        return [(got.least, got.greatest)] if got.n else []
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]) - {got.greatest})
    return list(zip([got.least, *(c + 1 for c in cuts)], [*cuts, got.greatest], strict=True))


class _Folder(BatchFolder):
    """What lies below a stream's folder: log, warnings, unknown (by batch) and files (by the last batch that is folded in)."""

    def files_before(self, batch: int, files: DataFrame) -> tuple[DataFrame, int]:
        """(the newest files table that holds no batch from the given one on, the last batch in it)."""
        table, upto = self.newest_before("files", batch, files.schema)
        return (files if upto < 0 else table), upto

    def logged(self, schema, after: int, before: int) -> DataFrame:
        """The log of the batches between; they alone are listed."""
        places = [self.place("log", n) for n in self.done("log") if after < n < before]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places)

    def cut(self, name: str, batch: int, table: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of table with one of a batch's distinct ids: kept in memory, or, if there are too many to be broadcast at once, stored below name, range by range."""
        ranges = id_ranges(ids)
        if len(ranges) < 2:
            return files_of(table, ids, MOST_BROADCAST).persist()
        for i, (low, high) in enumerate(ranges):
            found = files_of(table, ids.filter(F.col("id").between(low, high)), MOST_BROADCAST)
            found.write.mode("append" if i else "overwrite").parquet(self.place(name, batch))
        return self.spark.read.schema(table.schema).parquet(self.place(name, batch))

    def is_long(self, batch: int, files: DataFrame, schema, rows: int) -> bool:
        """Whether the log up to a batch is to be folded into the table, which has a number of rows."""
        _, upto = self.files_before(batch, files)
        return batch - upto >= MOST_UNFOLDED or self.logged(schema, upto, batch + 1).count() >= FOLD_SHARE * rows

    def fold(self, batch: int, files: DataFrame, schema, run: int) -> None:
        """Writes the files table with the log up to a batch. The table before it stays, for a batch that runs again; older ones go."""
        old, upto = self.files_before(batch, files)
        laid_out_by_id(write_back(old, self.logged(schema, upto, batch + 1), run)).write.mode("overwrite").parquet(self.place("files", batch))
        for n in self.done("files"):
            if n < upto:
                self.remove("files", n)


def log_results(results: DataFrame, files: DataFrame, folder: str, run: int, *, refuse: bool = True, fold_every: int = FOLD_EVERY, **trigger):
    """Starts the stream (id, pack_id, pos, checksum) and returns the streaming query; trigger as in writeStream.trigger.

    Below folder, by batch: log (results that count), warnings, and unknown (results of files that are not in the table).
    With refuse, a batch with unknown results fails before it writes anything. files should be laid out by id.
    """
    sizes: list[int] = []  # the number of rows of files, once it is wanted; no batch changes it
    spark, kept = results.sparkSession, _Folder(results.sparkSession, folder)
    spark.createDataFrame([], results.schema).write.mode("overwrite").parquet(kept.place("log", -1))

    def keep(batch: DataFrame, n: int) -> None:
        first = first_result(batch).persist()
        now, upto = kept.files_before(n, files)
        cut = kept.cut("cut", n, now, first.select("id"))
        before = kept.cut("before", n, kept.logged(results.schema, upto, n).select("id"), first.select("id"))
        try:
            if refuse:
                refuse_unknown(first, cut)
            unknown_results(first, cut).write.mode("overwrite").parquet(kept.place("unknown", n))
            new = first.join(before, "id", "left_anti").join(cut.filter("to_be_read").select("id"), "id", "left_semi")
            new.select(*results.columns).write.mode("overwrite").parquet(kept.place("log", n))
            logged = spark.read.schema(results.schema).parquet(kept.place("log", n))
            checksum_mismatches(cut, logged, run).write.mode("overwrite").parquet(kept.place("warnings", n))
            if (n + 1) % fold_every == 0:
                sizes[:] = sizes or [files.count()]
                if kept.is_long(n, files, results.schema, sizes[0]):
                    kept.fold(n, files, results.schema, run)
        finally:
            for held in (first, cut, before):
                held.unpersist()
            for name in ("cut", "before"):
                kept.remove(name, n)

    return results.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger or {"processingTime": "30 seconds"}).start()


def read_log(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """log, warnings or unknown of all batches, with batch_id."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").withColumn("batch_id", F.col("batch_id").cast("bigint"))


def stream_write_back(spark: SparkSession, files: DataFrame, results: DataFrame, run: int, folder: str | None = None, *, refuse: bool = True, fold_every: int = FOLD_EVERY, **trigger) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs the stream to its end and returns (the next files table, the warnings, the unknown results). For a stream without end, call log_results and, later, compact."""
    folder = folder or work_folder(spark, "write-back")
    log_results(results, files, folder, run, refuse=refuse, fold_every=fold_every, **trigger or {"availableNow": True}).awaitTermination()
    return compact(spark, files, folder, run), read_log(spark, folder, "warnings").drop("batch_id"), read_log(spark, folder, "unknown")


def compact(spark: SparkSession, files: DataFrame, folder: str, run: int) -> DataFrame:
    """The files table with all that the log holds: the newest folded one and the log since."""
    kept, end = _Folder(spark, folder), 1 << 62
    now, upto = kept.files_before(end, files)
    schema = spark.read.parquet(kept.place("log", -1)).schema
    return write_back(now, kept.logged(schema, upto, end), run)


def stream_late_results(spark: SparkSession, results: DataFrame, files: DataFrame, folder: str | None = None, *, fold_every: int = FOLD_EVERY, **trigger) -> DataFrame:
    """The arriving results that change something: each file's first in the stream, if the file is still to be read; later and late ones are passed over."""
    folder = folder or work_folder(spark, "late")
    log_results(results, files, folder, 0, refuse=False, fold_every=fold_every, **trigger or {"availableNow": True}).awaitTermination()
    return read_log(spark, folder, "log")
