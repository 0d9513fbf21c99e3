"""Checksums of file contents: of a column, and of files read in chunks."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 4 << 20


def checksum_contents(contents: DataFrame) -> DataFrame:
    """id, bytes_read, checksum (hex) of a content column."""
    data = F.col("content").cast("binary")
    return contents.select("id", F.octet_length(data).cast("bigint").alias("bytes_read"), F.sha1(data).alias("checksum"))


#: Files of a group in which places are summed up one by one.
GROUP_FILES = 100_000


def dealt_by_size(files: DataFrame, tasks: int, size: str = "file_size") -> DataFrame:
    """files in `tasks` partitions of about equal bytes, each with its largest file first; the partitions with the largest files come first.

    Prefix sums of the sizes, from the largest down: files are grouped by size (in steps of a quarter) and, where a group is large, by a digest of the path;
    the groups' sums are added up, then the sizes within a group. A file's task is where its middle lies in all bytes. An empty file counts as one byte.
    """
    bytes_ = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(1)).cast("bigint")
    sized = files.withColumn("_bytes", bytes_).withColumn("_class", F.floor(4 * F.log2("_bytes")).cast("int"))
    most = sized.groupBy("_class").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    slots = max(1, -(-most // GROUP_FILES))
    sized = sized.withColumn("_slot", F.pmod(F.xxhash64("path"), F.lit(slots)))
    groups = sized.groupBy("_class", "_slot").agg(F.sum("_bytes").alias("_sum"))  # a row for each GROUP_FILES files or so, and for each class
    order = Window.orderBy(F.desc("_class"), "_slot")
    groups = groups.select("_class", "_slot", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_class", "_slot").orderBy(F.desc("_bytes"), "path").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("_upto", F.sum("_bytes").over(within)).join(groups, ["_class", "_slot"])
    middle = F.col("_before") + F.col("_upto") - F.col("_bytes") / 2
    placed = summed.withColumn("_task", F.least(F.floor(middle * tasks / F.col("_all")), F.lit(tasks - 1)).cast("int"))
    return placed.repartitionById(tasks, F.col("_task")).sortWithinPartitions(F.desc("_bytes")).drop("_class", "_slot", "_upto", "_before", "_all", "_task", "_bytes")


def checksum_files(files: DataFrame, kind: str = "long", *, tasks: int | None = None) -> DataFrame:
    """id, bytes_read, checksum (bytes) of the files at path (a local or mounted path, or a URI of a file system Arrow knows).

    Files are read in chunks, whatever their size. A file that fails to open or read is logged and left out, the others go on.
    With tasks, files has file_size and is dealt by it, so that tasks read equal bytes.
    """
    if tasks:
        files = dealt_by_size(files, tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for i, path in zip(batch["id"], batch["path"], strict=True):
                digest, n = hashlib.sha1(), 0
                try:
                    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                    with files.open_input_stream(name) as f:
                        while chunk := f.read(CHUNK):
                            digest.update(chunk)
                            n += len(chunk)
                except OSError as e:
                    logging.getLogger(__name__).warning("left out %s: %s", path, e)
                    continue
                out.append((i, n, digest.digest()))
            yield pd.DataFrame(out, columns=["id", "bytes_read", "checksum"])

    return files.select("id", "path").mapInPandas(run, f"id {kind}, bytes_read long, checksum binary")
