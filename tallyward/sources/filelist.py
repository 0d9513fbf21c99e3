"""File lists: one line a file, `inode generation snapshot |size|time| -- path` with a percent-encoded path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.columns import base_path, clean_path, percent_decode, short_enough

#: No part but the last may hold \x01, which parts the fields of a matched line.
LINE = r"^(\d+) (\d+) (\d+)[\t\n\x0B\f\r ]+\|(\d+)\|([^|\x01]*)\| -- ([\s\S]*)$"
_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"
#: Longest number, time and name of a line, in bytes.
MOST_NUMBER, MOST_TIME, MOST_NAME = 32, 64, 16384
#: A text in which each byte is one character, so that lines need not be UTF-8, and lengths count bytes.
_BYTES = "ISO-8859-1"
_PARTS = "\x01".join(["", "$1", "$2", "$3", "$4", "$5", "$6"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of list files, splittable; only a newline ends a line."""
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with the line's fields and problem: null for a good line, else format, length, number, time or path. Native expressions alone.

    Lines are bytes: those that are not UTF-8 keep theirs in the path. A line is matched once: its parts become an array,
    and the fields a row of a generator, below which neither projections nor filters on the fields are copied.
    """
    raw = F.decode(F.col(line).cast("binary"), _BYTES)
    cut = lines.withColumn("_raw", raw).withColumn("_parts", F.split(F.regexp_replace("_raw", LINE, _PARTS), "\x01", 7))
    part = lambda i: F.try_element_at("_parts", F.lit(i + 1))
    fits = (F.size("_parts") == 7) & (part(0) == "") & ~F.col("_raw").startswith("\x01")
    too_long = reduce(Column.__or__, [F.length(part(i)) > most for i, most in ((1, MOST_NUMBER), (2, MOST_NUMBER), (3, MOST_NUMBER), (4, MOST_NUMBER), (5, MOST_TIME), (6, MOST_NAME))])
    early = F.when(F.coalesce(~fits, F.lit(True)), "format").when(too_long, "length")
    names = ("inode", "generation", "snapshot_id", "file_size")
    fields = F.struct(
        early.alias("_early"), *(part(i + 1).try_cast("bigint").alias(n) for i, n in enumerate(names)),
        F.when(part(5).rlike(_TIME), part(5).try_cast("timestamp_ntz")).alias("modification_time"), F.when(early.isNull(), percent_decode(part(6), _BYTES)).alias("path"),
    )
    # outer, as an inner generator's array would be computed once more in an inferred filter
    parsed = cut.select(*(F.col(c) for c in lines.columns), F.inline_outer(F.array(fields)))
    numbers = reduce(Column.__or__, [F.col(n).isNull() for n in names])
    problem = F.coalesce("_early", F.when(numbers, "number").when(F.col("modification_time").isNull(), "time").when(F.col("path").isNull(), "path"))
    return parsed.withColumn("problem", problem).drop("_early")


def read_filelist(lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """inode, generation, snapshot_id, file_size, modification_time, path (bytes) of the good lines; strict fails on the first bad one."""
    parsed = parse_lines(lines)
    if strict:
        checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("bad line in file list ("), "problem", F.lit("): "), "line")).cast("boolean")).otherwise(True)
        parsed = parsed.filter(checked)
    return parsed.filter("problem IS NULL").drop("line", "problem")


def filelist_errors(lines: DataFrame) -> DataFrame:
    """The lines that do not fit, with their problem."""
    return parse_lines(lines).filter("problem IS NOT NULL").select("line", "problem")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the LIKE patterns (escape character: backslash). Patterns with a single quote are refused."""
    for p in patterns:
        if "'" in p:
            raise ValueError(f"single quotes are not supported in patterns: {p}")
    return reduce(Column.__or__, [path.like(p) for p in patterns], F.lit(False))


def below(path: Column, sub_path: str) -> Column:
    return path.startswith(base_path(sub_path) + "/")


def inventory(listed: DataFrame, mount: str, snapshot_dir: str, snapshot: str, *, patterns: list[str] | None = None, sub_path: str | None = None) -> DataFrame:
    """The inventory of a parsed list (path as text): exclusions on the listed path, then paths made relative, those too long left out."""
    kept = listed.filter(~excluded(F.col("path"), patterns or []))
    if sub_path is not None:
        kept = kept.filter(below(F.col("path"), sub_path))
    kept = kept.withColumn("path", clean_path(F.col("path"), mount, snapshot_dir, snapshot))
    return kept.filter(short_enough(F.col("path"))).select("path", "modification_time", "file_size")
