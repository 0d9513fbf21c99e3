"""JSON change logs, logfmt logs, benchmark CSV files, and the JSON and CSV outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "event string, path string, corrupted boolean, corrupted_only boolean, changers array<struct<method:string,id:string>>"
BENCH = "method string, batch_size int, transaction_size int, concurrent boolean, concurrency int, total_duration double"
#: Longest logfmt line with its end, in bytes.
MOST_LINE = 65536
_PAIR = r'([^\s="]+)=("(?:[^"\\]|\\.)*"|[^\s"]*)'
#: Phases of the scheduler; messages that tell observation and scheduling records; fields of a snapshot in CSV order.
PHASES = ("uninitialised", "start-up", "maintaining")
OBSERVED, SCHEDULED = "Probed queue and calculated derivatives", "Calculated threshold"
SNAPSHOT = (
    "time", "timestamp", "previous_queue_length", "queue_length", "exhausted", "enqueued", "worker_num", "consumption",
    "deviation", "consumption_alpha", "consumption_ewma", "deviation_alpha", "deviation_ewma", "phase", "threshold",
)


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """The change events of files of JSON lines."""
    return spark.read.schema(CHANGES).json(path)


def applications(changes: DataFrame) -> DataFrame:
    """A row for each changer of an event, with its place; events without changers have none."""
    return changes.select("path", "event", "corrupted", "corrupted_only", F.posexplode("changers").alias("place", "c")).select("path", "event", "corrupted", "corrupted_only", "place", "c.method", "c.id")


def rfc3339(c: Column, fraction: bool = True) -> Column:
    """A time in UTC; with fraction, its microseconds without zeros at the end."""
    if not fraction:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def write_lines(rows: DataFrame, path: str, line: str = "line") -> None:
    """Writes a text file of lines for each task below path."""
    rows.select(line).write.text(path)


def warnings_as_json(warnings: DataFrame) -> DataFrame:
    """One JSON line a warning, checksums (bytes) in lower-case hex, times in RFC 3339."""
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    line = F.struct("id", "file_id", "path", rfc3339(F.col("modification_time")).alias("modification_time"), "file_size", hexed("expected_checksum"), hexed("actual_checksum"), "discovered", "last_read", rfc3339(F.col("created")).alias("created"))
    return warnings.select("id", F.to_json(line).alias("line"))


def runs_as_json(runs: DataFrame) -> DataFrame:
    """One JSON line a run; keys of null snapshot name, id and time are left out."""
    line = F.struct("id", "snapshot_name", "snapshot_id", rfc3339(F.col("run_at")).alias("run_at"), "sync_mode", "state")
    return runs.select("id", F.to_json(line, {"ignoreNullFields": "true"}).alias("line"))


def parse_logfmt(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines with fields, a map of their keys and values (quotes taken off); over-long lines are left out, of repeated keys the last counts."""
    kept = lines.filter(F.octet_length(line) + 1 <= MOST_LINE)
    pattern = F.lit(_PAIR)
    keys, values = F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(2))
    bare = F.transform(values, lambda v: F.when(v.startswith('"'), F.regexp_replace(F.substring(v, 2, F.length(v) - 2), r"\\(.)", "$1")).otherwise(v))
    pairs = F.arrays_zip(keys.alias("k"), bare.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return kept.withColumn("fields", F.map_from_entries(last))


def snapshot_typed(logs: DataFrame, fields: str = "fields") -> DataFrame:
    """Typed columns of a snapshot from a map of fields; missing ones are 0, false or uninitialised, an unknown phase is unknown."""
    get = lambda k: F.try_element_at(fields, F.lit(k))
    number = lambda k, kind: F.coalesce(get(k).try_cast(kind), F.lit(0).cast(kind))
    whole = ["previous_queue_length", "queue_length", "enqueued", "consumption", "threshold"]
    real = ["deviation", "consumption_alpha", "consumption_ewma", "deviation_alpha", "deviation_ewma"]
    phase = F.when(get("phase").isNull(), "uninitialised").when(get("phase").isin(*PHASES), get("phase")).otherwise("unknown")
    return logs.select(
        "*", get("time").try_cast("timestamp").alias("time"), *(number(k, "bigint").alias(k) for k in whole), *(number(k, "double").alias(k) for k in real),
        F.coalesce(get("worker_num").try_cast("bigint"), get("worker_count").try_cast("bigint"), F.lit(0).cast("bigint")).alias("worker_num"),
        F.coalesce(get("exhausted") == "true", F.lit(False)).alias("exhausted"), phase.alias("phase"),
    )


def snapshots_as_text(snapshots: DataFrame) -> DataFrame:
    """The fixed columns in order as texts, the first as Unix seconds, the second in RFC 3339 (whole seconds); nulls stay in their column."""

    def text(c: str) -> Column:
        if c in ("time", "timestamp"):
            return F.unix_timestamp(F.col("time").cast("timestamp")).cast("string") if c == "time" else rfc3339(F.col("time"), fraction=False)
        if snapshots.schema[c].dataType.typeName() == "double":  # whole numbers without a point
            whole = (F.col(c) == F.floor(c)) & (F.abs(c) < 1e15)
            return F.when(whole, F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string"))
        return F.col(c).cast("string")

    return snapshots.select(*(text(c).alias(c) for c in SNAPSHOT))


def write_snapshots_csv(snapshots: DataFrame, path: str) -> None:
    """CSV files below path, each with a header; a null is an empty field."""
    snapshots_as_text(snapshots).write.csv(path, header=True, nullValue="")


def read_bench_csv(spark: SparkSession, path: str) -> DataFrame:
    return without_idle_concurrency(spark.read.schema(BENCH).csv(path, header=True))


def without_idle_concurrency(rows: DataFrame) -> DataFrame:
    """Runs that were not concurrent have a concurrency of 0."""
    return rows.withColumn("concurrency", F.when(F.col("concurrent"), F.col("concurrency")).otherwise(0))
