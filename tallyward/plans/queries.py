"""The registered queries, one or more an operator, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import columns as fn
from tallyward.operators import analysis, reconcile, runs, sync, writeback
from tallyward.plans.fixtures import view, with_views
from tallyward.sources import contents, filelist, logs
from tallyward.sources.store import Store, work_folder, write_bucketed
from tallyward.streaming.queues import stream_queue_ewma
from tallyward.streaming.writeback import laid_out_by_id, stream_late_results, stream_write_back

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RUN = 2
CREATED = datetime(2026, 1, 1)


def query(sql: str | None = None, **names: str):
    """Registers a function of (view) by its name; view(name) gives the DataFrame of a view or table."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


# sources and sinks


def _through_a_file(lines: DataFrame) -> DataFrame:
    folder = work_folder(lines.sparkSession, "lines")
    logs.write_lines(lines, folder)
    return lines.sparkSession.read.text(folder).withColumnRenamed("value", "line")


@query("SELECT CAST(1 AS BIGINT) AS inode, CAST(1 AS BIGINT) AS generation, CAST(7 AS BIGINT) AS snapshot_id, size AS file_size, mtime AS modification_time, concat('/mnt/fs/.snapshots/s1', path) AS path FROM {all_k} WHERE k % 13 <> 0")
def src1_read_filelist(v):
    return filelist.read_filelist(v("lines").select("line"), strict=False).withColumn("path", F.decode("path", "UTF-8"))


@query("SELECT line, CASE k % 65 WHEN 0 THEN 'format' WHEN 13 THEN 'number' WHEN 26 THEN 'time' WHEN 39 THEN 'path' ELSE 'length' END AS problem FROM {lines} WHERE k % 13 = 0")
def src2_filelist_errors(v):
    return filelist.filelist_errors(v("lines").select("line"))


@query("""WITH f AS (SELECT path, bool_or(corrupted) AS corrupted, bool_and(corrupted) AS corrupted_only FROM {applied} GROUP BY path)
SELECT a.path, 'changed' AS event, f.corrupted, f.corrupted_only, CAST(row_number() OVER (PARTITION BY a.path ORDER BY a.place) - 1 AS INTEGER) AS place, a.method, a.id FROM {applied} a JOIN f ON a.path = f.path""")
def src3_read_changelog(v):
    events = reconcile.fold_changers(v("applied")).select(F.to_json(F.struct(F.lit("changed").alias("event"), "path", "corrupted", "corrupted_only", "changers")).alias("line"))
    folder = work_folder(events.sparkSession, "changelog")
    logs.write_lines(events, folder)
    return logs.applications(logs.read_changelog(events.sparkSession, folder))


@query(r"""SELECT concat('{"id":', id, ',"file_id":', file_id, ',"path":"', path, '","modification_time":"', regexp_replace(strftime(modification_time, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', ''), 'Z","file_size":', file_size,
 ',"expected_checksum":"', expected_checksum, '","actual_checksum":"', actual_checksum, '","discovered":', discovered, ',"last_read":', last_read, ',"created":"2026-01-01T00:00:00Z"}') AS line FROM {warnings}""")
def src4_write_warnings_json(v):
    w = v("warnings").withColumns({c: F.unhex(c) for c in ("expected_checksum", "actual_checksum")})
    return _through_a_file(logs.warnings_as_json(w.withColumn("created", F.lit(CREATED).cast("timestamp_ntz"))))


@query(r"""SELECT concat('{"id":', id, ',"snapshot_name":"', snapshot_name, '"', CASE WHEN snapshot_id IS NULL THEN '' ELSE concat(',"snapshot_id":', snapshot_id) END,
 CASE WHEN id % 2 = 0 THEN concat(',"run_at":"', regexp_replace(strftime(TIMESTAMP '2026-01-01' + to_microseconds(abs(id) * 1500), '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', ''), 'Z"') ELSE '' END, ',"sync_mode":"', sync_mode, '","state":"', state, '"}') AS line FROM {runs}""")
def src5_write_runs_json(v):
    run_at = F.lit(CREATED).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.abs("id") * 1500).cast("decimal(18,6)") / 1_000_000)
    return _through_a_file(logs.runs_as_json(v("runs").withColumn("run_at", F.when(F.col("id") % 2 == 0, run_at))))


@query("SELECT event_id, msg, CAST(queue_length AS VARCHAR) AS queue_length, CAST(enqueued AS VARCHAR) AS enqueued FROM {probe_log}")
def src6_read_logfmt(v):
    got = logs.parse_logfmt(v("log_lines").select("line"))
    return got.select(F.col("fields")["event_id"].cast("bigint").alias("event_id"), *(F.col("fields")[c].alias(c) for c in ("msg", "queue_length", "enqueued")))


@query("""SELECT CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS "time", strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", CAST(event_id AS VARCHAR) AS previous_queue_length, CASE WHEN queue_length <> 7 THEN CAST(queue_length AS VARCHAR) END AS queue_length,
 CASE WHEN exhausted THEN 'true' ELSE 'false' END AS exhausted, CAST(enqueued AS VARCHAR) AS enqueued, '5' AS worker_num, CAST(consumption AS VARCHAR) AS consumption, '1.5' AS deviation, '0.25' AS consumption_alpha, '2' AS consumption_ewma, '0.125' AS deviation_alpha,
 CAST(threshold AS VARCHAR) AS deviation_ewma, 'maintaining' AS phase, CAST(threshold AS VARCHAR) AS threshold FROM {series}""")
def src7_write_snapshots_csv(v):
    number = {"deviation": 1.5, "consumption_alpha": 0.25, "consumption_ewma": 2.0, "deviation_alpha": 0.125}
    rows = v("series").withColumns({"time": F.col("ts"), "previous_queue_length": F.col("event_id"), "worker_num": F.lit(5), "phase": F.lit("maintaining"), "deviation_ewma": F.col("threshold").cast("double")} | {k: F.lit(x) for k, x in number.items()})
    folder = work_folder(rows.sparkSession, "snapshots")
    logs.write_snapshots_csv(rows.withColumn("queue_length", F.nullif("queue_length", F.lit(7))), folder)
    return rows.sparkSession.read.csv(folder, header=True)


@query("SELECT method, CAST(batch_size AS INTEGER) AS batch_size, transaction_size, concurrent, CASE WHEN concurrent THEN concurrency ELSE 0 END AS concurrency, total_duration FROM {bench}")
def src8_read_bench_csv(v):
    bench = v("bench").select("method", "batch_size", "transaction_size", "concurrent", "concurrency", "total_duration")
    folder = work_folder(bench.sparkSession, "bench")
    bench.write.csv(folder, header=True)
    return logs.read_bench_csv(bench.sparkSession, folder)


@query("SELECT id, CAST(strlen(content) AS BIGINT) AS bytes_read, sha1(content) AS checksum FROM {contents}")
def src9_checksum_contents(v):
    return contents.checksum_contents(v("contents"))


@query("""WITH t AS (SELECT doc_id // 25 AS id, string_agg(regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g'), chr(10) ORDER BY doc_id) || chr(10) AS content FROM {documents} GROUP BY 1)
SELECT CAST(id AS BIGINT) AS id, CAST(strlen(content) AS BIGINT) AS bytes_read, sha1(content) AS checksum FROM t""")
def src9_checksum_files(v):
    """The checksums of real files, one for each 25 documents, dealt by their sizes, and of one that isn't there, which is left out."""
    texts = v("documents").select(F.floor(F.col("doc_id") / 25).alias("part"), "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("text"))
    spark, folder = texts.sparkSession, work_folder(texts.sparkSession, "contents")
    texts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(folder)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("id"), "path", F.col("length").alias("file_size"))
    missing = spark.sql("SELECT -1L AS id, :path AS path, 10L AS file_size", {"path": f"{folder}/none"})
    return contents.checksum_files(listed.union(missing), tasks=8).withColumn("checksum", F.lower(F.hex("checksum")))


@query("""SELECT id, path, file_size, CASE WHEN id % 9 = 1 THEN 5 ELSE last_seen END AS last_seen, to_be_read FROM {files_prev}
UNION ALL SELECT id + 100000000, path, file_size, last_seen, false FROM {files_prev} WHERE to_be_read""")
def src10_table_store(v):
    files = v("files_prev").select("id", "path", "file_size", "last_seen", "to_be_read")
    store = Store(files.sparkSession, work_folder(files.sparkSession, "store"))
    store.write("files", files, ["to_be_read"])
    store.append("files", files.filter("to_be_read").withColumns({"id": F.col("id") + 100_000_000, "to_be_read": F.lit(False)}))
    return store.replace("files", files.filter("id % 9 = 1").withColumn("last_seen", F.lit(5).cast("bigint")))


# filters


@query("SELECT k, path, CASE WHEN starts_with(path, '/mnt/fs/.snapshots/s1/') THEN substr(path, 22) END AS cleaned FROM {listed}")
def flt1_clean_path(v):
    return v("listed").withColumn("cleaned", fn.clean_path(F.col("path"), "/mnt/fs", ".snapshots", "s1"))


@query("SELECT k, strlen(path) <= 4096 AS kept FROM {long_paths}")
def flt2_drop_long_paths(v):
    kept = fn.short_enough(F.col("path"))
    long = v("long_paths")
    return long.filter(kept).select("k", F.lit(True).alias("kept")).union(long.filter(~kept).select("k", F.lit(False)))


@query(r"SELECT k, path FROM {all_k} WHERE NOT (path LIKE '/1-URGENT/%' ESCAPE '\' OR path LIKE '%\_%' ESCAPE '\' OR path LIKE '%_77' ESCAPE '\')")
def flt3_exclude_patterns(v):
    return v("all_k").filter(~filelist.excluded(F.col("path"), ["/1-URGENT/%", r"%\_%", "%_77"])).select("k", "path")


@query("SELECT k, path FROM {all_k} WHERE path LIKE '/2-HIGH/%'")
def flt4_restrict_subpath(v):
    return v("all_k").filter(filelist.below(F.col("path"), "/2-HIGH/")).select("k", "path")


@query("SELECT id, rand, path, file_size FROM {files_prev} WHERE to_be_read")
def flt5_files_to_be_read(v):
    return sync.files_to_be_read(v("files_prev"))


@query("SELECT * FROM {runs} WHERE state NOT IN ('finished', 'aborted') ORDER BY id")
def flt6_incomplete_runs(v):
    return runs.incomplete_runs(v("runs"))


@query("SELECT bool_or(state NOT IN ('finished', 'aborted')) AS any_run, coalesce(bool_or(state NOT IN ('finished', 'aborted')) FILTER (id < 2), false) AS before_2 FROM {runs}")
def flt7_exists_incomplete(v):
    r = v("runs")
    return r.limit(1).select(F.lit(runs.exists_incomplete(r)).alias("any_run"), F.lit(runs.exists_incomplete(r, 2)).alias("before_2"))


@query("SELECT * FROM {runs} WHERE id = 7")
def flt8_run_by_id(v):
    return runs.run_by_id(v("runs"), 7)


@query("SELECT * FROM {warnings} WHERE discovered = 4 ORDER BY id")
def flt9_warnings_of_run(v):
    return runs.warnings_of_run(v("warnings"), 4)


@query("SELECT path, bool_or(corrupted) AS corrupted FROM {applied} GROUP BY path HAVING bool_and(corrupted)")
def flt10_corrupt_candidates(v):
    return reconcile.corrupt_candidates(reconcile.fold_changers(v("applied"))).select("path", "corrupted")


# joins

_UPDATED = """SELECT f.id, f.rand, f.path, i.modification_time, i.file_size, CAST(2 AS BIGINT) AS last_seen, {read} AS to_be_read, {compared} AS to_be_compared, f.checksum, f.last_read
FROM {{files_prev}} f JOIN {{inventory}} i ON f.path = i.path WHERE f.last_seen <> 2"""
_PENDING, _SAME = "(f.to_be_read AND NOT f.to_be_compared)", "f.modification_time = i.modification_time"
_FULL = _UPDATED.format(read="true", compared=f"(NOT {_PENDING} AND {_SAME})")
_INCREMENTAL = _UPDATED.format(read=f"({_PENDING} OR NOT {_SAME})", compared="false")
_INSERTED = """SELECT (SELECT max(id) FROM {files_prev}) + row_number() OVER (ORDER BY md5(i.path), i.path) AS id, i.path, (('0x' || substr(md5(i.path), 1, 8))::UBIGINT) / 4294967296.0 AS rand, i.modification_time, i.file_size, CAST(2 AS BIGINT) AS last_seen, true AS to_be_read, false AS to_be_compared, CAST(NULL AS VARCHAR) AS checksum, CAST(NULL AS BIGINT) AS last_read
FROM {inventory} i WHERE NOT EXISTS (SELECT 1 FROM {files_prev} f WHERE f.path = i.path)"""
_REMOVED = "SELECT f.* FROM {files_prev} f WHERE NOT EXISTS (SELECT 1 FROM {inventory} i WHERE f.path = i.path)"
_ROW = "id, path, rand, modification_time, file_size, last_seen, to_be_read, to_be_compared, checksum, last_read"


@query(_FULL)
def join1_sync_update_full(v):
    return sync.sync_update(v("files_prev"), v("inventory"), RUN, sync.FULL)


@query(_INCREMENTAL)
def join2_sync_update_incremental(v):
    return sync.sync_update(v("files_prev"), v("inventory"), RUN, sync.INCREMENTAL)


def _first_id(files: DataFrame) -> int:
    return (files.agg(F.max("id")).first()[0] or 0) + 1


@query(_INSERTED)
def join3_sync_insert(v):
    return sync.sync_insert(v("files_prev"), v("inventory"), RUN, first_id=_first_id(v("files_prev")))


@query(_REMOVED)
def join4_sync_delete(v):
    return sync.sync_delete(v("files_prev"), v("inventory"), RUN)


@query(f"WITH u AS ({_FULL}), n AS ({_INSERTED}), d AS ({_REMOVED}) SELECT {_ROW}, 'update' AS action FROM u UNION ALL SELECT {_ROW}, 'insert' FROM n UNION ALL SELECT {_ROW}, 'delete' FROM d")
def join5_sync_files(v):
    return sync.sync_files(v("files_prev"), v("inventory"), RUN, sync.FULL, first_id=_first_id(v("files_prev")))


@query(f"WITH u AS ({_FULL}), n AS ({_INSERTED}), d AS ({_REMOVED}) SELECT {_ROW}, 'update' AS action FROM u UNION ALL SELECT {_ROW}, 'insert' FROM n UNION ALL SELECT {_ROW}, 'delete' FROM d")
def join5_sync_files_bucketed(v):
    """The same merge with the files table in buckets of its path."""
    files = v("files_prev")
    spark, buckets = files.sparkSession, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = work_folder(spark, "bucketed")
    table = write_bucketed(files, "files_" + folder.rsplit("-", 1)[1], folder, buckets)
    return sync.sync_files(table, v("inventory"), RUN, sync.FULL, first_id=_first_id(table))


@query(f"WITH u AS ({_INCREMENTAL}), n AS ({_INSERTED}), d AS ({_REMOVED}) SELECT {_ROW}, 'update' AS action FROM u UNION ALL SELECT {_ROW}, 'insert' FROM n UNION ALL SELECT {_ROW}, 'delete' FROM d")
def join5_sync_files_incremental(v):
    return sync.sync_files(v("files_prev"), v("inventory"), RUN, sync.INCREMENTAL, duplicates="reject", first_id=_first_id(v("files_prev")))


_FIRST = "SELECT id, pack_id, pos, checksum FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pack_id, pos) AS n FROM {results}) WHERE n = 1"
_MISMATCHES = f"""WITH r AS ({_FIRST}) SELECT f.id AS file_id, f.path, f.modification_time, f.file_size, f.checksum AS expected_checksum, r.checksum AS actual_checksum, CAST(2 AS BIGINT) AS discovered, coalesce(f.last_read, 0) AS last_read
FROM {{files_run2}} f JOIN r ON f.id = r.id WHERE f.to_be_read AND f.to_be_compared AND f.checksum IS NOT NULL AND f.checksum <> r.checksum"""
_WRITTEN = f"""WITH r AS ({_FIRST}) SELECT f.id, f.path, f.modification_time, f.file_size, f.last_seen, CASE WHEN r.id IS NULL THEN f.to_be_read ELSE false END AS to_be_read, CASE WHEN r.id IS NULL THEN f.to_be_compared ELSE false END AS to_be_compared,
 CASE WHEN r.id IS NULL OR NOT f.to_be_read THEN f.checksum ELSE r.checksum END AS checksum, CASE WHEN r.id IS NULL OR NOT f.to_be_read THEN f.last_read ELSE CAST(2 AS BIGINT) END AS last_read FROM {{files_run2}} f LEFT JOIN r ON f.id = r.id"""


@query(_MISMATCHES)
def join6_checksum_mismatches(v):
    return writeback.checksum_mismatches(v("files_run2"), writeback.first_result(v("results")), RUN)


@query(_WRITTEN)
def join7_write_back(v):
    return writeback.write_back(v("files_run2"), writeback.first_result(v("results")), RUN)


@query("SELECT r.* FROM {results} r WHERE NOT EXISTS (SELECT 1 FROM {files_run2} f WHERE f.id = r.id)")
def join8_unknown_results(v):
    return writeback.unknown_results(v("results"), v("files_run2"))


@query("SELECT * FROM {warnings} WHERE discovered IN (SELECT id FROM {runs} ORDER BY id DESC LIMIT 5) ORDER BY id")
def join9_warnings_last_n_runs(v):
    return runs.warnings_last_n_runs(v("warnings"), v("runs"), 5)


@query("SELECT * FROM {warnings} WHERE discovered <> 4")
def join10_clear_warnings(v):
    return runs.clear_warnings(v("warnings"), v("warnings").filter("discovered = 4"))


@query("SELECT * FROM {files_prev} WHERE id IN (SELECT id FROM {results} WHERE pack_id = 7)")
def join11_files_by_ids(v):
    return sync.files_by_ids(v("files_prev"), v("results").filter("pack_id = 7"))


@query("""WITH c AS (SELECT path FROM {applied} GROUP BY path HAVING bool_and(corrupted))
SELECT coalesce(w.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'warning_not_in_changes' ELSE 'change_not_in_warnings' END AS status FROM {warnings} w FULL JOIN c ON w.path = c.path WHERE w.path IS NULL OR c.path IS NULL""")
def join12_reconcile_warnings(v):
    changes = reconcile.fold_changers(v("applied")).withColumn("path", F.concat(F.lit("/srv/root"), "path"))
    return reconcile.reconcile_warnings(v("warnings"), changes, "/srv/root/")


@query("""WITH l AS (SELECT path, count(*) AS n, min(file_size) AS low, max(file_size) AS high FROM {listing} GROUP BY path),
b AS (SELECT coalesce(l.path, e.path) AS path, n, low, high, e.size FROM l FULL JOIN {expected} e ON l.path = e.path)
SELECT path, 'missing' AS problem FROM b WHERE n IS NULL UNION ALL SELECT path, 'unexpected' FROM b WHERE size IS NULL UNION ALL SELECT path, 'duplicate' FROM b WHERE size IS NOT NULL AND n > 1
UNION ALL SELECT path, 'size_mismatch' FROM b WHERE low <> size OR high <> size""")
def join13_verify_filelist(v):
    return reconcile.verify_filelist(v("listing"), v("expected"))


@query("SELECT * FROM {inventory} ORDER BY md5(concat('7', path)), path LIMIT 500")
def join14_sample_inventory(v):
    return sync.sample_inventory(v("inventory"), 500, "7")


# aggregations


@query("SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total_size FROM {inventory}")
def agg1_inventory_totals(v):
    return sync.inventory_totals(v("inventory"))


@query("SELECT CAST(min(strlen(path)) AS BIGINT) AS min_length, CAST(max(strlen(path)) AS BIGINT) AS max_length, round(avg(strlen(path)), 6) AS mean_length FROM {inventory}")
def agg2_path_length_stats(v):
    return sync.path_length_stats(v("inventory")).withColumn("mean_length", F.round("mean_length", 6))


@query(f"WITH u AS ({_FULL}), n AS ({_INSERTED}), d AS ({_REMOVED}) SELECT 'update' AS action, count(*) AS n FROM u UNION ALL SELECT 'insert', count(*) FROM n UNION ALL SELECT 'delete', count(*) FROM d UNION ALL SELECT CASE WHEN strlen(path) <= 4096 THEN 'listed' ELSE 'skipped' END, count(*) FROM {{long_paths}} GROUP BY 1")
def agg3_sync_counts(v):
    return sync.sync_counts(sync.sync_files(v("files_prev"), v("inventory"), RUN), v("long_paths"))


def _packs(v):
    return v("files_prev").select(((F.col("id") - 1) % 500).alias("pack_id"), "id", F.col("rand").alias("position"), "path", "file_size")


@query("SELECT (id - 1) % 500 AS pack_id, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total_size FROM {files_prev} GROUP BY 1")
def agg4_pack_totals(v):
    return writeback.pack_totals(_packs(v))


@query("SELECT (id - 1) % 500 AS pack_id, string_agg(concat(id, ':', path), ',' ORDER BY rand, id) AS files FROM {files_prev} GROUP BY 1")
def agg5_collect_packs(v):
    return writeback.collect_packs(_packs(v)).select("pack_id", F.array_join(F.transform("files", lambda f: F.concat(f["id"].cast("string"), F.lit(":"), f["path"])), ",").alias("files"))


@query("SELECT path, bool_or(corrupted) AS corrupted, bool_and(corrupted) AS corrupted_only, string_agg(concat(method, id), ',' ORDER BY place) AS changers FROM {applied} GROUP BY path")
def agg6_fold_changers(v):
    return reconcile.fold_changers(v("applied")).withColumn("changers", F.array_join(F.transform("changers", lambda c: F.concat(c["method"], c["id"])), ","))


@query("""WITH f AS (SELECT path, bool_or(corrupted) AS c, bool_and(corrupted) AS o FROM {applied} GROUP BY path)
SELECT count(*) FILTER (c IS NULL) AS unchanged, count(*) FILTER (NOT c) AS changed, count(*) FILTER (c AND NOT o) AS corrupted, count(*) FILTER (o) AS corrupted_only FROM {all_k} k LEFT JOIN f ON k.path = f.path""")
def agg7_change_summary(v):
    return reconcile.change_summary(v("all_k"), reconcile.fold_changers(v("applied")))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Means to four digits; the small addition, in the SQL too, keeps exact halves (the inputs are cents) off the rounding limit."""
    return df.withColumns({n: F.round(F.col(n) + 0.0000021, 4) for n in names})


@query("SELECT method, min(total_duration) AS min, max(total_duration) AS max, round(avg(total_duration) + 0.0000021, 4) AS mean, round(quantile_cont(total_duration, 0.05) + 0.0000021, 4) AS q05 FROM {bench} GROUP BY method")
def agg8_bench_by_method(v):
    return _rounded(analysis.bench_by_method(v("bench")), "mean", "q05")


_PARAM = "SELECT method, '{p}' AS param, {p} AS value, round(avg(total_duration) + 0.0000021, 4) AS mean, round(median(total_duration) + 0.0000021, 4) AS median, min(total_duration) AS min, max(total_duration) AS max, round(quantile_cont(total_duration, 0.05) + 0.0000021, 4) AS q05 FROM {{bench}} GROUP BY method, {p}"


@query(" UNION ALL ".join(_PARAM.format(p=p) for p in ("batch_size", "transaction_size", "concurrency")))
def agg9_bench_by_params(v):
    return _rounded(analysis.bench_by_params(v("bench"), ["batch_size", "transaction_size", "concurrency"]), "mean", "median", "q05")


_PARAMS = "SELECT method, '{a},{b}' AS param, concat({a}, ',', {b}) AS value, round(avg(total_duration) + 0.0000021, 4) AS mean, round(median(total_duration) + 0.0000021, 4) AS median, min(total_duration) AS min, max(total_duration) AS max, round(quantile_cont(total_duration, 0.05) + 0.0000021, 4) AS q05 FROM {{bench}} GROUP BY method, {a}, {b}"
_PAIRS = [("transaction_size", "concurrency"), ("batch_size", "concurrency")]


@query(" UNION ALL ".join(_PARAMS.format(a=a, b=b) for a, b in _PAIRS))
def agg9_bench_by_param_pairs(v):
    return _rounded(analysis.bench_by_params(v("bench"), _PAIRS), "mean", "median", "q05")


_CASES = "SELECT l_returnflag AS case, l_linestatus AS scenario, CASE WHEN l_linenumber % 2 = 0 THEN 'update' ELSE 'insert' END AS operation, l_extendedprice AS duration FROM {lineitem}"


def _cases(v):
    operation = F.when(F.col("l_linenumber") % 2 == 0, "update").otherwise("insert")
    return v("lineitem").select(F.col("l_returnflag").alias("case"), F.col("l_linestatus").alias("scenario"), operation.alias("operation"), F.col("l_extendedprice").alias("duration"))


@query(f'WITH c AS ({_CASES.replace(" AS case", chr(32) + "AS kase")}) SELECT kase AS "case", scenario, operation, round(median(duration) + 0.0000021, 4) AS median, round(avg(duration) + 0.0000021, 4) AS mean, round(quantile_cont(duration, 0.95) + 0.0000021, 4) AS q95 FROM c GROUP BY ALL')
def agg10_bench_cases(v):
    return _rounded(analysis.bench_cases(_cases(v), ["case", "scenario", "operation"], "duration"), "median", "mean", "q95")


@query(f'WITH c AS ({_CASES.replace(" AS case", chr(32) + "AS kase")}) SELECT kase AS "case", round(median(duration) + 0.0000021, 4) AS median FROM c WHERE scenario = \'O\' AND operation = \'update\' GROUP BY ALL')
def agg10_case_order(v):
    return _rounded(analysis.case_order(analysis.bench_cases(_cases(v), ["case", "scenario", "operation"], "duration"), "O", "update"), "median")


@query("SELECT method, concurrency, batch_size, round(avg(total_duration) + 0.0000021, 4) AS mean FROM {bench} GROUP BY ALL")
def agg11_bench_mean_runs(v):
    return _rounded(analysis.bench_mean_runs(v("bench"), ["method", "concurrency", "batch_size"], "total_duration"), "mean")


_SECONDS = "epoch_us(ts) / 1e6"


@query(f"WITH w AS (SELECT log_id, exhausted, {_SECONDS} AS time, {_SECONDS} - lag({_SECONDS}) OVER (PARTITION BY log_id ORDER BY ts, event_id) AS width FROM {{series}}) SELECT log_id, round(coalesce(sum(width) FILTER (exhausted), 0) / max(time), 9) AS inefficiency FROM w GROUP BY log_id")
def agg12_queue_inefficiency(v):
    series = v("series").withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return analysis.queue_inefficiency(series, order=("ts", "event_id")).withColumn("inefficiency", F.round("inefficiency", 9))


# windows


@query(_FIRST)
def win1_first_result(v):
    return writeback.first_result(v("results"))


@query("SELECT id, pack_id, pos, checksum FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pack_id, pos) AS n FROM {results}) WHERE n > 1")
def win1_later_results(v):
    return writeback.later_results(v("results"))


@query("""WITH c AS (SELECT id, path, file_size, row_number() OVER (ORDER BY rand, id) AS rn, sum(file_size) OVER (ORDER BY rand, id) AS upto FROM {files_prev}),
s AS (SELECT CAST(0 AS BIGINT) AS pack_id, CAST(0 AS BIGINT) AS start, CAST(0 AS HUGEINT) AS before, (SELECT min(rn) FROM c WHERE upto >= 5242880 OR rn = 1000) AS stop
 UNION ALL SELECT s.pack_id + 1, s.stop, x.upto, (SELECT min(rn) FROM c WHERE rn > s.stop AND (c.upto >= x.upto + 5242880 OR rn = s.stop + 1000)) FROM s JOIN c x ON x.rn = s.stop)
SELECT id, path, file_size, s.pack_id, CAST(c.rn - s.start - 1 AS BIGINT) AS position FROM c JOIN s ON c.rn > s.start AND (s.stop IS NULL OR c.rn <= s.stop)""")
def win2_build_packs(v):
    """The packs of a single walk, here over 16 ranges."""
    return writeback.build_packs(v("files_prev").withColumn("to_be_read", F.lit(True)), ranges=16)


@query("SELECT method, batch_size, transaction_size, concurrent, concurrency, total_duration FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY total_duration) AS n FROM {bench}) WHERE n = 1")
def win3_best_params(v):
    return analysis.best_params(v("bench"), ["method"])


@query("SELECT method, batch_size, transaction_size, concurrent, concurrency, total_duration FROM (SELECT *, rank() OVER (PARTITION BY method, concurrency ORDER BY total_duration) AS n FROM {bench}) WHERE n = 1")
def win3_best_params_by_concurrency(v):
    return analysis.best_params(v("bench"), ["method", "concurrency"])


@query("""WITH k AS (SELECT log_id, ts, event_id, CASE WHEN msg = 'Calculated threshold' THEN 'S' ELSE 'O' END AS kind FROM {probe_log} WHERE msg <> 'Calling schedule'),
m AS (SELECT *, lag(kind) OVER (PARTITION BY log_id ORDER BY ts, event_id) AS before FROM k), e AS (SELECT * FROM m WHERE (kind = 'O' AND coalesce(before <> 'O', true)) OR (kind = 'S' AND before = 'O')),
n AS (SELECT log_id, ts, event_id, kind, lead(ts) OVER (PARTITION BY log_id ORDER BY ts, event_id) AS scheduled_ts, lead(event_id) OVER (PARTITION BY log_id ORDER BY ts, event_id) AS scheduled_event_id FROM e)
SELECT log_id, ts, event_id, scheduled_ts, scheduled_event_id FROM n WHERE kind = 'O' AND scheduled_ts IS NOT NULL""")
def win4_pair_snapshots(v):
    paired = analysis.pair_snapshots(v("probe_log"), observed=F.col("msg") == logs.OBSERVED, scheduled=F.col("msg") == logs.SCHEDULED)
    return paired.select("log_id", "ts", "event_id", "scheduled_ts", "scheduled_event_id")


_CONSUMED = """SELECT log_id, ts, event_id, queue_length, enqueued, CAST(greatest(0, coalesce(lag(queue_length) OVER w, 0) + enqueued - queue_length) AS BIGINT) AS consumption, queue_length = 0 AS exhausted,
 coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0.0) AS elapsed, row_number() OVER w AS rn FROM {probes} WINDOW w AS (PARTITION BY log_id ORDER BY ts, event_id)"""


@query(f"WITH c AS ({_CONSUMED}) SELECT log_id, ts, event_id, queue_length, enqueued, consumption, exhausted, elapsed FROM c")
def win5_queue_consumption(v):
    return analysis.queue_consumption(v("probes"))


_EWMA = f"""WITH c AS ({_CONSUMED}), s AS (SELECT log_id, ts, event_id, consumption, rn, CAST(0 AS DOUBLE) AS deviation, CAST(0 AS DOUBLE) AS alpha, CAST(0 AS DOUBLE) AS ewma, CAST(0 AS DOUBLE) AS spread FROM c WHERE rn = 1
UNION ALL SELECT c.log_id, c.ts, c.event_id, c.consumption, c.rn, abs(c.consumption - s.ewma * c.elapsed), 1 - exp(-c.elapsed / 10.0),
 CASE WHEN c.elapsed > 0 THEN exp(-c.elapsed / 10.0) * s.ewma + (1 - exp(-c.elapsed / 10.0)) * c.consumption / c.elapsed ELSE s.ewma END,
 CASE WHEN c.elapsed > 0 THEN 0.9 * s.spread + 0.1 * abs(c.consumption - s.ewma * c.elapsed) / c.elapsed ELSE s.spread END FROM s JOIN c ON c.log_id = s.log_id AND c.rn = s.rn + 1)"""


@query(f"{_EWMA} SELECT log_id, ts, event_id, consumption, round(deviation, 4) AS deviation, round(alpha, 4) AS consumption_alpha, round(ewma, 6) AS consumption_ewma, round(spread, 6) AS deviation_ewma FROM s")
def win6_queue_ewma(v):
    got = analysis.queue_ewma(analysis.queue_consumption(v("probes")))
    return got.withColumns({c: F.round(c, n) for c, n in (("deviation", 4), ("consumption_alpha", 4), ("consumption_ewma", 6), ("deviation_ewma", 6))})


@query("""WITH w AS (SELECT *, lag(queue_length) OVER o AS before, lead(enqueued) OVER o AS more FROM {series} WINDOW o AS (PARTITION BY log_id ORDER BY ts, event_id))
SELECT log_id, event_id, 'refill' AS rule FROM w WHERE before + enqueued < 12 UNION ALL SELECT log_id, event_id, 'drained' FROM w WHERE queue_length + consumption < 12 UNION ALL SELECT log_id, event_id, 'starved' FROM w WHERE queue_length + more < threshold""")
def win7_queue_invariants(v):
    return analysis.queue_invariants(v("series"), 12).select("log_id", "event_id", "rule")


@query("""WITH m AS (SELECT log_id, ts, event_id, queue_length, CASE WHEN queue_length > 60 THEN true WHEN queue_length < 20 THEN false END AS mark FROM {probes})
SELECT log_id, event_id, queue_length, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused FROM m""")
def win8_backpressure_state(v):
    return analysis.backpressure_state(v("probes"), high=60, low=20).select("log_id", "event_id", "queue_length", "paused")


# sorts and limits


@query("SELECT * FROM (SELECT * FROM {runs} ORDER BY id DESC LIMIT 6) ORDER BY id")
def ord1_last_n_runs(v):
    return runs.last_n_runs(v("runs"), 6)


@query("SELECT * FROM {runs} ORDER BY id")
def ord2_list_runs(v):
    return runs.listed(v("runs"))


@query("SELECT * FROM {warnings} ORDER BY id")
def ord2_list_warnings(v):
    return runs.listed(v("warnings"))


@query("SELECT id, rand, path, file_size FROM {files_prev} WHERE to_be_read AND (rand > 0.5 OR (rand = 0.5 AND id > 0)) ORDER BY rand, id LIMIT 100")
def ord3_next_files_page(v):
    return sync.next_files_page(v("files_prev"), 0.5, 0, 100)


@query("SELECT id, rand, path, file_size FROM {files_prev} WHERE to_be_read AND (rand > 0.3 OR (rand = 0.3 AND id > 0)) ORDER BY rand, id LIMIT 500")
def ord3_next_files_page_by_ranges(v):
    """From a table in folders of ranges of rand."""
    files = v("files_prev")
    store = Store(files.sparkSession, work_folder(files.sparkSession, "ranges"))
    laid_out = store.write("files", sync.with_rand_ranges(files, 20).repartition("rand_range"), ["rand_range"])
    return sync.next_files_page(laid_out, 0.3, 0, 500, ranges=20)


@query("SELECT * FROM {runs} WHERE state NOT IN ('finished', 'aborted') AND (id <= 14 OR NOT EXISTS (SELECT 1 FROM {runs} r WHERE r.id = 14 AND r.state NOT IN ('finished', 'aborted')))")
def ord4_runs_to_continue(v):
    return runs.runs_to_continue(v("runs"), 14)


@query("SELECT k AS position, path FROM {all_k} ORDER BY k LIMIT 250")
def ord5_first_n_inventory(v):
    return sync.first_n(v("all_k").select(F.col("k").alias("position"), "path"), 250)


# set operations


@query("WITH c AS (SELECT path FROM {applied} GROUP BY path HAVING bool_and(corrupted)) SELECT path FROM c EXCEPT SELECT path FROM {warnings}")
def set1_unreported(v):
    return reconcile.path_difference(reconcile.corrupt_candidates(reconcile.fold_changers(v("applied"))), v("warnings"))


@query("WITH c AS (SELECT path FROM {applied} GROUP BY path HAVING bool_and(corrupted)) SELECT path FROM {warnings} EXCEPT SELECT path FROM c")
def set1_unexpected(v):
    return reconcile.path_difference(v("warnings"), reconcile.corrupt_candidates(reconcile.fold_changers(v("applied"))))


@query("SELECT path, count(*) AS n FROM {listing} GROUP BY path HAVING count(*) > 1")
def set2_duplicate_paths(v):
    return sync.duplicate_paths(v("listing"))


@query(f"WITH u AS ({_FULL}), n AS ({_INSERTED}) SELECT {_ROW} FROM u UNION ALL SELECT {_ROW} FROM n")
def set3_next_files_table(v):
    return sync.next_files_by_union(v("files_prev"), v("inventory"), RUN, first_id=_first_id(v("files_prev")))


# scalar functions


@query("SELECT k, path, false AS bad FROM {all_k} WHERE k % 13 <> 0 UNION ALL SELECT k, NULL, true FROM {all_k} WHERE k % 13 = 0")
def fn1_percent_decode(v):
    coded = F.concat(F.replace("path", F.lit(" "), F.lit("%20")), F.when(F.col("k") % 13 == 0, "%4").otherwise(""))
    return v("all_k").select("k", F.decode(fn.percent_decode(coded), "UTF-8").alias("path")).withColumn("bad", F.col("path").isNull())


@query("SELECT k, sha1(path) AS checksum FROM {all_k}")
def fn2_sha1_hex(v):
    return v("all_k").select("k", fn.sha1_hex(F.col("path")).alias("checksum"))


@query("SELECT k, concat('/mnt/fs/.snapshots/s1', path) AS path FROM {all_k}")
def fn3_snapshot_path(v):
    return v("all_k").select("k", fn.snapshot_path(F.col("path"), "/mnt/fs/", ".snapshots", "s1").alias("path"))


@query("SELECT id, CASE WHEN state = 'bogus' THEN 'invalid' ELSE state END AS state, sync_mode FROM {runs}")
def fn4_parse_state_and_mode(v):
    return v("runs").select("id", fn.parse_state(F.col("state")).alias("state"), fn.parse_mode(F.col("sync_mode")).alias("sync_mode"))


@query("""SELECT event_id, queue_length, enqueued, event_id % 3 = 0 AS exhausted, CASE event_id % 5 WHEN 0 THEN 'maintaining' WHEN 1 THEN 'start-up' WHEN 2 THEN 'unknown' ELSE 'uninitialised' END AS phase,
 CAST(CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 0 END AS BIGINT) AS worker_num, CAST(0 AS BIGINT) AS threshold FROM {probe_log}""")
def fn5_snapshot_typed(v):
    return logs.snapshot_typed(logs.parse_logfmt(v("log_lines"))).select("event_id", "queue_length", "enqueued", "exhausted", "phase", "worker_num", "threshold")


@query("SELECT l_orderkey, l_linenumber, round(1 - sqrt(1 - l_discount), 9) AS likelihood FROM {lineitem}")
def fn6_per_changer_likelihood(v):
    return v("lineitem").select("l_orderkey", "l_linenumber", F.round(fn.per_changer_likelihood(F.col("l_discount")), 9).alias("likelihood"))


@query("SELECT k, (('0x' || substr(md5(concat('s', path)), 1, 8))::UBIGINT) / 4294967296.0 AS rand FROM {all_k}")
def fn7_uniform_rand(v):
    return v("all_k").select("k", fn.uniform_rand("s", F.col("path")).alias("rand"))


# streams


def _streamed(v, name: str, parts: list[DataFrame], schema) -> DataFrame:
    """A stream over parts that are written one after another."""
    spark = parts[0].sparkSession
    folder = work_folder(spark, name)
    for p in parts:
        p.write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def _result_stream(v) -> DataFrame:
    results = v("results")
    return _streamed(v, "results", [results.filter(c) for c in ("pack_id < 50", "pack_id >= 50 AND pack_id < 1000", "pack_id >= 1000")], results.schema)


@query(_WRITTEN)
def str1_stream_write_back(v):
    files = v("files_run2")
    return stream_write_back(files.sparkSession, files, _result_stream(v), RUN, refuse=False)[0]


@query(_MISMATCHES)
def str1_stream_warnings(v):
    files = v("files_run2")
    return stream_write_back(files.sparkSession, files, _result_stream(v), RUN, refuse=False)[1]


@query(_WRITTEN)
def str1_stream_write_back_strict(v):
    """With unknown results refused, over a table laid out by id; at every second batch a log as long as the table is folded into it."""
    files, results = v("files_run2"), v("results")
    store = Store(files.sparkSession, work_folder(files.sparkSession, "files"))
    laid_out = store.write("files", laid_out_by_id(files))
    known = results.join(files.select("id"), "id", "left_semi")
    stream = _streamed(v, "known", [known.filter(c) for c in ("pack_id < 50", "pack_id >= 50 AND pack_id < 1000", "pack_id >= 1000")], known.schema)
    return stream_write_back(files.sparkSession, laid_out, stream, RUN, fold_every=2)[0]


@query(f"WITH r AS ({_FIRST}) SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM {{files_run2}} f WHERE f.id = r.id)")
def str1_stream_unknown(v):
    files = v("files_run2")
    return stream_write_back(files.sparkSession, files, _result_stream(v), RUN, refuse=False)[2].select("id", "pack_id", "pos", "checksum")


@query("SELECT DISTINCT id FROM {results} WHERE id IN (SELECT id FROM {files_prev} WHERE to_be_read)")
def str2_stream_late_results(v):
    files = v("files_prev")
    return stream_late_results(files.sparkSession, _result_stream(v), files).select("id")


@query(f"{_EWMA} SELECT log_id, event_id, consumption, round(ewma, 6) AS consumption_ewma, round(spread, 6) AS deviation_ewma FROM s")
def str3_stream_queue_ewma(v):
    probes = v("probes").select("log_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), "queue_length", "enqueued")
    spark, folder = probes.sparkSession, work_folder(probes.sparkSession, "probes")
    cuts = probes.approxQuantile("seconds", [i / 6 for i in range(1, 6)], 0.01)
    # a part arrives when the one before has been taken, as batches must come in order
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
        part = probes.filter((F.col("seconds") > low) & (F.col("seconds") <= high))
        part.write.mode("append").parquet(f"{folder}/in")
        out = stream_queue_ewma(spark, spark.readStream.schema(probes.schema).parquet(f"{folder}/in"), f"{folder}/work")
    out = out.drop("late")
    return out.withColumns({c: F.round(c, 6) for c in ("consumption_ewma", "deviation_ewma")})


# changes

_CHANGERS = [reconcile.Changer("#0", "append", 0.3), reconcile.Changer("#1", "replace", 0.3), reconcile.Changer("#2", "flip", 0.2, corrupt=True)]
_APPLIES = "(('0x' || substr(md5(concat('seed', path, '{i}')), 1, 8))::UBIGINT) / 4294967296.0 <= {p}"
_ON = [_APPLIES.format(i=c.id, p=c.likelihood) for c in _CHANGERS]


@query(f"""SELECT path, CAST(strlen(content) + CASE WHEN {_ON[0]} THEN 100 ELSE 0 END AS BIGINT) AS bytes, CASE WHEN {_ON[0]} OR {_ON[1]} THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' END AS modification_time,
 concat(CASE WHEN {_ON[0]} THEN '#0' ELSE '' END, CASE WHEN {_ON[1]} THEN '#1' ELSE '' END, CASE WHEN {_ON[2]} THEN '#2' ELSE '' END) AS applied FROM {{contents}}""")
def udf1_inject_changes(v):
    files = v("contents").withColumn("modification_time", F.lit(datetime(2020, 1, 1)).cast("timestamp_ntz"))
    changed = reconcile.inject_changes(files, _CHANGERS, "seed", "2026-01-01 00:00:00")
    return changed.select("path", F.octet_length("content").cast("bigint").alias("bytes"), "modification_time", F.array_join(F.transform("applied", lambda a: a["id"]), "").alias("applied"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest whole audit: inventory merged into the table, contents hashed, corrupt files reported. The merged table is stored, so that its new ids stay."""
    files = view(spark, sf_dir, "files_prev")
    first_id = (files.agg(F.max("id")).first()[0] or 0) + 1
    merged = sync.next_files(sync.sync_files(files, view(spark, sf_dir, "inventory"), RUN, sync.FULL, first_id=first_id))
    synced = Store(spark, work_folder(spark, "audit")).write("files", merged)
    contents_now = view(spark, sf_dir, "all_k").select("path", F.when(F.col("k") % 97 == 0, F.concat(F.lit("x"), "path")).otherwise(F.col("path")).alias("content"))
    read = synced.filter("to_be_read").join(contents_now, "path").select("id", fn.sha1_hex(F.col("content")).alias("checksum"))
    return writeback.checksum_mismatches(synced, read, RUN)


QUERIES["audit"] = audit
ORACLES["audit"] = with_views(f"""WITH u AS ({_FULL}) SELECT u.id AS file_id, u.path, u.modification_time, u.file_size, u.checksum AS expected_checksum, sha1(concat('x', u.path)) AS actual_checksum, CAST(2 AS BIGINT) AS discovered, coalesce(u.last_read, 0) AS last_read
FROM u JOIN {{all_k}} k ON k.path = u.path WHERE u.to_be_compared AND u.checksum IS NOT NULL AND k.k % 97 = 0""")
