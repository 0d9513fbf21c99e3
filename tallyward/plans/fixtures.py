"""Views over the given tables that stand for the audit's inputs: SQL that both Spark and DuckDB read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MICROS = {"spark": "make_dt_interval(0, 0, 0, cast((k * 137) % 1000000 AS decimal(18, 6)) / 1000000)", "duckdb": "to_microseconds((k * 137) % 1000000)"}
_RAND = {"spark": "cast(conv(substr(md5(path), 1, 8), 16, 10) AS double) / 4294967296.0", "duckdb": "(('0x' || substr(md5(path), 1, 8))::UBIGINT) / 4294967296.0"}
#: Braces name what a view reads.
VIEWS = {
    "all_k": "SELECT o_orderkey AS k, concat('/', o_orderpriority, '/', cast(o_orderkey AS string)) AS path, o_orderdate AS mtime, cast(floor(o_totalprice) AS bigint) AS size FROM {orders}",
    "files_prev": """SELECT k + 1 AS id, <RAND> AS rand, path, mtime AS modification_time, size AS file_size, cast(1 AS bigint) AS last_seen, (k % 7 IN (3, 5)) AS to_be_read, (k % 7 = 5) AS to_be_compared,
        CASE WHEN k % 7 <> 3 THEN sha1(path) END AS checksum, CASE WHEN k % 7 <> 3 THEN cast(1 AS bigint) END AS last_read FROM {all_k} WHERE k % 10 <> 0""",
    "inventory": """SELECT path, CASE WHEN k % 4 = 0 THEN mtime + INTERVAL 1 DAY ELSE mtime END AS modification_time, CASE WHEN k % 4 = 0 THEN size + 1 ELSE size END AS file_size FROM {all_k} WHERE k % 11 <> 0""",
    "files_run2": """SELECT k + 1 AS id, path, mtime AS modification_time, size AS file_size, cast(2 AS bigint) AS last_seen, true AS to_be_read, (k % 4 <> 0 AND k % 7 <> 3) AS to_be_compared,
        CASE WHEN k % 7 <> 3 THEN sha1(path) END AS checksum, CASE WHEN k % 7 <> 3 THEN cast(1 AS bigint) END AS last_read FROM {all_k} WHERE k % 11 <> 0""",
    "results": """SELECT k + 1 AS id, k % 100 AS pack_id, k AS pos, CASE WHEN k % 97 = 0 THEN sha1(concat('x', path)) ELSE sha1(path) END AS checksum FROM {all_k} WHERE k % 11 <> 0
        UNION ALL SELECT k + 1, 1000 + k % 100, k, sha1(concat('late', path)) FROM {all_k} WHERE k % 11 <> 0 AND k % 50 = 1
        UNION ALL SELECT 10000000 + k, 2000, k, sha1(path) FROM {all_k} WHERE k % 5000 = 0""",
    # a run a customer, the newest is 25, so that runs grow with the tables and the newest have warnings
    "runs": """SELECT cast(26 - c_custkey AS bigint) AS id, concat('run-', cast(26 - c_custkey AS string)) AS snapshot_name, CASE WHEN c_custkey % 6 <> 5 THEN cast(c_custkey + 100 AS bigint) END AS snapshot_id,
        CASE WHEN c_custkey % 2 = 0 THEN 'full' ELSE 'incremental' END AS sync_mode, CASE c_nationkey % 5 WHEN 0 THEN 'finished' WHEN 1 THEN 'aborted' WHEN 2 THEN 'workqueue' WHEN 3 THEN 'medasync' ELSE 'bogus' END AS state FROM {customer}""",
    "warnings": """SELECT k + 1 AS id, k + 1 AS file_id, path, mtime + <MICROS> AS modification_time, size AS file_size, sha1(path) AS expected_checksum, sha1(concat('x', path)) AS actual_checksum, k % 25 + 1 AS discovered, cast(1 AS bigint) AS last_read FROM {all_k} WHERE k % 97 = 0""",
    "probe_log": """SELECT cast(user_id % 20 AS bigint) AS log_id, ts, event_id, CASE event_type WHEN 'view' THEN 'Probed queue and calculated derivatives' WHEN 'click' THEN 'Calculated threshold' ELSE 'Calling schedule' END AS msg,
        cast(floor(value) AS bigint) AS queue_length, event_id % 40 AS enqueued FROM {events}""",
    "probes": "SELECT log_id, ts, event_id, queue_length, enqueued FROM {probe_log} WHERE msg = 'Probed queue and calculated derivatives'",
    "bench": "SELECT l_returnflag AS method, l_linenumber AS batch_size, cast(l_quantity AS int) AS transaction_size, (l_linestatus = 'O') AS concurrent, cast(l_suppkey % 8 AS int) AS concurrency, l_extendedprice AS total_duration FROM {lineitem}",
    "contents": "SELECT doc_id AS id, concat('/', source, '/', lang, '/', cast(doc_id AS string)) AS path, text AS content FROM {documents}",
    # applications of changers to files: a file has up to three, of which the flip corrupts; every file of the warnings view has the flip alone but for some
    "applied": """SELECT path, 0 AS place, 'append' AS method, '#0' AS id, false AS corrupted FROM {all_k} WHERE k % 13 = 0 AND k % 97 <> 0
        UNION ALL SELECT path, 1, 'replace', '#1', false FROM {all_k} WHERE k % 17 = 0
        UNION ALL SELECT path, 2, 'flip', '#2', true FROM {all_k} WHERE (k % 97 = 0 AND k % 5 <> 0) OR k % 101 = 0""",
    # list lines of which some don't fit the format
    "lines": """SELECT k, CASE k % 65 WHEN 0 THEN concat('1 1 7 ', path) WHEN 13 THEN concat('1 1 7 |99999999999999999999|', cast(mtime AS string), '| -- ', replace(path, ' ', '%20'))
        WHEN 26 THEN concat('1 1 7 |5|yesterday| -- ', path) WHEN 39 THEN concat('1 1 7 |5|', cast(mtime AS string), '| -- ', path, '%4') WHEN 52 THEN concat('1 1 7 |', repeat('0', 40), '|', cast(mtime AS string), '| -- ', path)
        ELSE concat('1 1 7 |', cast(size AS string), '|', cast(mtime AS string), '| -- /mnt/fs/.snapshots/s1', replace(path, ' ', '%20')) END AS line FROM {all_k}""",
    "listed": "SELECT k, CASE WHEN k % 19 = 0 THEN concat('/elsewhere', path) ELSE concat('/mnt/fs/.snapshots/s1', path) END AS path FROM {all_k}",
    "long_paths": "SELECT k, CASE WHEN k % 17 = 0 THEN concat(path, repeat('ü', 2050)) ELSE path END AS path FROM {all_k}",
    "log_lines": """SELECT event_id, concat('event_id=', cast(event_id AS string), ' level=debug msg="', msg, '" queue_length=', cast(queue_length AS string), ' enqueued=', cast(enqueued AS string), ' exhausted=', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END,
        CASE event_id % 5 WHEN 0 THEN ' phase=maintaining worker_num=4' WHEN 1 THEN ' phase=start-up worker_count=5' WHEN 2 THEN ' phase=other' ELSE '' END) AS line FROM {probe_log}""",
    "series": "SELECT log_id, ts, event_id, queue_length, enqueued, queue_length % 9 AS consumption, event_id % 30 AS threshold, queue_length < 15 AS exhausted FROM {probes}",
    "expected": "SELECT path, CASE WHEN k % 15 = 0 THEN size + 7 ELSE size END AS size FROM {all_k} WHERE k % 3 = 0 UNION ALL SELECT concat('/missing', path), size FROM {all_k} WHERE k % 300 = 0",
    "listing": "SELECT path, size AS file_size FROM {all_k} WHERE k % 11 <> 0 UNION ALL SELECT path, size FROM {all_k} WHERE k % 50 = 1",
}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("<RAND>", _RAND["spark"]).replace("<MICROS>", _MICROS["spark"])
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in dict.fromkeys(_NAME.findall(sql))})


def with_views(body: str) -> str:
    """DuckDB SQL: body (which names views in braces) after the definitions of those views."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for x in _NAME.findall(VIEWS[name]):
                add(x)
            order.append(name)

    for x in _NAME.findall(body):
        add(x)
    plain = lambda s: _NAME.sub(r"\1", s.replace("<RAND>", _RAND["duckdb"]).replace("<MICROS>", _MICROS["duckdb"]))
    ctes = ", ".join(f"{x} AS ({plain(VIEWS[x])})" for x in order)
    body = plain(body).strip()
    if ctes and body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes}, {body[5:]}"
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body
