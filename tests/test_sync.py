import hashlib
import itertools

import pytest

from tallyward.operators import sync
from tallyward.sources.store import Store, open_bucketed, read_database, write_bucketed

OLD, NEW = "2020-01-01", "2020-01-02"


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, t string, last_seen long, to_be_read boolean, to_be_compared boolean").selectExpr(
        "monotonically_increasing_id() AS id", "0.5D AS rand", "path", "cast(t AS timestamp_ntz) AS modification_time", "1L AS file_size", "last_seen", "to_be_read", "to_be_compared", "'c' AS checksum", "1L AS last_read"
    )


def listed(spark, rows):
    return spark.createDataFrame(rows, "path string, t string").selectExpr("path", "cast(t AS timestamp_ntz) AS modification_time", "2L AS file_size")


@pytest.mark.parametrize("mode", ["full", "default", "incremental"])
def test_flags(spark, mode):
    cases = list(itertools.product([(True, False), (False, False), (False, True), (True, True)], [OLD, NEW]))
    f = files(spark, [(f"/{i}", OLD, 1, *flags) for i, (flags, _) in enumerate(cases)])
    inv = listed(spark, [(f"/{i}", t) for i, (_, t) in enumerate(cases)])
    got = {r.path: (r.to_be_read, r.to_be_compared) for r in sync.next_files(sync.sync_files(f, inv, 2, mode)).collect()}
    for i, ((read, compared), t) in enumerate(cases):
        if read and not compared:
            want = (True, False)
        elif mode == "incremental":
            want = (t != OLD, False)
        else:
            want = (True, t == OLD)
        assert got[f"/{i}"] == want, cases[i]


def test_merge_is_idempotent_and_agrees_with_union(spark):
    f = files(spark, [("/kept", OLD, 1, False, False), ("/gone", OLD, 1, False, False), ("/seen", OLD, 2, False, False)])
    inv = listed(spark, [("/kept", NEW), ("/new", NEW), ("/seen", NEW)])
    once = sync.sync_files(f, inv, 2)
    assert {r.action: r.n for r in sync.sync_counts(once).collect()} == {"update": 1, "delete": 1, "insert": 1, "unchanged": 1}
    key = lambda df: sorted(map(str, df.collect()))
    assert key(sync.next_files(once)) == key(sync.next_files_by_union(f, inv, 2))
    again = sync.sync_files(sync.next_files(once), inv, 2)
    assert {r.action for r in again.select("action").collect()} == {"unchanged"}
    assert key(sync.next_files(again)) == key(sync.next_files(once))


def test_duplicates_in_the_inventory(spark):
    f, inv = files(spark, [("/a", OLD, 1, False, False)]), listed(spark, [("/a", OLD), ("/a", NEW)])
    with pytest.raises(Exception, match="twice"):
        sync.sync_files(f, inv, 2, duplicates="reject").collect()
    assert [str(r.modification_time) for r in sync.sync_files(f, inv, 2, duplicates="latest").collect()] == [f"{NEW} 00:00:00"]


def test_empty_tables(spark):
    none, inv = files(spark, []), listed(spark, [])
    assert sync.sync_files(none, inv, 2).count() == 0
    assert [r.action for r in sync.sync_files(none, listed(spark, [("/a", OLD)]), 2).collect()] == ["insert"]
    assert [r.action for r in sync.sync_files(files(spark, [("/a", OLD, 1, True, True)]), inv, 2).collect()] == ["delete"]


@pytest.mark.parametrize("mode", [sync.FULL, sync.INCREMENTAL])
def test_new_ids(spark, tmp_path, mode):
    """Unique, above the greatest old one, and fixed once the merged table is stored."""
    f = files(spark, [(f"/{i}", OLD, 1, False, False) for i in range(200)])
    inv = listed(spark, [(f"/{i}", NEW) for i in range(100, 3000)])
    last = f.agg(sync.F.max("id")).first()[0]
    store = Store(spark, f"file://{tmp_path}")
    for merged in (sync.next_files(sync.sync_files(f, inv, 2, mode, first_id=last + 1)), sync.next_files_by_union(f, inv, 2, mode, first_id=last + 1)):
        kept = store.write("files", merged)
        old = {r.path: r.id for r in f.collect()}
        got = {r.path: r.id for r in kept.collect()}
        assert len(got) == len(set(got.values())) == 2900
        assert all(i == old[p] if p in old else i > last for p, i in got.items())
        assert got == {r.path: r.id for r in store.read("files").collect()}


def test_store_keeps_its_partitions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = spark.range(40).selectExpr("id", "id % 4 AS discovered")
    store.write("w", rows, ["discovered"])
    before = set(store.read("w").inputFiles())
    store.append("w", rows.selectExpr("id + 100 AS id", "discovered"))
    after = store.read("w")
    assert before < set(after.inputFiles()) and after.count() == 80
    replaced = store.replace("w", rows.filter("id = 3").selectExpr("id", "9L AS discovered"))
    assert replaced.filter("discovered = 9").count() == 1 and replaced.count() == 80
    assert "PartitionFilters: [isnotnull(discovered" in replaced.filter("discovered = 9")._jdf.queryExecution().explainString(replaced._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(ValueError):
        store.replace("w", rows.selectExpr("id + 1000 AS id", "discovered"))


def test_bytes_as_paths(spark):
    f = files(spark, [("/a", OLD, 1, False, False)]).withColumn("path", sync.F.col("path").cast("binary"))
    inv = listed(spark, [("/a", OLD), ("/b", OLD)]).withColumn("path", sync.F.col("path").cast("binary"))
    assert sorted(r.action for r in sync.sync_files(f, inv, 2).collect()) == ["insert", "update"]


def test_new_ids_have_no_gaps_and_depend_on_the_rows(spark):
    f, inv = files(spark, [("/old", OLD, 1, False, False)]), listed(spark, [(f"/{i}", NEW) for i in range(300)] + [("/old", NEW)])
    ids = lambda df: {r.path: r.id for r in df.filter("path <> '/old'").collect()}
    got = ids(sync.sync_files(f, inv, 2, first_id=1000))
    assert got == {p: 1000 + i for i, p in enumerate(sorted((f"/{i}" for i in range(300)), key=lambda p: hashlib.md5(p.encode()).hexdigest()))}
    assert got == ids(sync.sync_files(f, inv.repartition(9), 2, first_id=1000)) == ids(sync.sync_insert(f, inv.repartition(5), 2, first_id=1000))


def test_only_the_inventory_moves_to_a_bucketed_table(spark, tmp_path):
    f = files(spark, [(f"/{i}", OLD, 1, False, False) for i in range(100)])
    inv = listed(spark, [(f"/{i}", NEW) for i in range(50, 130)])
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = write_bucketed(f, "files_in_buckets", f"file://{tmp_path}/files", 8)
        merged = sync.sync_files(table, inv, 2, first_id=1000)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("files_in_buckets")]
        # from the full outer join down to the files table: a sort, no exchange
        assert "Bucketed: true" in plan and "Exchange" not in scan[scan.index("FullOuter") :]
        assert sorted(map(str, merged.collect())) == sorted(map(str, sync.sync_files(f, inv, 2, first_id=1000).collect()))
        spark.sql("DROP TABLE files_in_buckets")
        again = open_bucketed(spark, "files_again", f"file://{tmp_path}/files", f.schema, 8)
        assert again.count() == 100
        plan = sync.sync_files(again, inv, 2)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("FullOuter") : plan.index("files_again")]
    finally:
        spark.sql("DROP TABLE IF EXISTS files_again")
        for k, x in old.items():
            spark.conf.set(k, x)


def _files_read(df):
    """How many files the scans of a plan that has run took (without adaptive planning)."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_pages_read_each_folder_about_once(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "(id * 7919 % 4000) / 4000.0D AS rand", "concat('/', id) AS path", "1L AS file_size", "id % 5 <> 0 AS to_be_read").checkpoint()
    sync.with_rand_ranges(rows, 40).repartition("rand_range").write.partitionBy("rand_range").parquet(f"file://{tmp_path}/files")
    table = spark.read.parquet(f"file://{tmp_path}/files")
    want = [r.id for r in rows.filter("to_be_read").orderBy("rand", "id").collect()]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        place, got, read = (0.0, -1), [], 0
        while True:
            page = sync.next_files_page(table, *place, 80, ranges=40)
            found = page.collect()
            read += _files_read(page)
            if not found:
                break
            got += [r.id for r in found]
            place = (found[-1].rand, found[-1].id)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert got == want and read <= 40 * 5
    assert [r.id for r in sync.next_files_page(table, 0.25, 0, 700, ranges=40).collect()] == [r.id for r in sync.next_files_page(rows, 0.25, 0, 700).collect()]


@pytest.mark.parametrize("most", [1, 30, 20_000])
def test_samples_of_many_rows(spark, most):
    inv = spark.range(3000).selectExpr("concat('/', id) AS path", "timestamp_ntz'2020-01-01' AS modification_time", "id AS file_size").repartition(4)
    order = sorted((f"/{i}" for i in range(3000)), key=lambda p: hashlib.md5(("s" + p).encode()).hexdigest())
    for n in (0, 1, 1234, 3000, 9999):
        assert sorted(r.path for r in sync.sample_inventory(inv, n, "s", most).collect()) == sorted(order[:n]), n


def test_readers_keep_their_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    first = store.write("w", spark.range(10))
    second = store.append("w", spark.range(10, 15))
    store.append("w", spark.range(15, 16))
    assert (first.count(), second.count(), store.read("w").count()) == (10, 15, 16)
    store.write("w", spark.range(3))
    store.forget("w", keep=2)
    assert (second.count(), store.read("w").count()) == (15, 3)
    store.forget("w")
    assert store.read("w").count() == 3 and len(list((tmp_path / "w/data").iterdir())) == 1


def test_read_database(spark, tmp_path):
    """From the database that Spark's own jars bring along, in ranges of the key."""
    url = f"jdbc:derby:{tmp_path}/db"
    spark.range(1, 501).selectExpr("id", "concat('/', id) AS path").coalesce(1).write.option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").jdbc(f"{url};create=true", "files")
    got = read_database(spark, url, "files", lower=1, upper=500, partitions=4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r.id, r.path) for r in got.collect()) == [(i, f"/{i}") for i in range(1, 501)]
