"""A seeded audit from end to end: whatever is corrupted, and nothing else, is reported."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.functions.columns import sha1_hex
from tallyward.operators import analysis, reconcile, sync, writeback
from tallyward.sources.logs import parse_logfmt, rfc3339, write_snapshots_csv
from tallyward.sources.store import Store


def hashed(contents, files):
    return files.filter("to_be_read").join(contents, "path").select("id", sha1_hex(F.col("content")).alias("checksum"))


def run_audit(files, contents, run, mode):
    inventory = contents.select("path", "modification_time", F.octet_length("content").cast("bigint").alias("file_size"))
    files = sync.next_files(sync.sync_files(files, inventory, run, mode, first_id=run << 40))
    results = hashed(contents, files)
    return writeback.write_back(files, results, run), writeback.checksum_mismatches(files, results, run)


@pytest.mark.parametrize(("corrupt", "change", "incremental"), [(0.0, 0.03, True), (0.05, 0.2, True), (0.05, 0.1, False)])
def test_warnings_are_the_corruptions(spark, corrupt, change, incremental, tmp_path):
    start = spark.range(600).select(F.concat(F.lit("/f"), "id").alias("path"), F.encode(F.repeat(F.lit("ab"), F.col("id").cast("int") % 40), "UTF-8").alias("content"), F.expr("timestamp_ntz'2020-01-01'").alias("modification_time"))
    none = spark.createDataFrame([], "id long, rand double, path string, modification_time timestamp_ntz, file_size long, last_seen long, to_be_read boolean, to_be_compared boolean, checksum string, last_read long")
    keep = lambda df, n: (df.write.parquet(f"file://{tmp_path}/{n}"), spark.read.parquet(f"file://{tmp_path}/{n}"))[1]
    files, first = run_audit(none, start, 1, "full")
    assert first.count() == 0
    files = keep(files, "files1")
    p = spark.range(1).select(1 - F.sqrt(1 - F.lit(change))).first()[0]
    changers = [reconcile.Changer("#0", "append", p), reconcile.Changer("#1", "replace", p), reconcile.Changer("#2", "flip", corrupt, corrupt=True)]
    injected = keep(reconcile.inject_changes(start, changers, "s", "2021-01-01"), "injected")
    now = injected.select("path", "content", "modification_time")
    run = 2
    if incremental:
        files, warned = run_audit(files, now, run, "incremental")
        assert warned.count() == 0
        files, run = keep(files, "files2"), 3
    files, warned = run_audit(files, now, run, "full")
    folded = reconcile.fold_changers(reconcile.applied_changers(injected))
    assert reconcile.reconcile_warnings(warned, folded).count() == 0
    summary = reconcile.change_summary(start, folded).first()
    assert sum(summary) == 600
    assert summary.corrupted_only == warned.count()
    assert (corrupt > 0) == (warned.count() > 0)


def test_injection_repeats_and_keeps_sizes(spark):
    rows = spark.createDataFrame([("/a", b"x" * 50), ("/empty", b""), ("/one", b"y")], "path string, content binary").withColumn("modification_time", F.expr("timestamp_ntz'2020-01-01'"))
    all_of = [reconcile.Changer("r", "replace", 1.0), reconcile.Changer("f", "flip", 1.0, corrupt=True)]
    got = [reconcile.inject_changes(rows, all_of, "s", "2021-01-01").orderBy("path").collect() for _ in range(2)]
    assert got[0] == got[1]
    assert [len(r.content) for r in got[0]] == [50, 0, 1]
    assert [r.effective for r in got[0]][:2] == [True, False]
    assert all(len(r.applied) == 2 for r in got[0])


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", "t_")
    assert store.read("runs").count() == 0
    runs = spark.createDataFrame([(1, "nil"), (2, "nil")], "id long, state string")
    store.write("runs", runs)
    store.append("runs", runs.selectExpr("id + 2 AS id", "state"))
    store.replace("runs", spark.createDataFrame([(2, "finished")], runs.schema))
    assert {(r.id, r.state) for r in store.read("runs").collect()} == {(1, "nil"), (2, "finished"), (3, "nil"), (4, "nil")}
    with pytest.raises(ValueError):
        store.replace("runs", spark.createDataFrame([(9, "nil")], runs.schema))


def test_logfmt(spark):
    lines = spark.createDataFrame([('time=2019-01-01T00:00:10Z msg="a \\"b\\" c" n=4 empty= n=5 flag',), ("k=" + "v" * 65536,), ("",)], "line string")
    got = [r.fields for r in parse_logfmt(lines).collect()]
    assert got == [{"time": "2019-01-01T00:00:10Z", "msg": 'a "b" c', "n": "5", "empty": ""}, {}]


@pytest.mark.parametrize("most", [3, 50, 20_000])
def test_quantiles_of_large_small_and_tied_groups(spark, most):
    rng = np.random.default_rng(3)
    groups = {
        "wide": rng.lognormal(0, 3, 6000), "tied": rng.integers(0, 3, 5000).astype(float), "few": rng.normal(size=7), "one": np.array([4.0]), "same": np.full(900, -2.5),
        "two heaps": np.concatenate([rng.normal(0, 1e-9, 1000), rng.normal(1, 1e-9, 1000)]), "large": rng.normal(0, 1e307, 300), "ends": np.concatenate([np.full(400, -np.inf), rng.normal(size=401), np.full(10, np.inf)]), "zeros": np.array([-0.0, 0.0] * 50),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    shares = {"q05": 0.05, "median": 0.5, "q95": 0.95}
    got = {r.k: r for r in analysis.with_quantiles(df, ["k"], "x", shares, [F.count("x").alias("n")], most=most).collect()}
    assert len(got) == len(groups) + 2 and (got["none"].n, got["none"].median) == (0, None) and got[None].median == 1.5
    for k, v in groups.items():
        # between equal neighbours, which may be infinite, there is nothing to draw a line through
        low, high = (np.quantile(v, list(shares.values()), method=m) for m in ("lower", "higher"))
        with np.errstate(invalid="ignore"):
            want = np.where(low == high, low, np.quantile(v, list(shares.values())))
        assert got[k].n == len(v) and [got[k][n] for n in shares] == pytest.approx(want.tolist(), rel=1e-12), k


def test_no_task_ranks_a_group(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS k", "hash(id) * 1.0D AS x")
    plans = analysis.with_quantiles(df, ["k"], "x", {"median": 0.5}, [], most=500)
    sizes = plans.collect()
    assert len(sizes) == 2
    text = plans._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text  # no sketches

def test_times_keep_their_fractions(spark):
    times = ["2019-01-01 10:00:00", "2019-01-01 10:00:00.5", "2019-01-01 10:00:10.000420"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(rfc3339(F.col("t").cast("timestamp_ntz")).alias("t"))
    assert [r.t for r in got.collect()] == ["2019-01-01T10:00:00Z", "2019-01-01T10:00:00.5Z", "2019-01-01T10:00:10.00042Z"]


def test_snapshot_csv(spark, tmp_path):
    row = spark.sql("SELECT timestamp_ntz'2019-01-01 00:00:10' AS time, 10L AS previous_queue_length, 4L AS queue_length, false AS exhausted, 2L AS enqueued, 5L AS worker_num, 8L AS consumption, 1.5D AS deviation, 0.6D AS consumption_alpha, 2D AS consumption_ewma, 0.1D AS deviation_alpha, 0.2D AS deviation_ewma, 'maintaining' AS phase, 12L AS threshold")
    write_snapshots_csv(row.union(row.withColumn("time", F.lit(None).cast("timestamp_ntz"))).coalesce(1), f"file://{tmp_path}/csv")
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "time,timestamp,previous_queue_length,queue_length,exhausted,enqueued,worker_num,consumption,deviation,consumption_alpha,consumption_ewma,deviation_alpha,deviation_ewma,phase,threshold"
    assert sorted(lines[1:]) == [",,10,4,false,2,5,8,1.5,0.6,2,0.1,0.2,maintaining,12", "1546300810,2019-01-01T00:00:10Z,10,4,false,2,5,8,1.5,0.6,2,0.1,0.2,maintaining,12"]
