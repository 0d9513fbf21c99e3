"""Analysis of queue logs: one long queue over many ranges gives the same rows as one task."""

import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import analysis
from tallyward.streaming.queues import follow_queues, read_queues

HOT = 40


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = []
    for queue, n in ((1, 900), (2, 150), (3, 39), (4, 1), (None, 60)):
        at = 0.0
        for i in range(n):
            at += rng.choice([0.0, 0.5, 1.0, 20.0])
            rows.append((queue, at, i, rng.randrange(60), rng.randrange(30), rng.randrange(9), rng.randrange(30), rng.random() < 0.4, rng.choice("OSX"), at))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "log_id long, ts double, event_id long, queue_length long, enqueued long, consumption long, threshold long, exhausted boolean, kind string, time double").repartition(5).cache()


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


OPERATORS = {
    "pair": lambda s, n: analysis.pair_snapshots(s, observed=F.col("kind") == "O", scheduled=F.col("kind") == "S", hot_rows=n),
    "consumption": lambda s, n: analysis.queue_consumption(s.drop("consumption", "exhausted"), hot_rows=n),
    "emptied": lambda s, n: analysis.queue_consumption(s.drop("consumption", "exhausted"), emptied="threshold", hot_rows=n),
    "ewma": lambda s, n: analysis.queue_ewma(analysis.queue_consumption(s.drop("consumption", "exhausted")), hot_rows=n),
    "ewma from a start": lambda s, n: analysis.queue_ewma(analysis.queue_consumption(s.drop("consumption", "exhausted")).withColumns({"elapsed": F.when(F.col("log_id") < 3, F.col("elapsed") + 0.5).otherwise(F.col("elapsed")), "e": F.when(F.col("log_id") < 3, 2.5), "d": F.lit(0.5)}), start=("e", "d"), hot_rows=n),
    "invariants": lambda s, n: analysis.queue_invariants(s, 12, hot_rows=n),
    "backpressure": lambda s, n: analysis.backpressure_state(s, high=50, low=5, hot_rows=n),
    "inefficiency": lambda s, n: analysis.queue_inefficiency(s, order=("time", "event_id"), hot_rows=n),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_long_queues_in_ranges(spark, series, name, monkeypatch):
    want = rows_of(OPERATORS[name](series, 10**9))
    assert want
    for broadcast in (200_000, 0):
        monkeypatch.setattr(analysis, "MOST_BROADCAST", broadcast)
        assert rows_of(OPERATORS[name](series, HOT)) == want


def test_one_queue_uses_many_tasks(spark, series):
    dealt = analysis.deal(series.filter("log_id = 1"), "log_id", ("ts", "event_id"), HOT)
    sizes = [r["count"] for r in dealt.rows.groupBy("_range").count().collect()]
    assert dealt.hot and len(sizes) > 15 and max(sizes) < 4 * HOT
    plan = dealt.neighbours(before={"b": F.col("queue_length")}).rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(log_id" in plan and "_range" in plan


def test_ewma_of_a_plain_walk(spark, series):
    consumed = analysis.queue_consumption(series.drop("consumption", "exhausted"))
    got = {(r.log_id, r.event_id): tuple(r)[-4:] for r in analysis.queue_ewma(consumed, hot_rows=HOT).collect()}
    state, before = (0.0, 0.0), ()
    for r in sorted(consumed.collect(), key=lambda r: (r.log_id or 0, r.ts, r.event_id)):
        want = analysis.ewma_step(state, r.consumption, r.elapsed, r.log_id != before)
        state, before = want[2:], r.log_id
        assert got[r.log_id, r.event_id] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("hot_rows", [None, HOT])
def test_streamed_queues_equal_the_batch(spark, series, tmp_path, hot_rows):
    probes = series.filter("log_id IS NOT NULL").select("log_id", "event_id", F.col("ts").alias("seconds"), "queue_length", "enqueued")
    work, batches = f"file://{tmp_path}/work", [(-1, 90), (90, 91), (91, 400), (400, 10**9)]
    for low, high in batches:
        probes.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = lambda: spark.readStream.schema(probes.schema).parquet(f"file://{tmp_path}/in")
        follow_queues(stream(), work, hot_rows=hot_rows, availableNow=True).awaitTermination()
        # its commit is lost, so the batch runs again with the next start
        last = max((tmp_path / "work/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        follow_queues(stream(), work, hot_rows=hot_rows, availableNow=True).awaitTermination()
    consumed = analysis.queue_consumption(probes, order=("seconds", "event_id"), time="seconds")
    want = analysis.queue_ewma(consumed, order=("seconds", "event_id")).selectExpr("log_id", "event_id", "consumption", "consumption_ewma", "deviation_ewma", "false AS late")
    got = read_queues(spark, work)
    near = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert near(got) == near(want)
    assert len(list((tmp_path / "work/state").glob("batch_id=*"))) <= 2
    # a probe from before what its queue has seen is late; one of a new queue is not
    spark.createDataFrame([(1, 7, 3.0, 5, 5), (99, 7, 3.0, 5, 6)], probes.schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    follow_queues(stream(), work, hot_rows=hot_rows, availableNow=True).awaitTermination()
    new = {r.log_id: (r.late, r.consumption, r.consumption_ewma) for r in read_queues(spark, work).filter("event_id = 7 AND (late OR log_id = 99)").collect()}
    assert new == {1: (True, None, None), 99: (False, 1, 0.0)}
    assert near(read_queues(spark, work).filter("NOT late AND log_id < 99")) == near(want)


def test_streamed_queues_of_today_equal_the_batch_of_timestamps(spark, tmp_path):
    """Seconds since 1970 as doubles are off by a part of a microsecond; close probes' ewmas must not be."""
    rng = random.Random(7)
    at = [1_704_067_200_000_000]
    for _ in range(600):
        at.append(at[-1] + rng.choice([0, 1, 7, 333, 5_003, 1_000_001]))
    rows = [(i % 2, x, i, rng.randrange(60), rng.randrange(40)) for i, x in enumerate(at)]
    log = spark.createDataFrame(rows, "log_id long, us long, event_id long, queue_length long, enqueued long").selectExpr("*", "timestamp_micros(us) AS ts", "us / 1e6 AS seconds")
    probes = log.select("log_id", "event_id", "seconds", "queue_length", "enqueued")
    for part in ("event_id < 333", "event_id >= 333"):
        probes.filter(part).write.mode("append").parquet(f"file://{tmp_path}/in")
        follow_queues(spark.readStream.schema(probes.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/work", availableNow=True).awaitTermination()
    want = analysis.queue_ewma(analysis.queue_consumption(log)).select("log_id", "event_id", "consumption", "consumption_ewma", "deviation_ewma")
    assert rows_of(read_queues(spark, f"file://{tmp_path}/work").drop("late")) == rows_of(want)
