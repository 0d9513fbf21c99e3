"""Running ewmas of queues over a stream of probes.

Each micro-batch is walked as a table, by the operators of analysis: in the order of (seconds,
event_id), long queues range by range in many tasks, so a task holds no queue's batch. What a
queue goes on with (its last probe and ewmas) is a row of a state table, which is written anew
behind every batch, under its batch id: a batch that runs again starts from the same state and writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.analysis import DEVIATION_ALPHA, LIFETIME, queue_consumption, queue_ewma
from tallyward.sources.store import BatchFolder, work_folder

OUTPUT = "log_id long, event_id long, consumption long, consumption_ewma double, deviation_ewma double"
STATE = "log_id long, seconds double, event_id long, length long, ewma double, spread double"
_ORDER = ("seconds", "event_id")


def walk_batch(batch: DataFrame, state: DataFrame, *, lifetime: float = LIFETIME, deviation_alpha: float = DEVIATION_ALPHA, hot_rows: int | None = None) -> DataFrame:
    """A micro-batch's probes with consumption, ewmas and late, and what each queue's state becomes (seconds, length): a probe that does not come behind its queue's state is late, has nulls and changes nothing."""
    old = state.select(F.col("log_id").alias("_log"), *(F.col(c).alias(f"_{c}") for c in ("seconds", "event_id", "length", "ewma", "spread")))
    joined = batch.join(old, F.col("log_id").eqNullSafe(F.col("_log")), "left")
    late = F.coalesce(F.struct(*_ORDER) <= F.struct(F.col("_seconds").alias("seconds"), F.col("_event_id").alias("event_id")), F.lit(False)) & F.col("_seconds").isNotNull()
    marked = joined.withColumn("late", late)
    # the state stands as a probe before the queue's first one
    live = marked.filter(~F.col("late")).select("log_id", *_ORDER, "queue_length", "enqueued", F.lit(False).alias("state"), F.col("_ewma").alias("ewma_before"), F.col("_spread").alias("spread_before"))
    queues = marked.filter(~F.col("late") & F.col("_seconds").isNotNull()).select("log_id").distinct().withColumnRenamed("log_id", "_wanted")
    heads = old.join(queues, F.col("_log").eqNullSafe(F.col("_wanted")), "left_semi").select(F.col("_log").alias("log_id"), F.col("_seconds").alias("seconds"), F.col("_event_id").alias("event_id"), F.col("_length").alias("queue_length"), F.lit(0).cast("bigint").alias("enqueued"), F.lit(True).alias("state"), F.col("_ewma").alias("ewma_before"), F.col("_spread").alias("spread_before"))
    consumed = queue_consumption(live.unionByName(heads), order=_ORDER, time="seconds", hot_rows=hot_rows).filter("NOT state")
    walked = queue_ewma(consumed.withColumn("length", F.col("queue_length")), order=(*_ORDER, "length"), start=("ewma_before", "spread_before"), lifetime=lifetime, deviation_alpha=deviation_alpha, hot_rows=hot_rows)
    done = walked.select("log_id", *_ORDER, "length", "consumption", "consumption_ewma", "deviation_ewma", F.lit(False).alias("late"))
    passed = marked.filter("late").select("log_id", *_ORDER, F.col("queue_length").alias("length"), *(F.lit(None).cast(k).alias(c) for c, k in (("consumption", "bigint"), ("consumption_ewma", "double"), ("deviation_ewma", "double"))), F.lit(True).alias("late"))
    return done.unionByName(passed)


def next_state(walked: DataFrame, state: DataFrame) -> DataFrame:
    """The state table behind a batch that walk_batch gave: a row a queue."""
    newest = F.max_by(F.struct(*_ORDER, "length", F.col("consumption_ewma").alias("ewma"), F.col("deviation_ewma").alias("spread")), F.struct(*_ORDER)).alias("s")
    new = walked.filter("NOT late").groupBy("log_id").agg(newest).select("log_id", "s.*")
    kept = state.join(new.select(F.col("log_id").alias("_log")), F.col("log_id").eqNullSafe(F.col("_log")), "left_anti")
    return kept.unionByName(new)


def follow_queues(probes: DataFrame, folder: str, *, lifetime: float = LIFETIME, deviation_alpha: float = DEVIATION_ALPHA, hot_rows: int | None = None, **trigger):
    """Starts the stream (log_id, event_id, seconds, queue_length, enqueued) and returns the streaming query; trigger as in writeStream.trigger.

    Below folder, by batch: out (the probes with consumption and running ewmas; late ones have nulls) and state.
    """
    spark, kept = probes.sparkSession, BatchFolder(probes.sparkSession, folder)

    def keep(batch: DataFrame, n: int) -> None:
        state, before = kept.newest_before("state", n, STATE)
        walked = walk_batch(batch.select("log_id", "event_id", "seconds", "queue_length", "enqueued"), state, lifetime=lifetime, deviation_alpha=deviation_alpha, hot_rows=hot_rows)
        walked.write.mode("overwrite").parquet(kept.place("out", n))
        next_state(spark.read.schema(walked.schema).parquet(kept.place("out", n)), state).write.mode("overwrite").parquet(kept.place("state", n))
        for old in kept.done("state"):
            if old < before:  # the state before this batch stays, as the batch may run again
                kept.remove("state", old)

    return probes.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger or {"processingTime": "30 seconds"}).start()


def read_queues(spark: SparkSession, folder: str) -> DataFrame:
    """The probes of all batches so far, with late."""
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return out.select(*(c.split()[0] for c in OUTPUT.split(", ")), "late")


def stream_queue_ewma(spark: SparkSession, probes: DataFrame, folder: str | None = None, *, lifetime: float = LIFETIME, deviation_alpha: float = DEVIATION_ALPHA, **trigger) -> DataFrame:
    """Runs the stream to its end and returns its probes with consumption and running ewmas. For a stream without end, call follow_queues and, at any time, read_queues."""
    folder = folder or work_folder(spark, "queues")
    follow_queues(probes, folder, lifetime=lifetime, deviation_alpha=deviation_alpha, **trigger or {"availableNow": True}).awaitTermination()
    return read_queues(spark, folder)
