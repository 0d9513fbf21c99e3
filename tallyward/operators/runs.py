"""Queries over runs and warnings. Runs are few; warnings are partitioned by the run that discovered them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states in which a run has ended.
ENDED = ("finished", "aborted")
#: Most runs whose ids are broadcast.
MOST_BROADCAST = 100_000


def incomplete_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("state").isin(*ENDED)).orderBy("id")


def exists_incomplete(runs: DataFrame, before: int | None = None) -> bool:
    found = incomplete_runs(runs) if before is None else incomplete_runs(runs).filter(F.col("id") < before)
    return bool(found.limit(1).count())


def run_by_id(runs: DataFrame, n: int) -> DataFrame:
    """The run as a row; an unknown id is an error."""
    found = runs.filter(F.col("id") == n)
    if not found.limit(1).count():
        raise ValueError(f"no run {n}")
    return found


def last_n_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n).orderBy("id")


def runs_to_continue(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """Incomplete runs by id, up to and with run_id if that is one of them, else all."""
    open_ = incomplete_runs(runs)
    if run_id is not None and open_.filter(F.col("id") == run_id).limit(1).count():
        return open_.filter(F.col("id") <= run_id)
    return open_


def listed(rows: DataFrame) -> DataFrame:
    return rows.orderBy("id")


def warnings_of_run(warnings: DataFrame, run: int) -> DataFrame:
    return warnings.filter(F.col("discovered") == run).orderBy("id")


def warnings_last_n_runs(warnings: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    last = runs.orderBy(F.desc("id")).limit(n).select(F.col("id").alias("discovered"))
    return warnings.join(F.broadcast(last) if n <= MOST_BROADCAST else last, "discovered").select(*warnings.columns).orderBy("id")


def clear_warnings(warnings: DataFrame, ids: DataFrame) -> DataFrame:
    """The warnings that stay."""
    return warnings.join(ids.select("id"), "id", "left_anti")
