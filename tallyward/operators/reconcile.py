"""Known changes against what an audit found, listings against what was expected, and the seeded injection of changes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import uniform_rand


def relative(path: Column, root: str) -> Column:
    """A path below root, with a leading slash; others as they are."""
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def corrupt_candidates(changes: DataFrame) -> DataFrame:
    return changes.filter("corrupted_only")


def reconcile_warnings(warnings: DataFrame, changes: DataFrame, root: str = "") -> DataFrame:
    """path and status of what does not match: warning_not_in_changes, change_not_in_warnings. No row: the audit passed."""
    known = corrupt_candidates(changes).select(relative(F.col("path"), root).alias("path"), F.lit(True).alias("c"))
    both = warnings.select("path", F.lit(True).alias("w")).join(known, "path", "full_outer")
    status = F.when(F.col("c").isNull(), "warning_not_in_changes").when(F.col("w").isNull(), "change_not_in_warnings")
    return both.select("path", status.alias("status")).filter("status IS NOT NULL")


def path_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct paths of left that right lacks."""
    return left.select("path").subtract(right.select("path"))


def verify_filelist(listing: DataFrame, expected: DataFrame, *, complete: bool = True) -> DataFrame:
    """path and problem: size_mismatch (of any of its lines), duplicate, missing, and with complete unexpected."""
    found = listing.groupBy("path").agg(F.count("*").alias("n"), F.min("file_size").alias("low"), F.max("file_size").alias("high"))
    both = found.join(expected.select("path", F.col("size").alias("_size")), "path", "full_outer")
    problems = F.array(
        F.when(F.col("n").isNull(), "missing"),
        F.when(F.col("_size").isNull() & F.lit(complete), "unexpected"),
        F.when(F.col("_size").isNotNull() & (F.col("n") > 1), "duplicate"),
        F.when((F.col("low") != F.col("_size")) | (F.col("high") != F.col("_size")), "size_mismatch"),
    )
    return both.select("path", F.explode(problems).alias("problem")).filter("problem IS NOT NULL")


def fold_changers(applied: DataFrame) -> DataFrame:
    """Per file, from applications (path, place, method, id, corrupted): corrupted if one corrupts, corrupted_only if all do, the changers in order."""
    return applied.groupBy("path").agg(
        F.bool_or("corrupted").alias("corrupted"), F.bool_and("corrupted").alias("corrupted_only"), F.sort_array(F.collect_list(F.struct("place", "method", "id"))).alias("c")
    ).select("path", "corrupted", "corrupted_only", F.transform("c", lambda x: F.struct(x["method"].alias("method"), x["id"].alias("id"))).alias("changers"))


def change_summary(files: DataFrame, folded: DataFrame) -> DataFrame:
    """How many files are unchanged, changed, corrupted (in part by honest changes too) and corrupted only."""
    both = files.select("path").join(folded, "path", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.agg(
        n(F.col("corrupted").isNull()).alias("unchanged"), n(~F.col("corrupted")).alias("changed"),
        n(F.col("corrupted") & ~F.col("corrupted_only")).alias("corrupted"), n(F.col("corrupted_only")).alias("corrupted_only"),
    )


@dataclass(frozen=True)
class Changer:
    """method is append, replace or flip; bytes the number appended or, at most, replaced; corrupt keeps the modification time."""

    id: str
    method: str
    likelihood: float
    corrupt: bool = False
    bytes: int = 100


def _draws(seed: str, path: str, changer: str, n: int) -> bytes:
    """n bytes that depend on the arguments alone."""
    return hashlib.shake_128(f"{seed}\0{path}\0{changer}".encode()).digest(n)


def changed_bytes(data: bytes, c: Changer, seed: str, path: str) -> bytes:
    """Content after one changer. Replacing and flipping change nothing in an empty file; replacing never lets a file grow."""
    if c.method == "append":
        return data + _draws(seed, path, c.id, c.bytes)
    if not data:
        return data
    at = int.from_bytes(_draws(seed, path, f"{c.id} at", 8), "big") % len(data)
    if c.method == "flip":
        return data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]
    n = max(1, min(c.bytes, len(data) - at))
    return data[:at] + _draws(seed, path, c.id, n) + data[at + n :]


def inject_changes(contents: DataFrame, changers: list[Changer], seed: str, new_time: str) -> DataFrame:
    """path, content, modification_time, effective, applied (array of place, method, id, corrupted) for contents (path, content binary, modification_time).

    Each changer applies to a file with its likelihood (draw <= likelihood, from seed, path and changer, so runs repeat), in
    order. Corrupting ones keep the old time, others set new_time. effective says whether the bytes differ. Draws are native;
    only files with a change go to Python. Null content is empty.
    """
    draws = [uniform_rand(seed, F.col("path"), F.lit(c.id)) <= c.likelihood for c in changers]
    places = F.filter(F.array(*(F.when(d, i) for i, d in enumerate(draws))), lambda x: x.isNotNull())
    # drawn once: a generator, below which the filters are not copied
    drawn = contents.select("path", F.col("content").cast("binary").alias("content"), F.col("modification_time").cast("timestamp_ntz").alias("modification_time"), F.explode_outer(F.array(places)).alias("places"))
    entry = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c.method).alias("method"), F.lit(c.id).alias("id"), F.lit(c.corrupt).alias("corrupted")) for i, c in enumerate(changers)))
    drawn = drawn.withColumn("honest", F.exists("places", lambda x: F.lit([not c.corrupt for c in changers])[x]))
    schema = "path string, content binary, modification_time timestamp_ntz, places array<int>, honest boolean, effective boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, own in zip(batch["path"], batch["content"], batch["places"], strict=True):
                old = data = bytes(content or b"")
                for i in own:
                    data = changed_bytes(data, changers[i], seed, path)
                out.append((data, data != old))
            yield batch.assign(content=[d for d, _ in out], effective=[e for _, e in out])

    changed = drawn.filter(F.size("places") > 0).mapInPandas(run, schema)
    rest = drawn.filter(F.size("places") == 0).select("*", F.lit(False).alias("effective")).withColumn("content", F.coalesce("content", F.lit(b"")))
    time = F.when(F.col("honest"), F.lit(new_time).cast("timestamp_ntz")).otherwise(F.col("modification_time")).alias("modification_time")
    return changed.unionByName(rest).select("path", "content", time, "effective", F.transform("places", lambda i: entry[i]).alias("applied"))


def applied_changers(injected: DataFrame) -> DataFrame:
    """The applications of inject_changes as rows for fold_changers; those without effect are left out."""
    return injected.filter("effective").select("path", F.explode("applied").alias("a")).select("path", "a.place", "a.method", "a.id", "a.corrupted")
