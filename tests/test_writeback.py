import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyward.operators import writeback
from tallyward.sources.contents import checksum_files, dealt_by_size
from tallyward.streaming.writeback import compact, files_of, laid_out_by_id, log_results, read_log, stream_late_results, stream_write_back


def walk(sizes, most_bytes, most_files):
    ends, held, n = [], 0, 0
    for i, s in enumerate(sizes):
        held, n = held + s, n + 1
        if held >= most_bytes or n == most_files:
            ends.append(i + 1)
            held = n = 0
    return ends


@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 50), st.integers(1, 9))
def test_pack_ends(sizes, most_bytes, most_files):
    assert writeback.pack_ends(np.array(sizes, np.int64), most_bytes, most_files) == walk(sizes, most_bytes, most_files)


@given(st.lists(st.integers(0, 30), max_size=60), st.lists(st.integers(0, 60), max_size=4), st.integers(1, 50), st.integers(1, 9))
def test_places_and_jumps_of_ranges(sizes, cuts, most_bytes, most_files):
    """Ranges that start with what jumps() says of those before give the packs of the whole walk."""
    ends = walk(sizes, most_bytes, most_files)
    starts = [0, *ends]
    want = [(sum(e <= i for e in ends), i - max(s for s in starts if s <= i)) for i in range(len(sizes))]
    edges = sorted({0, len(sizes), *(c for c in cuts if c <= len(sizes))})
    got, pack, held, n = [], 0, 0, 0
    for a, b in zip(edges, edges[1:], strict=False):
        part = np.array(sizes[a:b], np.int64)
        number, position, closed, new_held, new_n = writeback.place(part, held, n, most_bytes, most_files)
        got += zip((pack + number).tolist(), position.tolist(), strict=True)
        before, packs, left, files = writeback.jumps(part, most_bytes, most_files)
        at = min(int(np.searchsorted(before, most_bytes - held)), most_files - n) if n else 0
        if at <= len(part):
            assert ((n > 0) + packs[at], left[at], files[at]) == (closed, new_held, new_n)
        pack, held, n = pack + closed, new_held, new_n
    assert got == want


def test_packs_of_one_walk(spark):
    f = spark.range(25_000).selectExpr("id", "rand(3) AS rand", "concat('/', id) AS path", "id % 9000 AS file_size", "true AS to_be_read").checkpoint()
    rows = f.toPandas().sort_values(["rand", "id"])
    for ranges in (1, 7, 300):  # 300 ranges hold a fraction of a pack each
        got = writeback.build_packs(f.repartition(5), most_bytes=2_000_000, most_files=700, ranges=ranges).toPandas().sort_values(["pack_id", "position"])
        assert got["id"].tolist() == rows["id"].tolist()
        ends = walk(rows["file_size"].tolist(), 2_000_000, 700)
        want = np.diff([0, *ends, *([len(rows)] if ends[-1] < len(rows) else [])])
        assert got.groupby("pack_id").size().tolist() == want.tolist()
        assert got["pack_id"].iloc[0] == 0 and got["pack_id"].nunique() == got["pack_id"].iloc[-1] + 1
    packs = writeback.build_packs(f)
    assert writeback.collect_packs(packs).count() == writeback.pack_totals(packs).count()
    few = f.limit(40).checkpoint()  # most ranges are empty
    assert sorted(map(tuple, writeback.build_packs(few, ranges=90).collect())) == sorted(map(tuple, writeback.build_packs(few, ranges=1).collect()))
    assert writeback.build_packs(f.limit(0)).count() == 0 == writeback.build_packs(f.limit(0), ranges=3).count()


def tables(spark):
    files = spark.createDataFrame([(1, True, True, "a", 1), (2, True, True, "b", None), (3, True, False, "c", 1), (4, False, True, "d", 1), (5, True, True, None, None)], "id long, to_be_read boolean, to_be_compared boolean, checksum string, last_read long")
    files = files.selectExpr("*", "concat('/', id) AS path", "timestamp_ntz'2020-01-01' AS modification_time", "1L AS file_size")
    results = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 1, "x"), (3, 0, 2, "x"), (4, 0, 3, "x"), (5, 0, 4, "x"), (1, 1, 0, "late")], "id long, pack_id long, pos long, checksum string")
    return files, results


def test_write_back(spark):
    files, results = tables(spark)
    first = writeback.first_result(results)
    assert [(r.file_id, r.expected_checksum, r.actual_checksum, r.last_read) for r in writeback.checksum_mismatches(files, first, 7).collect()] == [(2, "b", "x", 0)]
    after = {r.id: (r.checksum, r.last_read, r.to_be_read, r.to_be_compared) for r in writeback.write_back(files, first, 7).collect()}
    assert after == {1: ("a", 7, False, False), 2: ("x", 7, False, False), 3: ("x", 7, False, False), 4: ("d", 1, False, True), 5: ("x", 7, False, False)}
    with pytest.raises(ValueError):
        writeback.refuse_unknown(results.selectExpr("id + 100 AS id"), files)
    writeback.refuse_unknown(results, files)


def test_stream_equals_batch(spark, tmp_path):
    files, results = tables(spark)
    stray = spark.createDataFrame([(77, 0, 9, "y")], results.schema)
    for i, c in enumerate(["pack_id = 0 AND pos < 2", "pack_id = 0 AND pos >= 2", "pack_id = 1"]):
        results.union(stray).filter(c).coalesce(1).write.parquet(f"file://{tmp_path}/in/part={i}")
    stream = lambda: spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    after, warnings, unknown = stream_write_back(spark, files, stream(), 7, f"file://{tmp_path}/work", refuse=False)
    first = writeback.first_result(results)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(after) == key(writeback.write_back(files, first, 7))
    assert key(warnings) == key(writeback.checksum_mismatches(files, first, 7))
    assert [(r.id, r.checksum) for r in unknown.collect()] == [(77, "y")]
    with pytest.raises(Exception, match="unknown file: 77"):
        stream_write_back(spark, files, stream(), 7, f"file://{tmp_path}/strict")
    got = stream_late_results(spark, stream(), files, f"file://{tmp_path}/late")
    assert sorted((r.id, r.checksum) for r in got.collect()) == [(1, "a"), (2, "x"), (3, "x"), (5, "x")]  # 4 was written before, 77 is unknown


def test_checksum_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 9_000_000)
    (tmp_path / "b").write_bytes(b"")
    rows = spark.createDataFrame([(1, f"{tmp_path}/a"), (2, f"file://{tmp_path}/b"), (3, f"{tmp_path}/missing")], "id long, path string")
    got = {r.id: (r.bytes_read, bytes(r.checksum)) for r in checksum_files(rows).collect()}
    assert got == {1: (9_000_000, hashlib.sha1(b"x" * 9_000_000).digest()), 2: (0, hashlib.sha1().digest())}


def test_a_batch_does_not_move_the_files(spark, tmp_path):
    files = spark.range(200_000).selectExpr("id", "concat('/', id) AS path", "true AS to_be_read")
    laid_out_by_id(files, 8).write.parquet(f"file://{tmp_path}/files")
    stored = spark.read.parquet(f"file://{tmp_path}/files")
    ids = spark.createDataFrame([(5,), (7,), (5,)], "id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = files_of(stored, ids)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "GreaterThanOrEqual(id,5), LessThanOrEqual(id,7)" in plan
        scan = plan[plan.index("FileScan") :]
        assert "Exchange" not in plan[plan.index("LeftSemi") : plan.index("FileScan")], scan
        assert sorted(r.id for r in cut.collect()) == [5, 7]
        many = files_of(stored, ids, most=1)  # beyond the bound by shuffle, with the same rows
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() or "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in many.collect()) == [5, 7]
        assert files_of(stored, ids.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("fold_every", [1, 2, 100])
def test_replayed_batch_and_folding(spark, tmp_path, fold_every):
    files, results = tables(spark)
    for i, c in enumerate(["pack_id = 0 AND pos < 2", "pack_id = 0 AND pos >= 2", "pack_id = 1"]):
        results.filter(c).coalesce(1).write.parquet(f"file://{tmp_path}/in/part={i}")
        stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        log_results(stream, files, f"file://{tmp_path}/work", 7, fold_every=fold_every, availableNow=True).awaitTermination()
        # the batch is done, but its commit is lost: it runs again when the stream goes on
        last = sorted((tmp_path / "work/checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    log_results(stream, files, f"file://{tmp_path}/work", 7, fold_every=fold_every, availableNow=True).awaitTermination()
    first = writeback.first_result(results)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(compact(spark, files, f"file://{tmp_path}/work", 7)) == key(writeback.write_back(files, first, 7))
    warnings = read_log(spark, f"file://{tmp_path}/work", "warnings").drop("batch_id")
    assert key(warnings) == key(writeback.checksum_mismatches(files, first, 7))
    assert len(list((tmp_path / "work/files").glob("batch_id=*"))) <= 2 if fold_every < 100 else not (tmp_path / "work/files").exists()


def test_files_are_dealt_by_size(spark, tmp_path):
    sizes = [3_000_000, *[1000 * (i % 37) for i in range(160)]]  # the first has about half of all bytes
    for i, n in enumerate(sizes):
        (tmp_path / f"f{i}").write_bytes(bytes([i % 256]) * n)
    rows = spark.createDataFrame([(i, f"{tmp_path}/f{i}", n) for i, n in enumerate(sizes)], "id long, path string, file_size long").repartition(3)
    got = {r.id: (r.bytes_read, bytes(r.checksum)) for r in checksum_files(rows, tasks=8).collect()}
    assert got == {i: (n, hashlib.sha1(bytes([i % 256]) * n).digest()) for i, n in enumerate(sizes)}
    tasks = {}
    for r in dealt_by_size(rows, 8).withColumn("task", F.spark_partition_id()).collect():
        tasks.setdefault(r.task, []).append(r.file_size)
    assert [3_000_000] in tasks.values() and all(x == sorted(x, reverse=True) for x in tasks.values())
    others = [sum(x) for x in tasks.values() if x != [3_000_000]]
    share = sum(sizes) / 8
    assert all(x <= share + 36_000 for x in others) and len(others) >= 4
    assert dealt_by_size(rows.limit(0), 8).count() == 0


def test_large_batches_are_cut_by_ranges_and_foldings_are_few(spark, tmp_path, monkeypatch):
    """No batch moves the files table, and what foldings write doesn't grow with the number of batches."""
    from tallyward.streaming import writeback as streamed

    monkeypatch.setattr(streamed, "MOST_BROADCAST", 150)
    monkeypatch.setattr(streamed, "FOLD_SHARE", 0.5)
    folds, shuffled = [], []
    fold, cut = streamed._Folder.fold, streamed.files_of
    monkeypatch.setattr(streamed._Folder, "fold", lambda self, n, *more: (folds.append(n), fold(self, n, *more)))

    def files_of_watched(files, ids, most):
        shuffled.append(ids.count() > most)
        return cut(files, ids, most)

    monkeypatch.setattr(streamed, "files_of", files_of_watched)
    files = spark.range(4000).selectExpr("id", "id % 3 > 0 AS to_be_read", "id % 2 = 0 AS to_be_compared", "'a' AS checksum", "1L AS last_read", "concat('/', id) AS path", "timestamp_ntz'2020-01-01' AS modification_time", "1L AS file_size")
    laid_out_by_id(files, 5).write.parquet(f"file://{tmp_path}/files")
    stored = spark.read.schema(files.schema).parquet(f"file://{tmp_path}/files")
    results = spark.range(4000).selectExpr("(id * 7) % 4000 AS id", "id % 10 AS pack_id", "id AS pos", "if(id % 11 = 0, 'x', 'a') AS checksum")
    results = results.union(results.filter("id % 5 = 0").selectExpr("id", "pack_id + 10", "pos", "'late'"))
    for i in range(10):
        results.filter(f"pack_id % 10 = {i}").coalesce(1).write.parquet(f"file://{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    after, warnings, _ = stream_write_back(spark, stored, stream, 7, f"file://{tmp_path}/work", fold_every=1)
    first = writeback.first_result(results)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(after) == key(writeback.write_back(files, first, 7))
    assert key(warnings) == key(writeback.checksum_mismatches(files, first, 7))
    assert len(shuffled) > 20 and not any(shuffled)
    assert len(folds) == 1  # 2,667 results count, the table has 4,000 rows
    assert not list((tmp_path / "work").glob("cut/*")) + list((tmp_path / "work").glob("before/*"))


def test_id_ranges(spark):
    from tallyward.streaming.writeback import id_ranges

    ids = spark.range(1000).selectExpr("id * id AS id")
    got = id_ranges(ids, 70)
    counts = [ids.filter(F.col("id").between(*r)).count() for r in got]
    assert sum(counts) == 1000 and max(counts) <= 70 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:], strict=False))
    assert id_ranges(ids, 1000) == [(0, 998001)] and id_ranges(ids.limit(0), 5) == []
