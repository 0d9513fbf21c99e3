import random
import re
from datetime import datetime
from urllib.parse import unquote_to_bytes

import pytest
from pyspark.sql import functions as F

from tallyward.functions import columns as fn
from tallyward.sources import filelist

GOOD = [
    ("81 7 44 |0|2031-11-05 06:07:08.5| -- /k", (81, 7, 44, 0, "2031-11-05 06:07:08.500000", "/k")),
    ("81 7 44 \t |915|2031-11-05 06:07:08.000042| -- /notes", (81, 7, 44, 915, "2031-11-05 06:07:08.000042", "/notes")),
    ("9007 12 3 |77|1999-02-03 04:05:06| -- /año 5/%0Aline end%25/(v=2) [b]_&-.,~", (9007, 12, 3, 77, "1999-02-03 04:05:06", "/año 5/\nline end%/(v=2) [b]_&-.,~")),
    ("3 0 0 |9223372036854775807|2024-02-29 23:59:59| -- /a+b%2Bc|x -- y", (3, 0, 0, 2**63 - 1, "2024-02-29 23:59:59", "/a+b+c|x -- y")),
    ("5 5 5 |5|2024-01-01 00:00:00| -- /bar|\x01|\x01bar", (5, 5, 5, 5, "2024-01-01 00:00:00", "/bar|\x01|\x01bar")),
]
_T = "2024-02-29 23:59:59"
BAD = [
    ("", "format"), ("81 7 44 /notes", "format"), (f"81 7 44 |9|{_T}| - /x", "format"), (f"81 7  44 |9|{_T}| -- /x", "format"), ("\x011\x011\x011\x011\x011\x011", "format"), (f"81 7 44 |9|{_T}\x01x| -- /x", "format"), (f"81 7 44 |9|\x01| -- /x\x01", "format"),
    (f"99999999999999999999 7 44 |9|{_T}| -- /x", "number"), ("81 7 44 |9|29.02.2024| -- /x", "time"), ("81 7 44 |9|2023-02-29 23:59:59| -- /x", "time"),
    (f"81 7 44 |9|{_T}| -- /x%", "path"), (f"81 7 44 |9|{_T}| -- /x%4", "path"), (f"81 7 44 |9|{_T}| -- /x%zz", "path"),
    (f"81 7 44 |9|{_T}| -- /" + "x" * 16384, "length"), ("81 7 44 |9|" + "0" * 65 + "| -- /x", "length"), (f"81 7 44 |9|{_T}| -- /" + "ü" * 8192, "length"), ("81 7 44 |9|" + "ü" * 33 + "| -- /x", "length"),
]


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_good_lines(spark):
    got = filelist.read_filelist(lines(spark, [t for t, _ in GOOD])).withColumn("path", F.decode("path", "UTF-8")).collect()
    assert [(r.inode, r.generation, r.snapshot_id, r.file_size, str(r.modification_time), r.path) for r in got] == [x for _, x in GOOD]


def test_bad_lines(spark):
    got = filelist.filelist_errors(lines(spark, [t for t, _ in BAD + GOOD]))
    assert {(r.line, r.problem) for r in got.collect()} == set(BAD)


def plain(line):
    """(inode, generation, snapshot, size, time, path) or the problem of a line, in plain Python."""
    m = re.fullmatch(rb"([0-9]+) ([0-9]+) ([0-9]+)[\t\n\x0b\f\r ]+\|([0-9]+)\|([^|\x01]*)\| -- (.*)", line.encode(), re.DOTALL)
    if not m:
        return "format"
    *numbers, time, name = m.groups()
    if max(map(len, numbers)) > 32 or len(time) > 64 or len(name) > 16384:
        return "length"
    numbers = [int(x) for x in numbers]
    if max(numbers) >= 2**63:
        return "number"
    form = re.fullmatch(rb"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?", time)
    try:
        when = datetime.fromisoformat(time.decode()) if form else None
    except ValueError:
        when = None
    if when is None:
        return "time"
    if re.search(rb"%(?![0-9A-Fa-f]{2})", name):
        return "path"
    return (*numbers, when, unquote_to_bytes(name))


def test_fuzzed_lines(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(1500):
        line = list(f"{rng.randrange(10**6)} 7 {rng.randrange(99)} |{rng.randrange(10**9)}|2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 0{rng.randint(0, 9)}:59:58{rng.choice(['', '.5', '.000042'])}| -- /a%20b/%{rng.choice(['2f', '7C', 'é'])}|x{rng.choice(['', chr(1), '+'])}")
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 1)] = rng.choice(["", *"\x01|% -09aZ\t:ü\r"])
        texts.append("".join(line))
    got = {r.line: r for r in filelist.parse_lines(lines(spark, sorted(set(texts)))).collect()}
    for text in texts:
        r, want = got[text], plain(text)
        assert (r.problem or (r.inode, r.generation, r.snapshot_id, r.file_size, r.modification_time, bytes(r.path))) == want, repr(text)


def test_strict_fails(spark):
    with pytest.raises(Exception, match="bad line"):
        filelist.read_filelist(lines(spark, ["no line"])).collect()


@pytest.mark.parametrize("end", ["", "\n"])
def test_text_files(spark, tmp_path, end):
    text = "\n".join(f"{i} 8 6 |{i * i}|{_T}| -- /f{i}" for i in range(500)) + end
    (tmp_path / "list").write_text(text)
    assert filelist.read_filelist(filelist.read_lines(spark, f"file://{tmp_path}/list")).count() == 500


def test_names_that_are_no_text(spark, tmp_path):
    """Lines are bytes: a name that is not UTF-8 keeps its own; a name of exactly the longest length, in bytes, is good."""
    start = f"81 7 44 |9|{_T}| -- ".encode()
    names = [b"/caf\xe9", b"/\xff\xfe%0A\xc3", b"/" + "ü".encode() * 8191 + b"x"]
    (tmp_path / "list").write_bytes(b"".join(start + n + b"\n" for n in names))
    got = filelist.read_filelist(filelist.read_lines(spark, f"file://{tmp_path}/list"))
    assert sorted(bytes(r.path) for r in got.collect()) == sorted(n.replace(b"%0A", b"\n") for n in names)


def test_a_line_is_matched_once(spark):
    plan = filelist.read_filelist(lines(spark, ["x"]), strict=False).filter("file_size > 3").select("path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan


def test_bytes_that_are_no_text(spark):
    assert spark.range(1).select(fn.percent_decode(F.lit("a%FFb"))).first()[0] == b"a\xffb"


def test_patterns_with_quotes_are_refused():
    with pytest.raises(ValueError):
        filelist.excluded(F.lit("x"), ["it's"])


def test_inventory(spark):
    listed = spark.createDataFrame([("/fs/.snap/s/a/b.txt",), ("/fs/.snap/s/a/c.csv",), ("/fs/other/x",), ("/fs/.snap/s/" + "ü" * 2048,), ("/fs/.snap/s/" + "ü" * 2047,)], "path string").selectExpr("path", "timestamp_ntz'2020-01-01' AS modification_time", "1L AS file_size")
    got = filelist.inventory(listed, "/fs", ".snap", "s", patterns=["%.csv"])
    assert {r.path for r in got.collect()} == {"/a/b.txt", "/" + "ü" * 2047}


def test_snapshot_path_undoes_clean_path(spark):
    p = fn.clean_path(F.lit("/fs/.snap/s/a b"), "/fs/", "/.snap/", "s")
    assert spark.range(1).select(p, fn.snapshot_path(p, "/fs", ".snap", "s")).first()[:] == ("/a b", "/fs/.snap/s/a b")
