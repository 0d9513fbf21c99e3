"""URL filter: parsing and rules against plain Python, the trees on labelled hosts held out, odd rows."""

import math
import random
import re
from collections import Counter

from tallyward.llm import queries, urlfilter

RULES = urlfilter.parse_rules(queries.URL_RULES)
SCHEMA = "page_id long, url string, html string, host int, _id string, verdict string"


def plain(url):
    """(host, path, rule, action) by definition."""
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None, None
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.action


ODD = [
    None, "", "no scheme", "http://", "://", "http://NET", "http://net/", "http://a.NET/x", "http://example.net/en/1", "http://a.example.net/en/?q", "http://a.example.net/en", "http://xexample.com/de/", "http://example.com/de/#a",
    "https://org/fr/", "http://forg/fr/1", "http://m.org/fr/a/b?x=1&y=2#z", "http://h.com?u=http://a.net/", "http://h.com#f/?x", "http://ÄB.Net/é", "//a://b.net/c", "http://u:p@a.net:80/", "http://a.net/\n?x", "http://" + "a" * 300_000 + ".net/" + "b" * 300_000,
]


def test_rules_and_parts(spark):
    rows = [(i, u, "h", 1, "x", "v") for i, u in enumerate(ODD)] + [(6, ODD[6], "h", 1, "x", "v")]
    got = urlfilter.judge(spark.createDataFrame(rows, SCHEMA), RULES, urlfilter.Model()).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, action = plain(ODD[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, action or "allow"), ODD[r.page_id]
    assert urlfilter.judge(spark.createDataFrame([], SCHEMA), RULES, urlfilter.Model()).count() == 0


def test_entropy_and_features(spark):
    r = urlfilter.with_features(spark.createDataFrame([("https://ab-1.Example.com/x/12/?a=1&b=2;c#f",), (None,)], "url string")).collect()
    want = {"url_length": 42, "host_length": 16, "path_length": 6, "depth": 2, "labels": 3, "digit_ratio": 5 / 42, "hyphens": 1, "parameters": 3}
    assert {k: r[0][f"_{k}"] for k in want} == want
    n = Counter("ab-1.example.com")
    assert math.isclose(r[0]["_host_entropy"], -sum(c / 16 * math.log2(c / 16) for c in n.values()))
    assert all(r[1][f"_{k}"] == 0 for k in urlfilter.LEXICAL)
    assert (r[0]["_tail_1"], r[0]["_tail_2"], r[0]["_tail_3"]) == ("com", "example.com", "ab-1.example.com")


def made_urls(n, seed):
    """Bad URLs have long random hosts with digits or many parameters, good ones short readable hosts; a tenth of the labels is wrong."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.4
        word = lambda k: "".join(rng.choices("aeioulnrst", k=k))
        if bad:
            host = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(14, 24)))
            url = f"http://{host}.top/{word(3)}?" + "&".join(f"{word(1)}={rng.randrange(10**6)}" for _ in range(rng.randint(2, 6)))
        else:
            url = f"https://{word(6)}.org/{word(4)}/{word(5)}"
        out.append((url, int(bad), int(bad != (rng.random() < 0.1))))
    return out


def test_trees_tell_hosts_held_out(spark):
    train, test = made_urls(1500, 1), made_urls(400, 2)
    labelled = spark.createDataFrame([(u, noisy) for u, _, noisy in train] + [(None, 1), ("http://x.org/", None)], "url string, label int")
    model = urlfilter.fit(labelled, trees=4)
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(test)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, [], model).collect()}
    assert sum((got[i] == "block") == bool(bad) for i, (_, bad, _) in enumerate(test)) >= 0.97 * len(test)


def test_no_labels_give_no_trees(spark):
    one = spark.createDataFrame([("http://a.com/", 1)] * 20, "url string, label int")
    assert urlfilter.fit(one).trees == [] and urlfilter.fit(one.limit(0)).trees == []


def test_query_is_native_and_leaves_plain_hosts_alone(spark):
    df = queries.op11_url_filter(spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    rows = df.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    free = [r for r in rows if r.rule is None]
    bad = [r for r in free if set(re.split(r"[.\-]", r.host)) & set(urlfilter.BAD_WORDS)]
    assert bad and all(r.verdict == "block" for r in bad)
    assert sum(r.verdict == "block" for r in free) == len(bad)
