import math
from collections import defaultdict

import duckdb
import pytest

from tallyforge.llm import url_filter
from tallyforge.llm.oracles import URLS


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        (None, "", "", None), ("", "", "", None), ("no scheme/net/", "", "", None), ("http://A.Example.NET/en/x?q=/fr/#t", "a.example.net", "/en/x",
            "example.net/en/"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
        ("x://org/fr/://b.net/", "org", "/fr/://b.net/", "org/fr/"), ("http://é.ORG/fr/", "é.org", "/fr/", "org/fr/"), ("http://a.net?x", "a.net", "",
            None), ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"), ("http://net/", "net", "/", "net/"),
            ("a\nb://h\n.net/p\nq", "h\n.net", "/p\nq", "net/"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    r = url_filter.judge(spark.createDataFrame([(1, url, "kept")], "page_id long, url string, score string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    if rule:
        assert r.verdict == dict((t, v) for v, t in url_filter.RULES)[rule]
    assert r.verdict in ("allow", "block")


def test_scores_equal_a_slow_model(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    pages = pages.union(pages.limit(3)).union(spark.createDataFrame([(None, None), (-1, ""), (-2, "http://ÄÖ.org/" + "x" * 3000)], "page_id long, url string"))
    rows = url_filter.judge(pages).collect()
    assert len(rows) == pages.count()
    from hashlib import md5

    folded = {r.url: r.f for r in pages.select("url", url_filter.folded(pages.url).alias("f")).collect()}
    counts = {"allow": defaultdict(int), "block": defaultdict(int)}
    for r in rows:
        if r.rule and md5(r.url.encode()).hexdigest()[0] not in "012":
            s = folded[r.url]
            for i in range(len(s) - 3):
                counts[r.verdict][s[i : i + 4]] += 1

    def model(grams):
        seen = [defaultdict(dict) for _ in range(4)]
        for g, n in grams.items():
            for k in range(4):
                x = g[3 - k :]
                seen[k][x[:-1]][x[-1]] = seen[k][x[:-1]].get(x[-1], 0) + n

        def p(g, k=3):
            if k < 0:
                return 1 / url_filter.SYMBOLS
            here = seen[k].get(g[3 - k : 3])
            return p(g, k - 1) if not here else (here.get(g[3], 0) + len(here) * p(g, k - 1)) / (sum(here.values()) + len(here))

        return p

    good, bad = model(counts["allow"]), model(counts["block"])
    for r in rows:
        s = folded[r.url]
        want = sum(math.log(good(s[i : i + 4])) - math.log(bad(s[i : i + 4])) for i in range(len(s) - 3)) / (len(s) - 3)
        assert r.score == pytest.approx(want, abs=1e-8)


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, con.sql(URLS).fetchall()))
    got = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
