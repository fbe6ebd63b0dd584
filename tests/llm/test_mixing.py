import re
from collections import defaultdict

import pytest

from tallyforge.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS size", "'x' AS bucket", "1 AS row")


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, None: 5}, {"é": 3, "z": 3, "Z": 3}, {"a": 1}, {"a": 0, "b": 0}, {"a": 100, "b": 0, "c": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_the_mix_keeps_its_contract(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.taken(table).collect()
    given = table.collect()
    assert len(rows) == len(given)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in given}
    sums, want = defaultdict(int), defaultdict(int)
    for r in given:
        want[r.source] += size[r.doc_id]
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] and r.source_size == want[r.source]
        sums[r.source] += r.taken
    target = slow_targets(want)
    assert all(abs(sums[s] - target[s]) <= 0.5 for s in target)
    again = mixing.taken(table.repartition(7)).collect()
    assert sorted(map(str, (r[:6] for r in again))) == sorted(map(str, (r[:6] for r in rows)))


def test_any_stretch_of_the_schedule_has_the_shares(spark):
    sources = spark.createDataFrame([(0, 1000.0), (1, 3000.0), (2, 6000.0)], "ix int, target double")
    slots = sorted((r.slot, r.ix) for r in mixing.schedule(sources, 10000, 10).collect())
    assert len(slots) == 1000
    for start in (0, 137, 500, 800):
        n = [sum(1 for s, ix in slots[start : start + 200] if ix == k) for k in range(3)]
        assert all(abs(a - b) <= 6 for a, b in zip(n, (20, 60, 120)))
    ranks = sorted((r.ix, r["rank"]) for r in mixing.schedule(sources, 10000, 10).collect())
    assert ranks == [(k, i) for k, n in ((0, 100), (1, 300), (2, 600)) for i in range(n)]


def test_takes_cover_each_source_once_an_epoch(spark):
    d = docs(spark, [(i, "w " * (i % 5), "ab"[i % 2]) for i in range(40)] + [(1, "w", "a")])
    rows, takes = mixing.mix(d, block=4)
    words = defaultdict(int)
    for r in takes.collect():
        assert 0 < r.words <= 4
        words[r.row] += r.words
    assert {r.row: r.taken for r in mixing.taken(d, block=4).collect() if r.taken} == dict(words)


def test_odd_rows(spark):
    d = docs(spark, [(1, None, None), (None, "a b", None), (None, "a b", None), (2, "", "x"), (3, "a b c", "x"), (3, "a b c", "x"), (4, " \t ", "y")])
    rows = mixing.taken(d).collect()
    assert len(rows) == 7 and sum(r["size"] for r in rows) == 10 and all(r.taken <= 3 * r["size"] for r in rows)
    out = mixing.mixed(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} >= {1, 2, 4}
    assert mixing.taken(d.limit(0)).count() == mixing.mixed(d.limit(0)).count() == 0
