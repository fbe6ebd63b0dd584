import random

import corpus_pipeline
from tallyforge.llm import near_copies


def planted():
    """20 texts of 200 words; of each, copies with one word changed (Jaccard 0.95), two (0.9) and four apart (0.81), and one with
    eight (0.66) that has to stay."""
    r, rows = random.Random(1), []
    for g in range(20):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows.append((10 * g, " ".join(words)))
        for k, n in enumerate((1, 2, 4, 8), 1):
            copy = list(words)
            for i in range(n):
                copy[12 + 24 * i if n == 8 else 20 + 40 * i] = f"x{r.randrange(10**6)}"
            rows.append((10 * g + k, " ".join(copy)))
    return rows


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if " " in (text or "").strip() else [(text or "").strip().lower()]
    words = [w for x in words for w in x.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[b] < root[a] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                    root[a], changed = root[b], True
    return root


def test_planted_near_copies_are_dropped(spark, sf):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_groups(rows)
    assert sorted(set(want.values())) == sorted(d for d, _ in rows if d % 10 in (0, 4))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, sf).collect()) == sorted(set(want.values()))


def test_chains_within_a_band(spark):
    """Each text shares at least 0.8 with the one before alone, so links by way of one representative are not enough."""
    r = random.Random(2)
    words, rows = [f"w{r.randrange(10**6)}" for _ in range(400)], []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = words[20:] + [f"w{r.randrange(10**6)}" for _ in range(20)]
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_groups(rows) == {i: 0 for i in range(30)}


def test_a_family_just_under_the_similarity(spark, monkeypatch):
    """Copies that share bands with all others, of which few are alike: bands are compared in parts, and no pairs are returned."""
    monkeypatch.setattr(near_copies, "PART_NODES", 7)
    monkeypatch.setattr(near_copies, "COLUMNS", 50)
    r = random.Random(3)
    base, rows = [f"w{r.randrange(10**6)}" for _ in range(150)], []
    for i in range(60):
        words = list(base)
        for _ in range(r.choice((2, 3, 5))):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow_groups(rows)
    assert got == want and 1 < len(set(want.values())) < 60


def test_links_between_parts():
    import numpy as np

    sets = [np.array(x) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [9, 8], [1, 2, 3, 4], [9, 8, 7])]
    low = list(enumerate(sets))
    assert sorted(near_copies.links_between(low, [])) == [(1, 0), (3, 0)]
    assert near_copies.links_between(low[:1], low[1:]) == [(1, 0), (3, 0)]
    assert near_copies.links_between(low[2:3], low[4:]) == []


def test_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs, sf).collect())
    assert kept == sorted(set(slow_groups([(r.doc_id, r.text) for r in docs.collect()]).values()))


def test_rows_of_one_id_with_unrelated_texts_all_stay(spark, sf):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    for rows, want in (
        ([(5, a), (5, b)], [(5, a), (5, b)]),
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(5, b), (5, a), (3, a), (3, a)], [(3, a), (5, b)]),
        ([(None, a), (None, b), (None, a)], [(None, a), (None, b)]),
        ([(None, a), (9, a), (4, None), (2, ""), (None, None)], [(2, ""), (9, a)]),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS copy", "map('k', 1) AS root")
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, want))


def test_same_id_and_text_keep_the_same_row_each_time(spark, sf):
    rows = [(1, "a b c d e", f"s{i}") for i in range(20)]
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {stage(spark, docs.repartition(n), sf).collect()[0].source for n in (1, 5)} == {stage(spark, docs, sf).collect()[0].source}


def test_simhash_links_what_is_close_enough(spark):
    """The first half of the stage by itself: pairs of sets whose fingerprints are within three bits."""
    rows = planted()
    fp = {d: near_copies.sketch(t)[1] & (1 << 64) - 1 for d, t in rows}
    assert any((fp[a] ^ fp[a + 1]).bit_count() <= 3 for a in range(0, 200, 10))
    assert all((fp[a] ^ fp[b]).bit_count() > 3 for a in range(0, 200, 10) for b in range(a + 10, 200, 10))


def test_odd_rows(spark, sf):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "e f g h"), (4, "e f g h"), (5, "e f g h"), (6, None), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_copies.near_copies(docs).collect()) == [(0, 0), (0, 0), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert near_copies.near_copies(docs.limit(0)).count() == 0
