import random
import re

import xxhash

from tallyforge.llm import simhash
from tallyforge.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(fps):
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_fingerprint_is_the_contract():
    for text in (None, "", " \n", "One", "A b", "a b c d", "É é\x1cx y\x0bz", "w " * 5000 + "end"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_duplicates_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 3)  # so that shards are cut
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    assert {d: f for d, (f, _) in got.items()} == fps
    assert {d: c for d, (_, c) in got.items()} == slow_components(fps)


def test_a_tree_finds_all_within_the_radius_and_survives_packing():
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = sorted({x ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & (1 << 64) - 1 for x in base for _ in range(20)})
    tree = simhash.Tree()
    for x in values + values[:5]:
        tree.add(x)
    packed = simhash.Tree.unpack(tree.pack())
    assert sorted(packed.values) == values and len(tree.pack()) == 13 * len(values)
    for x in values:
        want = {y for y in values if (x ^ y).bit_count() <= 3}
        assert set(tree.near(x, 3)) == set(packed.near(x, 3)) == want
    assert list(simhash.Tree().near(5, 3)) == []


def test_chain_of_close_fingerprints_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 4)
    fps, x = [], 0
    for i in range(60):  # each differs in 3 bits from the one before
        fps.append(x - (x >> 63 << 64))
        x ^= (7 << (3 * i) % 61)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for n in (len(fps), 10**8, 10**11):  # any choice of blocks finds the same
        found = {r.node: r.root for r in components(simhash.links(nodes, n)).collect()}
        want = slow_components({f: f & (1 << 64) - 1 for f in fps})
        assert {f: found.get(f, f) for f in fps} == want


def test_odd_rows(spark):
    rows = [(5, ""), (3, None), (None, "  "), (7, "same text here"), (7, "same text here"), (9, "same text here"), (None, "alone in the world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 6)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 41)}
    assert components(links.limit(0)).count() == 0
