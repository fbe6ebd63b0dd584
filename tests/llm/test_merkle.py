from hashlib import sha256
from zlib import crc32

import pytest

from tallyforge.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    shown = ["-" if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H(*[s if v is None else f"{len(s.encode())}:{s}" for s, v in zip(shown, (doc_id, source, lang, n_chars, text))])


def grown(nodes):
    """Root, and for each node its list of siblings, where one is (text, None), on which side."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            if (k ^ 1) < len(level):
                paths[i].append((level[k ^ 1], k % 2))
            else:
                paths[i].append((None, 0))
            at[i] = k // 2
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def slow(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        ordered = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        built[name] = (ordered, *grown([leaf(*r) for r in ordered]))
    root, tops = grown([built[n][1] for n in names])
    out = []
    for i, name in enumerate(names):
        ordered, subroot, paths = built[name]
        for r, path in zip(ordered, paths):
            path = path + tops[i]
            marked = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf(*r[:4], r[4] + 1) if marked else leaf(*r)
            for sibling, right in path:
                h = H(h) if sibling is None else H(sibling, h) if right else H(h, sibling)
            out.append((r[0], leaf(*r), subroot, root, H(*[s for s, _ in path if s is not None]), h, h == root))
    return sorted(map(str, out))


def table(n):
    langs = ["en", "en", "en", "de", None, "", "é", "-"]
    rows = [(i, f"text {i}", langs[i * i % 8], "abc"[i % 3], i) for i in range(n)]
    return rows + [(i, None, "en", None, None) for i in range(0, n, 9)] + [(None, "x", "en", "s", 1)] * 2 + [(3, "text", "en", "s", 2)] * 3


def answer(made):
    return sorted(str(tuple(r)) for r in made.collect())


@pytest.mark.parametrize("n, levels", [(1, 1), (2, 1), (40, 1), (70, 2), (300, 3), (300, 10)])
def test_manifest_equals_the_plain_one(spark, n, levels):
    rows = table(n)
    df = spark.createDataFrame(rows, SCHEMA)
    assert answer(merkle.manifest(*merkle.build(df, levels), levels)) == slow(rows)


def test_one_row(spark):
    rows = [(7, "a", "en", "s", 1)]
    assert answer(merkle.manifest(*merkle.build(spark.createDataFrame(rows, SCHEMA)))) == slow(rows)


def test_only_the_tampered_fail(spark):
    rows = [(i, "t", "en" if i % 3 else "de", "s", None if i % 5 == 0 else 1) for i in range(100)]
    found = merkle.manifest(*merkle.build(spark.createDataFrame(rows, SCHEMA), 2), 2).collect()
    assert {r.doc_id for r in found if not r.verified} == {i for i in range(100) if i % 5 and crc32(str(i).encode()) % 7 == 0}


@pytest.mark.parametrize("cuts", [(0, 5, 100), (0, 33, 34, 64, 100), (0, 64, 100)])
def test_appending_equals_building_at_once(spark, cuts):
    rows = [(i, f"t{i}", ("en", "de", None)[i % 3 if i % 5 else 0], "s", i) for i in range(100)]
    leaves, roots = merkle.build(spark.createDataFrame(rows[: cuts[1]], SCHEMA), 2)
    for low, high in zip(cuts[1:], cuts[2:]):
        leaves, roots = merkle.extend(leaves, roots, spark.createDataFrame(rows[low:high], SCHEMA), 2)
    assert answer(merkle.manifest(leaves, roots, 2)) == slow(rows)


def test_a_witness_grows_as_siblings_are_completed():
    tree = merkle.Appender()
    seen = []
    for x in ("a", "b", "c", "d"):
        tree.append(x)
        seen.append(list(tree.paths[0]))
    ab, cd = H("a", "b"), H("c", "d")
    assert seen == [[], [">b"], [">b"], [">b", ">" + cd]] and tree.root() == H(ab, cd)
    assert all(merkle.folded(x, p) == tree.root() for x, p in zip("abcd", tree.paths))
