import hashlib
import re

import pytest
import xxhash

from tallyforge.llm import spotsigs
from tallyforge.llm.spotsigs import ANCHORS, CHAIN, MARKS, SPOT, WINDOW

MARK = re.compile(f"^[{MARKS}]+|[{MARKS}]+$")


APART = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]").match


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (h >> 63 << 64)


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (h >> 63 << 64)


def slow_signatures(text):
    apart = "".join(f" {c} " if APART(c) else c for c in text or "")
    words = [w for w in (MARK.sub("", w) for w in re.split(r"[\x01\x09-\x0D ]+", apart.lower())) if w]
    common, found = set(ANCHORS), set()
    for i, w in enumerate(words):
        if w not in common:
            continue
        at, chain = i + 1, []
        while len(chain) < CHAIN and at < len(words):
            skipped = 0
            while at < len(words) and words[at] in common and skipped < SPOT:
                at, skipped = at + 1, skipped + 1
            if at == len(words) or words[at] in common:
                break
            chain.append(words[at])
            at += 1
        if len(chain) == CHAIN:
            found.add(signed("\x01" + " ".join([w, *[c for c in chain if c not in common]]) + " "))
    chains = [chained(words[i : i + CHAIN + 1]) for i in range(len(words) - CHAIN)]
    found |= {min(chains[i : i + WINDOW]) for i in range(max(1, len(chains) - WINDOW + 1)) if chains}
    return found or {signed("= " + "".join(w + " " for w in words))}


def check(rows, texts):
    ids = sorted(texts, key=lambda x: (x is not None, x))
    assert len(rows) == len(ids)
    for i, d in enumerate(ids):
        text, after = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, of_edited, of_next = map(slow_signatures, (text, edited, after))
        r = rows[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(map(str, sorted(own))) and r.edited_fingerprint == " ".join(map(str, sorted(of_edited)))
        assert r.near_edited == pytest.approx(len(own & of_edited) / len(own | of_edited)) and r.near_next == pytest.approx(len(own & of_next) / len(own | of_next))


@pytest.mark.parametrize("run", [2000, 7])
def test_edits_equal_brute_force(spark, sf, monkeypatch, run):
    monkeypatch.setattr(spotsigs, "RUN", run)  # small runs: neighbours lie in different ones
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 <> 1")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check({r.doc_id: r for r in spotsigs.edits(docs).collect()}, texts)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RUN", 2)
    texts = {None: "the first of all", -5: None, 0: "", 3: "the " * 40 + "cat sat", 4: "🙂é the \x01 dog's bone, (the) end!", 9: "no anchors here?",
        10: "of the", 11: "the big dog " * 3000, 12: "кошка и собака спят на старом диване у окна весь день", 13: "我喜欢在图书馆读书。他不喜欢 ねこ แมว 𠀀x",
        14: "a | b | c | d", 15: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS run")
    check({r.doc_id: r for r in spotsigs.edits(docs).collect()}, texts)
    one = spotsigs.edits(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0
    assert spotsigs.edits(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 9").union(docs.where("doc_id = 9"))
    assert [r.near_next for r in spotsigs.edits(twice).collect()] == [1.0, 1.0]


def test_texts_of_any_script_lose_little_by_an_edit(spark):
    import random

    rnd = random.Random(1)
    letters = {"ru": "абвгдежзик", "zh": "的一是在不了有和人这中大为上个国我以要他时来用们", "el": "αβγδεζηθικ", "list": "0123456789"}
    texts = {}
    for k, a in enumerate(letters.values()):
        for i in range(3):
            texts[10 * k + i] = "".join(rnd.choice(a) for _ in range(900)) if a[0] == "的" else " ".join("".join(rnd.choices(a, k=5)) for _ in range(300))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = spotsigs.edits(docs).collect()
    assert all(0.4 < r.near_edited < 0.9 and r.near_next < 0.2 for r in rows if r.doc_id % 10 < 2)  # the next is of the same script


def test_few_changes_of_words_change_little_at_any_density_of_anchors(spark):
    """400 words, every k-th an anchor (none for 0), three words replaced: anchors in even rounds, any words in odd ones. Texts of 40
    common words alone (k = 1) repeat their chains, so they have fewer signatures to share."""
    import random

    rnd, rows = random.Random(5), []
    for k in range(0, 25):
        for turn in range(4):
            words = [rnd.choice(ANCHORS[:40]) if k and i % k == 0 else f"w{rnd.randrange(3000)}" for i in range(400)]
            places = rnd.sample([i for i in range(400) if k and i % k == 0 and k < 100] if k and turn % 2 == 0 else range(400), 3)
            rows += [(k * 10 + turn, 0, " ".join(words)), (k * 10 + turn, 1, " ".join("changed" if i in places else w for i, w in enumerate(words)))]
    signed_rows = spotsigs.with_signatures(spark.createDataFrame(rows, "id long, edited int, text string"), "text", "s").collect()
    sets = {(r.id, r.edited): set(r.s) for r in signed_rows}
    likeness = {i: len(sets[i, 0] & sets[i, 1]) / len(sets[i, 0] | sets[i, 1]) for i, e in sets if e}
    assert min(x for i, x in likeness.items() if i // 10 != 1) > 0.9 and min(likeness.values()) > 0.85 and sum(likeness.values()) / len(likeness) > 0.93, sorted(likeness.items(), key=lambda x: x[1])[:5]


def test_long_texts_are_like_their_edited_text(spark):
    """Under 0.3 are only texts that repeat themselves: most of their few signatures stay, and the next text brings more than there were."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in spotsigs.edits(docs).collect():
        if r.n_chars <= 200 or r.near_edited >= 0.3:
            continue
        own, edited = set(r.fingerprint.split()), set(r.edited_fingerprint.split())
        assert len(own & edited) >= 0.5 * len(own) and len(edited - own) > len(own), r.doc_id


def test_similar_pairs_equal_brute_force(spark, sf):
    base = "the red fox saw the old dog and the young cat under a tall tree by the cold river "
    rows = [(i, base * 2 + " ".join(f"the w{i}{j} x{j}" for j in range(i % 4))) for i in range(12)] + [(100, None), (101, ""), (102, base), (None, base + "the end of it all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").selectExpr("doc_id + 1000", "text"))
    got = {(r.a, r.b): r.similarity for r in spotsigs.similar_pairs(docs, 0.6).collect()}
    sets = {}
    for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is None, x)):
        sets.setdefault(frozenset(slow_signatures(t)), d)
    items = [(d, s) for s, d in sets.items()]
    named = lambda a, b: (min(x for x in (a, b) if x is not None), None if None in (a, b) else max(a, b))
    want = {named(a, b): len(x & y) / len(x | y) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if len(x & y) >= 0.6 * len(x | y)}
    assert got == pytest.approx(want) and want
