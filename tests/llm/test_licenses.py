import random

import pytest

from tallyforge.llm import licenses
from tallyforge.llm.licenses import TEMPLATES, Index, align, matches, words_of

INDEX = Index(TEMPLATES)


def test_every_template_finds_itself_with_its_span():
    for name, text in TEMPLATES.items():
        before = "Some words before. "
        found = matches(before + text + " And after", INDEX)
        assert name in [m[0] for m in found] and found[0][1] == 1.0
        best = next(m for m in found if m[0] == name)
        assert (before + text)[best[3] : best[4]] == text.rstrip("./")


def test_edits_are_aligned():
    words = TEMPLATES["MIT/text"].split()
    changed = " ".join(words[:20] + ["really", "truly"] + words[20:50] + words[53:])
    (m,) = matches(changed, INDEX)
    assert m[0] == "MIT/text" and 0.9 < m[1] < 1 and m[2] == len(INDEX.templates["MIT/text"]) - 3


@pytest.mark.parametrize("n", [1, 12, 300, 900])
def test_text_put_in_the_middle_does_not_hide_a_notice(n):
    words = TEMPLATES["MIT/text"].split()
    filler = [f"w{i}" for i in range(n)]
    text = " ".join(["x"] * 5 + words[:60] + filler + words[60:] + ["y"] * 5)
    (m,) = matches(text, INDEX)
    assert (m[0], m[1], text[m[3] : m[4]]) == ("MIT/text", 1.0, " ".join(words[:60] + filler + words[60:]).rstrip("."))


def test_letters_that_change_length_in_lower_case_do_not_shift_spans():
    for mark in ("İ", "K", "İİ x", "ẞ"):
        text = f"{mark} Released under the MIT License. tail words here"
        (m,) = matches(text, INDEX)
        assert text[m[3] : m[4]] == "Released under the MIT License"
    assert matches("Released under the MIT Lİcense", INDEX)[0][2] == 4  # of five words


def test_close_templates_are_told_apart_and_clean_texts_have_none():
    assert [m[0] for m in matches("Licensed under CC BY-NC 4.0.", INDEX)] == ["CC-BY-NC-4.0/line"]
    assert [m[0] for m in matches("x LICENSED under cc by 4.0 y Released under the MIT License.", INDEX)] == ["CC-BY-4.0/line", "MIT/line"]
    assert matches("The license plate was released under the bridge of the city.", INDEX) == []
    assert matches("Licensed under CC " + "x " * 30 + "BY 4.0", INDEX) == []
    assert matches(None, INDEX) == matches("", INDEX) == []


def slow_align(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_alignment_equals_the_longest_common_subsequence_in_a_wide_band():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 9))] for _ in "xy")
        n, first, last = align(a, b, [(0, 0, 0)], band=20)
        assert n == slow_align(a, b)
        if n:
            assert 0 <= first <= last < len(b) and slow_align(a, b[first : last + 1]) == n


def edited(words, rnd, vocabulary):
    """The words with changes, omissions and insertions, some of them long."""
    out, i = [], 0
    while i < len(words):
        kind = rnd.random()
        if kind < 0.03:
            out.append(rnd.choice(vocabulary))
        elif kind < 0.05:
            i += rnd.randrange(3)
        elif kind < 0.07:
            out += rnd.choices(vocabulary, k=rnd.choice((1, 2, 5, 40, 200))) + [words[i]]
        else:
            out.append(words[i])
        i += 1
    return out


def test_candidates_against_aligning_every_template_everywhere():
    """Recall of the index: texts with an edited notice, against each template's whole alignment with the whole text."""
    rnd, vocabulary = random.Random(7), [f"v{i}" for i in range(400)] + ["the", "of", "and", "to", "software", "license"]
    long = {n: w for n, w in INDEX.templates.items() if len(w) >= licenses.LONG}
    wanted = met = 0
    for _ in range(80):
        text = rnd.choices(vocabulary, k=100) + edited(long[rnd.choice(sorted(long))], rnd, vocabulary) + rnd.choices(vocabulary, k=100)
        possible = {n for n, w in long.items() if slow_align(w, text) >= licenses.LEAST * len(w)}
        found = {m[0] for m in matches(" ".join(text), INDEX)}
        best = {n for n in possible if slow_align(long[n], text) == max(slow_align(long[x], text) for x in possible)}
        wanted += bool(possible)
        met += bool(found & best)
        assert found & set(long) <= possible
    assert wanted > 60 and met >= 0.97 * wanted


def test_long_and_repetitive_texts():
    assert len(matches("Released under the MIT License. " * 3000, INDEX)) == 3000
    assert matches("the software is provided as is " * 2000, INDEX) == []


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0").write_text("You may do with this work what you like as long as you tell us.")
    given = licenses.templates_from(spark, str(tmp_path))
    assert [m[0] for m in matches("so you may do with this work what you like, as long as you tell us", Index(given))] == ["Own-1.0"]


def test_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(-1, None, None, None, None), (None,
        "Released under the MIT License. " * 2, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    lines = [t for n, t in TEMPLATES.items() if n in ("MIT/line", "Apache-2.0/line", "GPL-3.0/line", "CC-BY-NC-4.0/line")]
    want = {r.doc_id: sum(r.text.count(t) for t in lines) for r in docs.collect() if r.text and any(t in r.text for t in lines)}
    got = {}
    for r in licenses.scan(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and want[None] == 2
    assert licenses.scan(docs.limit(0)).count() == 0


def test_scan_equals_aligning_each_line_everywhere(spark, sf):
    """Every document against every short template, word by word."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    short = {n: w for n, w in INDEX.templates.items() if len(w) < licenses.LONG and n.endswith("/line")}
    want = set()
    for r in docs.collect():
        words = words_of(r.text)
        want |= {(r.doc_id, n) for n, w in short.items() for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w}
    assert want <= {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
