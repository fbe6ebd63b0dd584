"""All operators and the four stages on tables whose other columns bear awkward names, with nulls everywhere, and on empty ones."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from tallyforge.llm import bpe, centroids, chat, extraction, langid, licenses, media, merkle, mixing, simhash, spotsigs, url_filter, warc

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
#: Names that operators use or return, in other cases, with dots, spaces and backticks.
NAMES = [
    "Host", "PATH", "_row", "_in", "given", "key", "held", "c0", "c1", "_size", "size", "Copy", "copies", "a.b", "a b", "tick`ed", "Score",
        "Lang_Pred", "HELD_OUT", "N_Tokens", "Ids", "decoded", "MEDIA", "Times", "node", "root", "fp", "h", "Component_Id", "_part",
    "none", "empty", "row", "start", "End", "License", "run", "own", "part", "Perspective", "n_bytes", "salt", "record_id", "payload", "sound", "first", "words",
]


def widened(df):
    """df among columns of all the names, with a map and a struct for two of them; rows repeat, and one has nulls alone."""
    odd = df.selectExpr(*[f"`{c}`" for c in df.columns[:1]],
        *[("map('k', 1)" if n == "key" else "named_struct('x.y', 2)" if n == "root" else "'x'") + f" AS `{n.replace('`', '``')}`" for n in NAMES if n.lower() not in [c.lower() for c in df.columns]],
        *[f"`{c}`" for c in df.columns[1:]])
    return odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The cat sat on the mat with a dog and the bird", "en", "s"), (1, "The cat sat on the mat with a dog and the bird", "en", "s"), (None,
        None, None, None), (2, "", None, "t"), (3, "le chat est sur la table avec un chien et les oiseaux", "fr", None), (None, "word " * 30_000,
        "en", "s"), (4, "Released under the MIT License.", "en", "t"), (1, "one id and another text for it, you see", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def counted(docs):
    return docs.selectExpr("*", "length(text) AS n_chars")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, None), (2, [1.0]), (None, [0.25] * 64), (3, [None] * 64)], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.org/fr/x", "<p>x</p>"), (1, "http://a.org/fr/x", "<p>x</p>"), (None, None, None), (2, "http://b.net/", ""), (3, "no url",
        "é" * 50_000), (None, "http://c.com/de/", "<p>x</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "a", "hello"), (1, 1, "b", None), (1, 1, "b", None), (None, None, None, None), (2, 5, None, "x" * 50_000)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


OPERATORS = {
    "op1": ("pages", lambda t: url_filter.judge(t)), "op2": ("docs", lambda t: simhash.near_duplicates(t)), "op3": ("docs", lambda t: bpe.digests(t,
        VOCAB, P.PATTERN)), "op3 ids": ("docs", lambda t: bpe.decode(bpe.encode(t, VOCAB, P.PATTERN), VOCAB, P.PATTERN)),
    "op4": ("pages", lambda t: warc.round_trip(t)), "op5": ("docs", lambda t: licenses.scan(t)), "op6": ("turns", lambda t: chat.rotate(t)),
        "op7": ("docs", lambda t: media.features(media.store(t))), "op8": ("docs", lambda t: spotsigs.edits(t)),
    "op8 pairs": ("docs", lambda t: spotsigs.similar_pairs(t)), "op9": ("docs", lambda t: mixing.taken(t)), "op9 mixed": ("docs",
        lambda t: mixing.mixed(t)), "op10": ("docs", lambda t: langid.identify(t, VOCAB)),
        "op11": ("counted", lambda t: merkle.manifest(*merkle.build(t, 1), 1)),
        "op12": ("pages", lambda t: extraction.extract(t)),
        "op13": ("vectors", lambda t: centroids.clustered(t)),
}
#: Operators that give their table back with new columns behind it, and those columns.
KEEPS = {"op1": "host path rule verdict score", "op3": "n_tokens ids_sha256 decoded_sha256", "op10": "held_out lang_pred score", "op9 mixed": ""}


def values(rows, columns):
    return sorted(str([r[i] for i in columns]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(request, name):
    table, operator = OPERATORS[name]
    plain = request.getfixturevalue(table)
    wide = widened(plain)
    got, want = operator(wide), operator(plain)
    shared = [c for c in want.columns if c in got.columns and c not in ("row", "times", "codes")]
    assert [c.lower() for c in got.columns].count(got.columns[-1].lower()) == 1
    rows, expected = got.collect(), want.collect()
    assert values(rows, [got.columns.index(c) for c in shared]) == values(expected, [want.columns.index(c) for c in shared])
    if name in KEEPS:
        made = KEEPS[name].split()
        assert got.columns == [c for c in wide.columns if c.lower() not in made] + made


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(request, name):
    table, operator = OPERATORS[name]
    assert operator(widened(request.getfixturevalue(table)).limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, docs, stage):
    wide, make = widened(docs), dict(corpus_pipeline.STAGES)[stage]
    got, want = make(spark, wide, sf), make(spark, docs, sf)
    if stage != "tokens":
        assert got.columns == wide.columns and want.columns == docs.columns
    kept = [c for c in want.columns]
    assert values(got.collect(), [got.columns.index(c) for c in kept]) == values(want.collect(), range(len(kept)))
    assert make(spark, wide.limit(0), sf).count() == 0


def test_two_columns_that_differ_in_case_alone(spark, docs):
    both = docs.toDF("doc_id", "text", "TEXT", "source")
    assert values(simhash.near_duplicates(both).collect(), [0, 1]) == values(simhash.near_duplicates(docs).collect(), [0, 1])
    with pytest.raises(ValueError):
        simhash.near_duplicates(both, text="Text")
