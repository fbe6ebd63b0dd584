import hashlib
import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from tallyforge.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a  b", "\n\n x\r\n\ty ", "it's we'll 'S x's  's don't", "a\x1cb \x1c c\x85d　　e", "x" * 700, " " * 900 + "y", "日本語 テキスト 123 ４５６ ½ Ⅷ",
    "é" * 50, "́á é", "12345 67.89,  \n", "🙂🙂 a🙂b", "\x00\x01", "word,€ x€, <b>q</b>", "<|endoftext|>", "ÀÖ×ß÷ǅɏɐ   x",
]
#: Numbers in threes, so that pieces cross the places where the public pattern's chunks are cut.
OTHER = r" ?\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+\s*|\s+"


def tiktoken_of(codec, pattern):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return tiktoken_of(bpe.codec(RANKS, P.PATTERN), P.PATTERN)


def ids_of(codec, text):
    return ",".join(x for x, _ in next(codec.texts([text])))


def test_ids_equal_the_library_and_decode_to_the_text(spark, sf, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'x' AS ids", "3 AS n_tokens")
    rows = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.digests(docs, RANKS, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 800)
    monkeypatch.setattr(bpe, "CHARS", 10)
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    c = bpe.Codec(RANKS, P.PATTERN)
    for text, got in zip(ODD * 2, c.texts(ODD * 2)):
        assert ",".join(x for x, _ in got) == ",".join(map(str, library.encode_ordinary(text or "")))


def test_another_pattern(library):
    c = bpe.Codec(RANKS, OTHER)
    other = tiktoken_of(c, OTHER)
    for text in [*ODD, "12345678 a1234, \n\n b", "x123456789y !?  z"]:
        assert ids_of(c, text) == ",".join(map(str, other.encode_ordinary(text or "")))


@pytest.mark.parametrize("step", [2, 5, 128])
def test_windows_of_long_pieces_equal_the_library(library, monkeypatch, step):
    """Short steps often share no token at first, so that windows widen."""
    monkeypatch.setattr(bpe, "STEP", step)
    c, rnd = bpe.Codec(RANKS, P.PATTERN), random.Random(step)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "x", "日本語éa", "etaoin", "thein"):
        for n in (1, 7, 60, 300, 3000):
            text = "".join(rnd.choice(letters) for _ in range(n))
            assert ids_of(c, text) == ",".join(map(str, library.encode_ordinary(text)))
    for mark in ("=", "-=", " ", "\n"):
        assert ids_of(c, mark * 1500) == ",".join(map(str, library.encode_ordinary(mark * 1500)))


def test_a_million_letters_without_a_gap(library):
    text, began = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), time.monotonic()
    assert ids_of(bpe.codec(RANKS, P.PATTERN), text) == ",".join(map(str, library.encode_ordinary(text)))
    assert time.monotonic() - began < 240


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, RANKS, P.PATTERN).count() == bpe.encode(docs, RANKS, P.PATTERN).count() == 0


def test_contracting_all_places_at_once_equals_one_after_the_other(library):
    c, r = bpe.codec(RANKS, P.PATTERN), random.Random(3)
    for alphabet in ("ab", "=-", "哈", "哈哈a", "ーあ", "ㅋㅎ", "etaoin"):
        words = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))).encode() for _ in range(200)]
        assert c._contracted(words, bpe.CONTRACT_ALL) == c._contracted(words)


@pytest.mark.parametrize("sign, n", [("哈", 100_000), ("ー", 6000), ("。", 6000), ("ㅋ", 6000), ("哈ㅋ", 3000)])
def test_a_repeated_sign_out_of_phase_takes_time_in_proportion(library, sign, n):
    began = time.perf_counter()
    assert ids_of(bpe.codec(RANKS, P.PATTERN), sign * n) == ",".join(map(str, library.encode_ordinary(sign * n)))
    assert time.perf_counter() - began < 60


def words_of_bytes(n):
    """Words over few and many letters and bytes, and ends of tokens put together, none of them a token."""
    r, tokens = random.Random(n), list(bpe.codec(RANKS, P.PATTERN).ranks)
    alphabets = [x.encode() for x in ("a", "ab", "the ", "etaoin shr", "0123", "=-", "éèàü", "日本語", "哈ㅋ", "יהו", "нета")] + [bytes(range(256)), b"\xe3\x81\x82\x80"]
    found = [bytes(r.choice(a) for _ in range(r.randint(1, 24))) for a in alphabets for _ in range(n)]
    found += [b"".join(t[r.randrange(len(t)) :] if r.random() < 0.5 else t for t in r.sample(tokens, r.randint(1, 5))) for _ in range(9 * n)]
    return [x for x in found if x not in bpe.codec(RANKS, P.PATTERN).ranks]


@pytest.mark.parametrize("query", [bpe.CONTRACT, bpe.CONTRACT_ALL])
def test_contracting_sure_pairs_first_equals_the_library(library, query):
    words = words_of_bytes(150)
    got = bpe.codec(RANKS, P.PATTERN)._contracted(words, query)
    assert got == [(",".join(map(str, library._encode_single_piece(x))), x) for x in words]


def test_the_query_gets_fewer_rows_than_bytes(spark, sf):
    """Each round of the query reads every row of its words, so rows are what new words cost."""
    c, words = bpe.Codec(RANKS, P.PATTERN), {x for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect() for x in (r.text or "").encode().split()}
    words = [x for x in words if x not in c.ranks and len(x) <= 2 * bpe.STEP]
    c._contracted(words)
    assert c.db.sql("SELECT count(*) FROM given_pieces").fetchall()[0][0] < 0.8 * sum(map(len, words))
