import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tallyforge.llm import bpe, mixing
from tests.llm.test_near_copies import slow_groups


def test_stages_in_order_each_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, docs.first().text, "en", "s", 1)], docs.schema)
    given = docs.union(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "near-dedup", "mixing", "tokens"]
    one = corpus_pipeline.identify_language(spark, given, sf).cache()
    assert one.columns == docs.columns
    dropped = {r.doc_id for r in given.collect()} - {r.doc_id for r in one.collect()}
    assert {9001, 9002} <= dropped and len(dropped) < 10
    two = corpus_pipeline.drop_near_copies(spark, one, sf).cache()
    root = slow_groups([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(set(root.values()))
    three = corpus_pipeline.mix_sources(spark, two, sf).cache()
    assert three.columns == docs.columns
    want = {r.doc_id: int(r.taken / r["size"] + 0.5) if r["size"] else 1 for r in mixing.taken(two).collect()}
    got = {}
    for r in three.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(P.path(corpus_pipeline.RANKS), P.PATTERN).ranks, special_tokens={})
    n = {r.doc_id: len(library.encode_ordinary(r.text)) for r in two.collect()}
    last = corpus_pipeline.encode_tokens(spark, three, sf).collect()
    assert len(last) == three.count() and all(r.n_tokens == n[r.doc_id] for r in last)


def test_empty_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
