import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P

from tallyforge.llm import langid

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


def segmentations(word, voc):
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        if word[:j] in voc:
            for rest in segmentations(word[j:], voc):
                yield [voc[word[:j]], *rest]


def test_forward_and_expected_counts_sum_all_segmentations():
    voc, known = langid.vocabulary(VOCAB), langid.worker(VOCAB).known
    words, times = ["the", "étions", "a", "x日", "nation"], [1, 2, 3, 1, 1]
    p = np.random.default_rng(1).random((1 + max(voc.values()), 3)) * 1e-3
    for word, got in zip(words, langid.likelihoods(words, known, p)):
        assert np.allclose(got, np.log(sum(np.prod(p[s], axis=0) for s in segmentations(b" " + word.encode(), voc))))
    want = Counter()
    for word, n in zip(words, times):
        all_ = list(segmentations(b" " + word.encode(), voc))
        z = sum(math.exp(langid.START * len(s)) for s in all_)
        for s in all_:
            for k in s:
                want[k] += n * math.exp(langid.START * len(s)) / z
    got = dict(zip(*langid.expected(words, times, known)))
    assert all(abs(got.get(k, 0) - n) < 1e-9 for k, n in want.items())
    assert np.isfinite(langid.likelihoods(["x" * 50_000], known, p)).all()


def test_held_out_accuracy_and_fold(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(table.withColumn("score", table.n_chars), VOCAB).collect()
    assert len(rows) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.text]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_depend_on_text_alone_and_labels_of_held_out_rows_teach_nothing(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    fold = langid.held_out(table.doc_id)
    from pyspark.sql import functions as F

    lied = table.withColumn("lang", F.when(fold, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(df, VOCAB).collect()}
    assert key(table) == key(lied)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "123 !? ²", "en"), (None,
        "the dog", "fr"), (6, "the dog", None), (7, "la la la" * 30_000, "fr"), (1, "the cat and the dog", "en"), (8, "日本", "en"), (9, "Ⅷ ²", "en")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCAB).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    assert [by[k].lang_pred for k in ((3, None), (4, ""), (5, "123 !? ²"), (9, "Ⅷ ²"))] == ["und"] * 4 and by[3, None].score == 0
    assert by[None, "the dog"].held_out is False and by[None, "the dog"].lang_pred == by[6, "the dog"].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string"), VOCAB).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string"), VOCAB).count() == 0
