"""The corpus pipeline: language ID, near-dedup, mixing sources to target weights, byte-level BPE.

Each stage takes all that the one before kept, written as Parquet and read again. The last returns tokens, the others the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, langid, mixing, near_copies
from tallyforge.llm.shared import numbered, picked, place, stored

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text, without letters or without a language that is likelier than all others together."""
    flat = numbered(docs)
    judged = langid.identify(flat, public_tokenizers.path(RANKS), *[f"c{place(docs, c)}" for c in ("doc_id", "text", "lang")])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*flat.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word Jaccard of 0.8 or more): the one with the smallest doc_id, null last, and
    of rows with equal doc_id in a group the one whose text, then whose other columns have the smallest hash.

    A row is chosen, not an id: rows of one doc_id with unrelated texts each stay in their own group.
    """
    flat = numbered(docs)
    row_id, text = F.col(f"c{place(docs, 'doc_id')}").cast("long"), F.col(f"c{place(docs, 'text')}")
    groups = near_copies.near_copies(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("copy").isNull().alias("empty"), F.coalesce("copy", F.lit(0)).alias("copy")))
    kept = groups.groupBy("root").agg(first.alias("first")).select("root", "first.*")
    keyed = flat.select("*", row_id.isNull().alias("none"), F.coalesce(row_id, F.lit(0)).alias("doc_id"), text.isNull().alias("empty"),
        F.when(text.isNull(), 0).otherwise(F.xxhash64(text)).alias("copy"))
    rest = keyed.join(kept, ["none", "doc_id", "empty", "copy"])
    whole = F.struct(*flat.columns)
    one = rest.groupBy("root").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return one.select("row.*").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that the sources' words come near their targets."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's tokens, and digest of what they decode to."""
    return bpe.digests(picked(docs, doc_id="doc_id", text="text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language id", identify_language), ("near-dedup", drop_near_copies), ("mixing", mix_sources), ("tokens", encode_tokens)]

#: SQL has neither the hash of the bands nor the tokenizer's pattern; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
