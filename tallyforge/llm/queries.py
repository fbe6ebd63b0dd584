"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, centroids, chat, extraction, langid, licenses, media, merkle, mixing, simhash, spotsigs, url_filter, warc
from tallyforge.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.store(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    coded = F.concat_ws(" ", F.size("times").cast("string"), F.sha2(F.concat_ws(";", F.concat_ws(",", F.col("times").cast("array<string>")),
        F.concat_ws(",", F.col("codes").cast("array<string>"))), 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", coded.alias("feature"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edits(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "held_out", "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(*merkle.build(_table(spark, sf_dir, "documents")))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_bpe, op4_warc, op5_licenses, op6_chat, op7_media, op8_spotsigs, op9_mixing, op10_langid, op11_merkle, op12_extraction, op13_centroids)}
