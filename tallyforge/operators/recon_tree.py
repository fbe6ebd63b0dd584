"""Recon of sides that are kept: sums of row hashes by bucket tell which buckets differ, and only those are read and joined.

A side is a table of (account_id, asset, value) in parts, one for each bucket of keys, with the digest of each bucket: the number of its
rows and the sum of their hashes. New rows are added to the buckets that they fall in, and the digests change in the same commit. If of K
keys W are wrong, about 1 - exp(-W / buckets) of the rows are read, whatever the history that made them; digests are one row for each bucket.
A bucket that differs is taken for equal with a probability of about 2 ** -64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.assets import normalize_precision
from tallyforge.operators import recon
from tallyforge.sources import versions

BUCKETS = 1024
#: The part that holds the digests.
DIGESTS = "digests"
SIDE = ("bucket", "account_id", "asset", "value")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("account_id", F.upper("asset")), F.lit(buckets)).cast("int")


def digests_of(side: DataFrame, name: str) -> DataFrame:
    """(bucket, n, digest). Values count as recon compares them. A key with a null meets nothing, so its hash carries the side's name."""
    fields = [F.coalesce(c.cast("string"), F.lit("-")) for c in (F.col("account_id"), F.col("asset"), normalize_precision(F.col("value"), F.col("asset")))]
    alone = F.when(F.col("account_id").isNull() | F.col("asset").isNull(), F.lit(name)).otherwise("")
    return side.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*fields, alone).cast("decimal(20,0)")).alias("digest"))


def add(rows: DataFrame, value: str, path: str, name: str, buckets: int = BUCKETS) -> list[int]:
    """Adds rows (account_id, asset, value) to the side at path, a new one if there is none; returns the buckets that were written.

    The buckets' numbers, at most as many as there are buckets, go through the driver, rows do not. A write that dies changes nothing, and
    a second write from the same version fails; so the caller adds each piece of the ledger once, by its ids.
    """
    spark, before = rows.sparkSession, versions.manifest(rows.sparkSession, path)
    new = recon.merged(rows, value).withColumn("bucket", bucket_of(buckets)).select(*SIDE)
    if before["version"]:
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        new = recon.merged(versions.read(spark, path, touched).select(*SIDE).union(new), "value").withColumn("bucket", bucket_of(buckets)).select(*SIDE)
    made = versions.laid_down(new.repartition("bucket"), path, "bucket")
    written = [int(b) for b in made]
    fresh = spark.read.schema(new.schema).parquet(*[f"{path}/{f}" for f in made.values()]) if made else new.limit(0)
    digests = digests_of(fresh, name)
    if before["version"]:
        kept = digests_at(spark, path).join(digests.select("bucket"), "bucket", "left_anti")
        digests = kept.union(digests)
    digests = digests.coalesce(1).withColumn("part", F.lit(DIGESTS))
    made |= versions.laid_down(digests, path, "part")
    versions.commit(spark, path, before, made, new.withColumn("n", F.lit(0).cast("long")).withColumn("digest", F.lit(0).cast("decimal(30,0)")).schema)
    return written


def digests_at(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, [DIGESTS]).select("bucket", "n", "digest")


def open_buckets(spark: SparkSession, truth: str, snapshot: str) -> list[int]:
    """Buckets whose digests differ or that only one side has."""
    a, b = (digests_at(spark, p).select("bucket", F.struct("n", "digest").alias(c)) for p, c in ((truth, "a"), (snapshot, "b")))
    return sorted(r[0] for r in a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())


def compare(spark: SparkSession, truth: str, snapshot: str) -> DataFrame:
    """recon.compare() of two sides with the same number of buckets; reads the buckets that differ."""
    found = open_buckets(spark, truth, snapshot)
    return recon.differing(*[versions.read(spark, p, found).select("account_id", "asset", "value") for p in (truth, snapshot)])
