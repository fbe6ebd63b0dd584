"""Tables as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.storage import stored
from tallyforge.sources import versions


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table, read in parts of its key. The driver's jar has to be there."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def write_clearing_results(results: DataFrame, path: str) -> None:
    """Upserts results by (batch_id, account_id, asset in any case): a row with a stored row's key replaces it, all other rows of the batch
    stay. Of several new rows with one key the last by updated_at, or by all columns where there is none, stands.

    Only the batches that results has are read and written, as new parts of a table of versions: a run that fails leaves the table as it
    was. versions.read() reads it.
    """
    spark = results.sparkSession
    given = stored(results.withColumn("_new", F.lit(True)))
    ids = [r[0] for r in given.select("batch_id").distinct().collect()]  # few: a batch is a run of the clearing job
    before = versions.manifest(spark, path)
    stored_rows = versions.read(spark, path, ids)
    both = given if stored_rows is None else given.unionByName(stored_rows.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    order = F.xxhash64(F.to_json(F.struct(*results.columns)))
    newest = [F.col("_new").desc(), *([F.col("updated_at").desc_nulls_last()] if "updated_at" in results.columns else []), order.desc()]
    place = F.row_number().over(Window.partitionBy("batch_id", "account_id", F.upper("asset")).orderBy(*newest))
    kept = stored(both.withColumn("_place", place).where("_place = 1").drop("_place", "_new"))
    versions.replace_parts(kept, path, "batch_id", before=before)


def write_recon_diffs(diffs: DataFrame, path: str, batch_id: int) -> None:
    """The differences of a batch instead of those that it had, at once; none, too, replaces them. versions.read() reads the table."""
    rows = diffs.drop("recon_batch_id").withColumn("recon_batch_id", F.lit(batch_id).cast("long"))
    versions.replace_parts(rows, path, "recon_batch_id", [batch_id])
