"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that this process has named, until forget() removes them.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and driver and executors are one machine's.

    On any other master an unset folder is an error: executors would write to their own disks, and rows would be missing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str = "table") -> str:
    """A new name in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


#: Spark's switch that removes an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str = "table") -> str:
    """The folder in the shared one that df has been written to. The shuffle files of the write go with its end."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def written_in_shares(make: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str], what: str = "table", shares: int = 4) -> list[str]:
    """The folders of make(share) for each share of rows, dealt by a hash of keys, one after the other: rows with equal keys are in one share, and
    what is shuffled lies on disk for one share at a time."""
    at = F.pmod(F.xxhash64(*keys), F.lit(shares))
    return [written(make(rows.where(at == k)), what) for k in range(shares)]


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as a table in the shared folder and read again: what follows neither computes it anew nor depends on one executor."""
    path = written(df, what)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), for the rounds of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stands(paths: list[str]) -> bool:
    """Whether none of these folders has been removed."""
    return all(p in _made for p in paths)


def forget() -> int:
    """Removes the intermediate tables and archives made so far; returns how many. For a job that has written its result: frames
    that were returned before read from these tables."""
    return drop([*_made])


def drop(paths: list[str]) -> int:
    """Removes intermediate tables of this process that nothing reads any more; returns how many."""
    from pyarrow import fs

    for path in paths:
        _made.remove(path)
        at, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        if at.get_file_info(base).type != fs.FileType.NotFound:
            at.delete_dir(base)
    return len(paths)
