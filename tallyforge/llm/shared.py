"""Names, columns and small steps that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyforge.operators.storage import checkpointed, new_folder, stored  # noqa: F401
from tallyforge.operators.sums import running  # noqa: F401

#: White space that separates words, fixed by the contracts of the operators.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


# --- columns by place, so that no name of the caller's meets one of ours -------------------------------------------


def place(df: DataFrame, name: str) -> int:
    """Where df has the column: the one of exactly that name, else the only one that differs from it in case alone."""
    for alike in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        found = [i for i, c in enumerate(df.columns) if alike(c)]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"several columns are named like {name}")
    raise ValueError(f"no column is named {name}")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, **names: str) -> DataFrame:
    """The columns of df that names give, under its keys."""
    flat = numbered(df)
    return flat.select(*[F.col(f"c{place(df, name)}").alias(new) for new, name in names.items()])


def kept(df: DataFrame, made: list[str]) -> list[int]:
    """Places of df's columns that are not named, in any case, like one of made."""
    new = {m.lower() for m in made}
    return [i for i, c in enumerate(df.columns) if c.lower() not in new]


def named_back(out: DataFrame, df: DataFrame, made: list[str]) -> DataFrame:
    """out, which has numbered columns of df and those made, as df's columns of old and the new ones behind them."""
    places = kept(df, made)
    return out.select(*[f"c{i}" for i in places], *made).toDF(*[df.columns[i] for i in places], *made)


def with_python(df: DataFrame, column: str, made: StructType, make: Callable[[list], list[pa.Array]], rows: int = 500) -> DataFrame:
    """df with the columns that make(values of the column) gives, at most so many rows at once. Columns of df that are named like a
    new one, in any case, are replaced; all others stay, whatever their names."""
    names = made.fieldNames()
    places = kept(df, names)
    given = numbered(df).select(*[f"c{i}" for i in places], F.col(f"c{place(df, column)}").alias("given"))
    schema = StructType([StructField(f"c{i}", df.schema.fields[i].dataType) for i in places] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column(len(places)).to_pylist())], [*b.schema.names[:-1], *names])

    return given.mapInArrow(run, schema).toDF(*[df.columns[i] for i in places], *names)


# --- what Python workers keep --------------------------------------------------------------------------------------

_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object] = lambda: None) -> object:
    """What make() gives, kept by this Python worker for its next tasks. A worker holds one thing at a time: asking for another
    key drops it and gives its memory back, so the stages of a job that share workers do not add up in memory."""
    if key not in _held:
        if _held:
            _held.clear()
            given_back()
        _held[key] = make()
    return _held[key]


def given_back() -> None:
    """Returns freed memory to the system, where the C library can: of millions of small pieces it would keep the pages."""
    import ctypes
    import gc

    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# --- joins on keys of which some are hot ---------------------------------------------------------------------------

#: Rows of a key that one task takes in any case; keys above that and above a thousandth of all rows are hot, so there are never
#: more than a thousand of them.
HOT_ROWS, HOT_SHARE = 20_000, 1000


def lookup(rows: DataFrame, table: DataFrame, counts: DataFrame, key: str, by: Column) -> DataFrame:
    """rows joined with table, which has each of their keys once; counts (key, n) are the keys' rows, of which nulls are none.

    The rows of a hot key are dealt by a hash of `by` to several tasks, each with a copy of the table's row. Only the hot keys, at
    most HOT_SHARE, are broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n") > most).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.when(parts > 1, F.pmod(F.xxhash64(by), parts).cast("int")).otherwise(0)).drop("_hot", "_parts")
    copies = table.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")
