"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the mix has the golden-ratio point frac(n * phi), in fixed point; the point falls into one source's share of the
cumulative targets, and the slot's rank among that source's slots says which block of the source it takes. A source's
blocks are runs of BLOCK words of its documents in shuffled order (by md5 of doc_id), one epoch after the other. So any
stretch of the mix has the sources near their shares, and a rerun gives the same mix. Where the schedule gives a source a
few slots less than its target needs, they follow at the end; slots beyond the target stay empty.

Ranks and word positions are prefix sums of two levels (within buckets, then over buckets), so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import n_words, numbered, picked, place, running, stored

#: Words in a block; slots that are ranked together; buckets of a source's shuffled order.
BLOCK, RUN, BUCKETS = 256, 4096, 4096
#: A target is at most so many times its source's size. Fixed by the contract, as are the weights.
MOST, WEIGHTS = 3, (1, 2, 3)
#: The golden ratio's fraction in units of 2^-30, odd: every point comes once in 2^30 slots.
GOLDEN, UNIT = 663608941, 1 << 30


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) -> with ix (place by code point, null last), weight and target.

    The targets share all words by weight, stop at most times the source's size, and the rest is shared again: a source is
    full where its size to weight is below the level at which the others' shares add up to the rest. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("ix", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ix") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", "ix", weight.alias("weight"), (F.col("source_size") * most).alias("full"))
    order = [F.col("full") / F.col("weight"), F.col("ix")]
    upto, after, every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = ranked.select("*", (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(upto), F.lit(0))).alias("rest"), F.sum("weight").over(after).alias("weights"))
    left = left.withColumn("open", F.col("full") * F.col("weights") > F.col("rest") * F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "rest", "weights"))).over(every)
    level = left.withColumn("first", first)
    target = F.when(F.col("first").isNull() | ~F.col("open"), F.col("full").cast("double")).otherwise((F.col("first.rest") * F.col("weight")).cast("double") / F.col("first.weights").cast("double"))
    return level.select("source", "source_size", "ix", "weight", target.alias("target"))


def schedule(sources: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """sources (ix, target) -> (slot, ix, rank): which source's block each slot takes, as many as the targets need.

    total is the sum of all sizes. The rounded targets are each source's words.
    """
    spark = sources.sparkSession
    n = -(-total // block)
    order = Window.orderBy("ix")
    shares = sources.select("ix", F.ceil(F.round("target").cast("long") / block).cast("long").alias("needed"), (F.sum("target").over(order) / F.lit(float(max(total, 1))) * UNIT).alias("to"))
    shares = shares.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0.0)))
    # a source's share of the unit range is cut along a grid, a few times finer than the sources, so that a point finds it by an equal cell
    cells = 1 << min(28, max(10, sources.count().bit_length() + 2))
    held = shares.where("to > from").withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / (UNIT // cells)), F.least(F.floor(F.col("to") / (UNIT // cells)), F.lit(cells - 1)))))
    point = (F.col("id") % UNIT * GOLDEN) % UNIT
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point / (UNIT // cells)).alias("cell"))
    slots = slots.join(held, "cell").where("point >= from and point < to").select("slot", "ix", "needed", F.floor(F.col("slot") / RUN).alias("run"))
    ranked = running(slots, ["ix"], "run", ["slot"], F.lit(1), "rank").where("rank < needed").select("slot", "ix", "rank")
    met = slots.groupBy("ix").agg(F.count("*").alias("met"))
    missing = shares.join(met, "ix", "left").select("ix", "needed", F.coalesce("met", F.lit(0)).alias("met")).where("met < needed")
    missing = missing.select("ix", "met", F.explode(F.sequence(F.col("met"), F.col("needed") - 1)).alias("rank"))
    turn = (F.col("rank") - F.col("met")) * F.lit(sources.count()) + F.col("ix")  # the sources take turns
    return ranked.unionByName(missing.select((F.lit(n) + turn).alias("slot"), "ix", "rank"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, takes): documents (doc_id, source, size, source_size, target, ix, start, row) and takes (slot, ix, rank, doc_id,
    row, first, words): which words of which document each slot of the mix takes, first counting from 0.

    Null texts have size 0; null sources are one source, last in order; null doc_ids are mixed like others. Repeated rows are
    rows of their own; ties in the shuffled order fall to doc_id and size. No row: both empty. Other columns are not returned.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    given = picked(docs, doc_id=doc_id, text=text, source=source)
    sized = stored(given.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rows = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * BUCKETS / (1 << 24)))
    rows = stored(running(rows, ["ix"], "bucket", ["key", "doc_id", "size", "row"], F.col("size"), "start").drop("bucket", "key"), "mix-rows")
    quota = F.round("target").cast("long")
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    pieces = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("ix", "doc_id", "row",
        at.alias("at"), F.least(at + F.col("size"), quota).alias("end")).where("at < end")
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest("at", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = pieces.select("ix", "rank", "doc_id", "row", (low - F.col("at")).alias("first"), (high - low).alias("words"))
    return rows, schedule(sources, total, block).join(pieces, ["ix", "rank"]).select("slot", "ix", "rank", "doc_id", "row", "first", "words")


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, row): the words that the mix takes of each document, repeats counted. A row for
    every row of docs, whatever it holds; options and odd rows as in mix()."""
    rows, takes = mix(docs, **options)
    sums = takes.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix has them: a document once for each whole time that the mix takes it, and once more for half or more
    of its words; not at all where it takes less. Null and empty texts and others without words are kept once. Rows of one doc_id, source
    and size share what is taken of them evenly. All columns of docs and no others, whatever their names; an empty table stays empty."""
    plan = taken(docs, doc_id=doc_id, text=text, source=source).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    times = F.when(F.col("size") == 0, 1.0).otherwise(F.col("taken") / F.col("rows") / F.col("size"))
    plan = plan.select("doc_id", "source", "size", F.floor(times + 0.5).cast("int").alias("copies")).where("copies > 0")
    flat = numbered(docs)
    of_id, of_text, of_source = (F.col(f"c{place(docs, c)}") for c in (doc_id, text, source))
    sized = flat.select("*", n_words(of_text).alias("words"))
    kept = sized.join(plan, of_id.eqNullSafe(F.col("doc_id")) & of_source.eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*flat.columns).toDF(*docs.columns)
