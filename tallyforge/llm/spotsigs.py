"""SpotSigs document fingerprints.

A signature is a common word (an anchor) with the content words that follow it; the signatures of a text are a set
that survives edits elsewhere in the text. The anchors are those of four languages written in Latin letters and, so that texts in other
languages and lists have them too, winnowed words: of each WINDOW successive words that whose chain has the least hash. Both kinds are
chosen by the words around them alone, so a changed word changes the signatures near it and no others, whatever the text as a
whole is like. Two sets are compared by Jaccard similarity, which cannot exceed the ratio of
their sizes: sets are partitioned by size so that only neighbouring partitions meet, and a pair whose sizes are too
far apart is not intersected. All by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import picked, stored

#: Common words of English, French, German and Spanish. Fixed values.
ANCHORS = (
    "a an and are as at be by can do for from has have he in is it not of on or that the there they this to was were which will with "
    "au ce dans de des du elle en est et eux il la le les ou par pas pour que qui sur un une "
    "als auf aus bei das dem den der die ein eine er es für ist mit nicht sie sich und von werden wie zu "
    "como con del el los las más no para pero por se su una y"
).split()
#: Marks that are no part of a word at its ends, as the inside of a character class: ASCII, Latin-1 and general punctuation.
MARKS = r"!-/:-@\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e"
#: Content words in a chain, and common words that may stand before each of them.
CHAIN, SPOT = 2, 8
#: Successive words of which one at least is an anchor; a power of two.
WINDOW = 4
#: Blocks of scripts written without spaces (Thai and Lao, Khmer, kana, Han), of which each character is a word. As ranges: to look up the
#: script of every character costs more than all other patterns together.
SCRIPTS = r"[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{323af}]"
#: Documents in a run of neighbours.
RUN = 2000


def _any_of(words: list[str]) -> str:
    """A pattern of the words, by their common beginnings, so that few alternatives are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (_any_of(tails) if tails != [""] else "") for h, tails in heads.items() if h]
    return "(?:" + "|".join(parts) + (")?+" if "" in heads else ")")


def normal(text: Column) -> Column:
    """The text's words in lower case and without marks at their ends, one space after each and a space before all. Characters of SCRIPTS
    are words of their own."""
    some = (F.octet_length(text) > F.char_length(text) + 1) & text.rlike(SCRIPTS)  # plain ASCII is not searched
    apart = F.when(some, F.regexp_replace(text, f"({SCRIPTS})", " $1 ")).otherwise(text)
    spaced = F.regexp_replace(F.lower(apart), r"[\x01\x09-\x0D ]{2,}+|[\x01\x09-\x0D]", " ")
    bare = F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), f"(?<= )[{MARKS}]++|[{MARKS}]++(?= )", "")
    return F.regexp_replace(bare, " {2,}+", " ")


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the text's signatures as a sorted set of 64-bit hashes.

    Each occurrence of a common word that is followed by CHAIN content words, each with at most SPOT common words before it, gives one,
    and each winnowed word with the CHAIN words after it gives one. A text of CHAIN words or fewer has one signature, made of all of
    its words. Columns are added one by one, so that none is computed twice.
    """
    chain = f"(?:\\x01[^ ]++ ){{0,{SPOT}}}+[^ \\x01][^ ]*+ " * CHAIN
    df = df.withColumn("_words", normal(F.coalesce(F.col(text), F.lit(""))))
    marked = F.regexp_replace("_words", f" ({_any_of(ANCHORS)})(?= )", " \x01$1")
    df = df.withColumn("_spots", F.regexp_extract_all(marked, F.lit(f"(?=(\\x01[^ ]++ {chain}))"), F.lit(1)))
    # the anchors inside the chain are left out: they are not what tells texts apart
    found = F.transform("_spots", lambda x: F.xxhash64(F.when(F.locate("\x01", x, 2) > 0, F.regexp_replace(x, r"(?<= )\x01[^ ]++ ", "")).otherwise(x)))
    own = F.array(F.xxhash64(F.concat(F.lit("="), "_words")))
    df = winnowed(df.withColumn("_each", F.split(F.trim("_words"), " ")), "_each", "_least")
    both = F.array_distinct(F.concat(found, "_least"))
    return df.withColumn(name, F.sort_array(F.when(F.size("_each") > CHAIN, both).otherwise(own))).drop("_words", "_spots", "_each", "_least")


def winnowed(df: DataFrame, words: str, name: str) -> DataFrame:
    """df with the hashes of those chains of CHAIN + 1 words that are the least of some WINDOW successive chains (of all, if fewer)."""
    hashed = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, CHAIN + 1)]))
    df = df.withColumn(name, F.slice(hashed, 1, F.greatest(F.size(words) - CHAIN, F.lit(0))))
    df = df.withColumn("_chains", F.size(name))
    step = 1
    while step < WINDOW:  # the least of 2, 4, ... successive chains from each on
        df = df.withColumn(name, F.zip_with(name, F.slice(name, step + 1, F.col("_chains")), lambda x, y: F.least(x, y)))
        step *= 2
    return df.withColumn(name, F.array_distinct(F.slice(name, 1, F.greatest(F.col("_chains") - (WINDOW - 1), F.lit(1))))).drop("_chains")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look into them where their sizes alone keep it under least."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(small < large * F.lit(least), 0.0).otherwise(F.when(large == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, own, next_text, of_next): each text and the next document's by ascending doc_id, after the last the first's, with
    their signatures.

    Null ids come first; equal ids are ordered by text. Ids are cut into runs of about RUN documents at quantiles; the document that
    starts a run is also sent to the run before, so that each run finds its neighbours by itself and texts move once.
    """
    rows = picked(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    runs = min(1 << 14, max(1, seen["n"] // RUN))
    cuts = []
    if runs > 1:
        quantiles = rows.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 100 * runs).alias("q")).first()["q"]
        cuts = [x for x in sorted(set(quantiles or [])) if x > seen["least"]]
    depth = len(cuts).bit_length()
    bounds = F.lit([*cuts, *[(1 << 63) - 1] * ((1 << depth) - 1 - len(cuts))] or [(1 << 63) - 1]).cast("array<bigint>")

    run = F.lit(0)
    if cuts:  # binary search
        run = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(depth))]), F.lit(0), lambda at,
            step: at + F.when(F.coalesce(F.element_at(bounds, at + step) <= F.col("doc_id"), F.lit(False)) & (at + step <= len(cuts)),
            step).otherwise(0))
    rows = rows.withColumn("run", run)
    starts = F.when(F.col("run") > 0, F.element_at(bounds, F.greatest(F.col("run"),
        F.lit(1))) == F.col("doc_id")).otherwise(F.col("doc_id").eqNullSafe(F.lit(None if seen["nulls"] else seen["least"]).cast("long")))
    before = F.when(F.col("run") > 0, F.col("run") - 1).otherwise(len(cuts))
    copies = F.array_compact(F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("ahead")), F.when(starts, F.struct(before.alias("run"), F.lit(True).alias("ahead")))))
    sent = rows.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.run", "to.ahead").repartition("run")
    sent = with_signatures(sent, "text", "own")  # where the runs are: texts are moved, signatures are not
    order = Window.partitionBy("run").orderBy("ahead", F.col("doc_id").asc_nulls_first(), "text")
    ahead = sent.withColumns({"next_text": F.lead("text").over(order), "of_next": F.lead("own").over(order)})
    return ahead.where("not ahead").select("doc_id", "text", "own", "next_text", "of_next")


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against itself with
    its last quarter replaced by the start of the next document, and against the next document.

    A fingerprint is its signatures joined by spaces. Null and empty texts have 0 characters and the signature of no words. A
    single document is its own next. Very long texts are taken whole. Repeated rows are kept; other columns are not returned. The pairs
    compared are given, so nothing is left to prune: near_edited and near_next are the exact similarities.
    """
    rows = with_next(docs, doc_id, text)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_signatures(rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "of_next"), "edited", "of_edited")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join(F.col("own").cast("array<string>"), " ").alias("fingerprint"),
            F.array_join(F.col("of_edited").cast("array<string>"), " ").alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("of_edited")).alias("near_edited"), jaccard(F.col("own"), F.col("of_next")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, similarity): all pairs of different signature sets whose Jaccard similarity is at least `least`, each set by the smallest
    doc_id of its documents, which is null where all are.

    Sets are partitioned by size: partition k holds sizes from least^-k on, so a set meets only its own partition and the next.
    Within those, sets meet that share one of their rarest signatures: of a set with n, any set that is similar enough holds
    one of the n - ceil(least * n) + 1 rarest. Documents with equal sets are one set, so copies are not expanded into pairs; the
    pairs of a family of n different sets that are all alike are n * (n - 1) / 2, being what is asked for.
    """
    from math import log

    given = picked(docs, doc_id=doc_id, text=text)
    sets = with_signatures(given, "text", "s").withColumn("set", F.xxhash64("s")).groupBy("set", "s").agg(F.min("doc_id").alias("id"))
    sets = stored(sets.withColumn("n", F.size("s")).withColumn("part", F.floor(F.log("n") / F.lit(-log(least)) + 1e-9)), "spotsigs")
    spots = sets.select("set", "n", "part", F.explode("s").alias("x"))
    rank = Window.partitionBy("set").orderBy("freq", "x")
    rare = spots.join(spots.groupBy("x").agg(F.count("*").alias("freq")), "x").withColumn("place", F.row_number().over(rank))
    rare = rare.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("set", "n", "part", "x")
    met = rare.select(F.col("set").alias("a"), F.col("n").alias("na"), "x", F.explode(F.array("part",
        F.col("part") + 1)).alias("part")).join(rare.select(F.col("set").alias("b"), F.col("n").alias("nb"), "x", "part"), ["x", "part"])
    met = met.where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))).where(F.col("na") >= F.col("nb") * least - 1e-9).select("a", "b").distinct()
    both = met.join(sets.select(F.col("set").alias("a"), F.col("s").alias("sa"), F.col("id").alias("ida")),
        "a").join(sets.select(F.col("set").alias("b"), F.col("s").alias("sb"), F.col("id").alias("idb")), "b")
    found = both.select("ida", "idb", jaccard(F.col("sa"), F.col("sb"), least).alias("similarity")).where(F.col("similarity") >= least)
    return found.select(F.least("ida", "idb").alias("a"), F.when(F.col("ida").isNotNull() & F.col("idb").isNotNull(), F.greatest("ida", "idb")).alias("b"), "similarity")
