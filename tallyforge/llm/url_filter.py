"""URL filter: host and path rules, and a character language-model ratio for the rest.

The urls that a rule accepts or rejects train two character models. A model interpolates orders 0 to 3 by
Witten-Bell smoothing and leaves out the orders whose context it has not met, so that its order varies. A url's
score is the mean, over its characters, of log P(accepted) - log P(rejected); the threshold is the one that
separates held-out ruled urls best. Symbols are folded to an alphabet of 40, so there are never more than
40^4 different grams: the model table has a fixed bound whatever the number of urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.llm.shared import ascii_lower, kept, lookup, named_back, numbered, place, stored

#: (verdict, rule); a rule is a host and the start of a path. Fixed by the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Letters a-z, 0 for any digit, ten marks, ^ before and $ after the url, * for all else.
SYMBOLS = 40
ORDER = 3
#: Thresholds are tried at multiples of 1/32 from -8 to 8.
STEPS, REACH = 32, 8
#: The model goes to every task up to so many grams (of about 30 bytes); a larger one is joined by a shuffle.
BROADCAST_GRAMS = 300_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no :// is."""
    part = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(found, part, 1)), F.regexp_extract(found, part, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host or a parent domain of it and the start of the path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, start = text.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """The url without its scheme, in the model's alphabet, with its ends marked."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), r"(?s)^.*?://", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "[0-9]", "0"), r"[^a-z0./_%?=&:#\-]", "*")
    return F.concat(F.lit("^" * ORDER), plain, F.lit("$"))


def grams(symbols: Column) -> Column:
    """All runs of ORDER + 1 symbols, one for each character to predict."""
    at = F.split(symbols, "")
    return F.transform(F.sequence(F.lit(1), F.size(at) - ORDER), lambda i: F.array_join(F.slice(at, i, ORDER + 1), ""))


def model(counts: DataFrame) -> DataFrame:
    """counts (gram, accepted, rejected) -> (gram, gain): log P(last | rest, accepted) - log P(last | rest, rejected)."""
    levels = [counts]
    for k in range(ORDER, 0, -1):  # each order's counts are sums of the next higher's
        levels.append(levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    known = None
    for k, level in enumerate(reversed(levels)):
        level = level.withColumn("context", F.substring("gram", 1, k))
        seen = level.groupBy("context").agg(*[x for c in ("accepted", "rejected") for x in (F.sum(c).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))])
        now = level.join(seen, "context")
        if known is None:
            now = now.withColumns({f"{c}_below": F.lit(1.0 / SYMBOLS) for c in ("accepted", "rejected")})
        else:
            now = now.withColumn("shorter", F.substring("gram", 2, k)).join(known, "shorter")
        p = {c: F.when(F.col(f"{c}_all") == 0,
            F.col(f"{c}_below")).otherwise((F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_below")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))) for c in ("accepted",
            "rejected")}
        now = now.select("gram", *[p[c].alias(f"{c}_p") for c in p])
        known = now.select(F.col("gram").alias("shorter"), *[F.col(f"{c}_p").alias(f"{c}_below") for c in p])
    return now.select("gram", (F.log("accepted_p") - F.log("rejected_p")).alias("gain"))


def best_threshold(scored: DataFrame) -> float:
    """scored (score, held_good, held_bad) -> of the multiples of 1/STEPS, the one at which score >= threshold separates held-out
    ruled urls best; ties: the smallest in size, then the lower. 0 unless both verdicts occur among them."""
    step = F.least(F.greatest(F.floor(F.col("score") * STEPS), F.lit(-REACH * STEPS)), F.lit(REACH * STEPS)).cast("int")
    bins = scored.where("held_good + held_bad > 0").groupBy(step.alias("step")).agg(F.sum("held_good").alias("good"), F.sum("held_bad").alias("bad"))
    every = scored.sparkSession.range(-REACH * STEPS, REACH * STEPS + 1).select(F.col("id").cast("int").alias("step"))
    upto, all_ = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    tried = (  # at most 2 * REACH * STEPS + 1 rows
        every.join(bins, "step", "left").fillna(0, ["good", "bad"])
        .select("step", F.sum("good").over(all_).alias("goods"), F.sum("bad").over(all_).alias("bads"), F.coalesce(F.sum("good").over(upto),
            F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(upto), F.lit(0)).alias("caught"))
        .where("goods > 0 and bads > 0")
    )
    best = tried.orderBy(((F.col("goods") - F.col("lost")) * F.col("bads") + F.col("caught") * F.col("goods")).desc(), F.abs("step"), "step").first()
    return best["step"] / STEPS if best else 0.0


def scores(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (key: folded url, rule, verdict, held) -> (scored, counts): scored (key, held_good, held_bad, score) with the score of each
    different folded url, rounded to 9 places, and counts (key, n)."""
    says = {v: (F.col("verdict") == v) for v in ("allow", "block")}
    ruled, held = F.col("rule").isNotNull(), F.col("held")
    tally = {f"{part}_{name}": F.count_if(ruled & says[v] & (held if part == "held" else ~held)) for part in ("train", "held") for v, name in (("allow", "good"), ("block", "bad"))}
    keys = stored(rows.groupBy("key").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in tally.items()]), "url-keys")
    every = keys.select("key", "train_good", "train_bad", "held_good", "held_bad", F.explode(grams(F.col("key"))).alias("gram"))
    counts = every.groupBy("gram").agg(F.sum("train_good").alias("accepted"), F.sum("train_bad").alias("rejected"))
    gains = stored(model(stored(counts, "url-counts")), "url-model")
    sent = F.broadcast(gains) if gains.count() <= BROADCAST_GRAMS else gains  # at most SYMBOLS ** (ORDER + 1)
    scored = every.join(sent, "gram").groupBy("key", "held_good", "held_bad").agg(F.round(F.avg("gain"), 9).alias("score"))
    return stored(scored, "url-scores"), keys.select("key", "n")


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, score and verdict (allow or block) for every row.

    The rule's verdict stands where a rule fits; else the url is allowed if its score reaches the calibrated threshold.
    Ruled urls whose md5 starts with 0, 1 or 2 calibrate and do not train. Null and empty urls: empty host and path, judged
    by the end mark alone. Very long urls are judged whole. Repeated rows are judged alike and all kept. No ruled url of one side: that
    side is uniform and the threshold is 0. Columns of pages named like a new one, in any case, are replaced; all others stay.
    """
    made = ["host", "path", "rule", "verdict", "score"]
    given, of = numbered(pages), F.col(f"c{place(pages, url)}")
    host, path = host_and_path(of)
    rows = given.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    held = F.col("rule").isNotNull() & F.substring(F.md5(F.coalesce(of, F.lit(""))), 1, 1).isin("0", "1", "2")
    rows = rows.withColumns({"held": held, "key": folded(of)})
    scored, counts = scores(rows.select("key", "rule", "verdict", "held"))
    at = best_threshold(scored)
    places = [f"c{i}" for i in kept(pages, made)]
    judged = lookup(rows.select(*places, "host", "path", "rule", "verdict", "key"), scored.select("key", "score"), counts, "key", F.to_json(F.struct(*places, "host")))
    judged = judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= at, "allow").otherwise("block")))
    return named_back(judged, pages, made)
