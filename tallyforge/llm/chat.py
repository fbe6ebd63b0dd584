"""Multi-party perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as the assistant and the others as named users, and a
mask says which characters are the assistant's words. A perspective's dialogue is the concatenation of its parts in order: a
part has the turns of WINDOW consecutive turn numbers, and where turns repeat numbers there are splits of WINDOW turns; so no row,
however long the conversation, holds all of it. Masks and starts count characters from the beginning of the whole dialogue, so
where it is cut does not show in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import picked, running, stored

#: Turn numbers in a part.
WINDOW = 64
#: Parts whose lengths are added up together.
RUN = 1024
#: The marks around a message. Fixed values.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT, USER = f"{OPEN}assistant{CLOSE}", f"{OPEN}user name="
NOBODY = "unknown"


def _unmarked(text: Column) -> Column:
    """The text with a space inside what would read as the start or end of a mark, so that no text or role forges a turn."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _header(role: Column, perspective: Column) -> Column:
    return F.when(role == perspective, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), role, F.lit(CLOSE)))


def _starts(parts: DataFrame) -> DataFrame:
    """parts (conv_id, part, split, turns) -> (conv, of_part, of_split, perspective, start): the characters before each part as each
    participant sees the dialogue. Lengths alone, added up within parts, within runs of parts and over runs."""
    turns = parts.select(F.col("conv_id").alias("conv"), F.col("part").alias("of_part"), F.col("split").alias("of_split"), F.explode("turns").alias("m"))
    as_user = len(USER) + len(CLOSE) + F.char_length("m.role")
    keys = ["conv", "of_part", "of_split"]
    both = turns.groupBy(*keys, "m.role").agg(F.sum(as_user + F.char_length("m.text") + len(END)).alias("n"), F.sum(len(ASSISTANT) - as_user).alias("own"))
    people = both.select(F.col("conv").alias("_conv"), F.col("role").alias("perspective")).distinct()
    lengths = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("role", "own"))).alias("own"))  # a role for each of WINDOW turns at most
    seen = lengths.join(people, F.col("conv").eqNullSafe(F.col("_conv"))).select(*keys, "perspective", (F.col("n") + F.coalesce(F.col("own")[F.col("perspective")], F.lit(0))).alias("n"))
    inside = running(seen.withColumn("run", F.floor(F.col("of_split") / RUN)), ["conv", "perspective", "of_part"], "run", ["of_split"], F.col("n"), "inside").drop("run")
    whole = seen.groupBy("conv", "perspective", "of_part").agg(F.sum("n").alias("n")).withColumn("run", F.floor(F.col("of_part") / RUN))
    before = running(whole, ["conv", "perspective"], "run", ["of_part"], F.col("n"), "before").select(F.col("conv").alias("_conv"),
        F.col("perspective").alias("_me"), F.col("of_part").alias("_part"), "before")
    both = inside.join(before, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_me")) & (F.col("of_part") == F.col("_part")))
    return both.select(*keys, "perspective", (F.col("before") + F.col("inside")).alias("start"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(conv_id, perspective, part, split, start, n_turns, n_own, rendered, n_chars, mask): every part of every conversation as each of its
    participants sees it. The texts rendered of one perspective, in order of part and split, are its whole dialogue.

    start is the number of characters of the dialogue before the part. mask lists the assistant's character ranges in the whole
    dialogue, start-end with the end excluded, its end mark included, joined by ";"; empty where the participant is silent. Turns are in
    order of turn, then role, then text; turns without a number make part -1. A null role is the participant NOBODY, a null text is
    empty, null conv_ids are one conversation. Repeated rows are repeated turns. A very long text stays in one row. Marks in texts
    and roles are broken up by a space. Columns of turns other than these four are not used, whatever their names.
    """
    said = picked(turns, conv_id=conv_id, turn=turn, role=role, text=text).select("conv_id", F.col("turn").cast("long"), _unmarked(F.coalesce("role",
        F.lit(NOBODY))).alias("role"), _unmarked(F.coalesce("text", F.lit(""))).alias("text"))
    said = said.withColumn("part", F.coalesce(F.floor(F.col("turn") / window), F.lit(-1)))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text"))
    said = said.withColumn("split", F.floor((place - 1) / window))
    parts = stored(said.groupBy("conv_id", "part", "split").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")), "chat-parts")
    seen = parts.join(_starts(parts), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("of_part")) & (F.col("split") == F.col("of_split")))
    me = F.col("perspective")
    pieces = F.transform("turns", lambda m: F.concat(_header(m["role"], me), m["text"], F.lit(END)))
    own = F.transform("turns", lambda m: m["role"] == me)
    first = F.transform("turns", lambda m: F.char_length(_header(m["role"], me)))
    seen = seen.select("conv_id", "perspective", "part", "split", "start", F.size("turns").alias("n_turns"), pieces.alias("pieces"), own.alias("own"), first.alias("first"))
    begin = F.struct(F.col("start").cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.char_length(m["pieces"])
        span = F.concat((acc["at"] + m["first"]).cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    seen = seen.withColumn("made", F.aggregate(F.arrays_zip("pieces", "own", "first"), begin, step))
    numbers = {"part": "part", "split": "split", "start": "start", "n_turns": "n_turns", "n_own": F.size("made.spans"), "n_chars": F.col("made.at") - F.col("start")}
    made = {k: (F.col(v) if isinstance(v, str) else v).cast("long").alias(k) for k, v in numbers.items()}
    return seen.select("conv_id", "perspective", *[made[k] for k in ("part", "split", "start", "n_turns", "n_own")], F.array_join("pieces",
        "").alias("rendered"), made["n_chars"], F.array_join("made.spans", ";").alias("mask"))


def _sql_unmarked(x: str) -> str:
    return f"replace(replace({x}, '<|', '< |'), '|>', '| >')"


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, {_sql_unmarked(f"coalesce(role, '{NOBODY}')")} AS role, {_sql_unmarked("coalesce(text, '')")} AS text, coalesce(floor(turn / {WINDOW})::BIGINT, -1) AS part FROM conversations
), cut AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, text) - 1) // {WINDOW} AS split FROM said),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM said),
lines AS (
  SELECT s.conv_id, perspective, part, split, turn, role, text, role = perspective AS own,
         CASE WHEN role = perspective THEN '{OPEN}assistant' ELSE '{OPEN}user name=' || role END || '{CLOSE.strip()}' || chr(10) AS header,
         row_number() OVER (PARTITION BY s.conv_id, perspective ORDER BY part, split, turn, role, text) AS place
  FROM cut s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), whole AS (SELECT *, header || text || '{END.strip()}' || chr(10) AS piece FROM lines),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY place) AS upto FROM whole)
SELECT conv_id, perspective, part, split, min(upto - length(piece))::BIGINT AS start, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(piece, '' ORDER BY place) AS rendered, sum(length(piece))::BIGINT AS n_chars,
       coalesce(string_agg((upto - length(piece) + length(header))::BIGINT || '-' || upto::BIGINT, ';' ORDER BY place) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part, split
"""
