"""A Merkle manifest of a dataset: a leaf for each row, a tree for each language, one root above them, and a witness for each row.

Rows are appended in order to aligned blocks of 2^levels leaves. A block is built by appending: a leaf's witness is empty at first, and each
time that the sibling of a subtree is complete, the witnesses of all leaves under both grow by the other's digest. Block roots are appended in
turn to blocks of the next level, so a task holds one block, whatever the size of a tree; a row's witness is that of its block's leaf
followed by that of the block. extend() appends later rows: it opens the last block of each tree alone.

Nulls in any column are written as `-`; rows of equal doc_id ascend by leaf, null ids come first; equal rows are leaves of their own. An
empty table has no rows and no root. Very long texts are hashed by Spark and never moved. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import picked, stored

#: A block has 2^LEVELS leaves.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: In a witness: the sibling stands on the left, on the right; an empty entry is a node without one.
LEFT, RIGHT = "<", ">"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its witness give."""
    for x in path:
        leaf = digest(x[1:], leaf) if x[:1] == LEFT else digest(leaf, x[1:])
    return leaf


class Appender:
    """A tree that grows leaf by leaf. open[k] is the complete subtree of 2^k leaves that waits for its sibling, as (digest, first leaf, end)."""

    def __init__(self) -> None:
        self.open: list[tuple | None] = []
        self.paths: list[list[str]] = []

    def append(self, leaf: str) -> None:
        n = len(self.paths)
        self.paths.append([])
        node, level = (leaf, n, n + 1), 0
        while level < len(self.open) and self.open[level]:
            node, self.open[level] = self._joined(self.open[level], node), None
            level += 1
        self.open += [None] * (level + 1 - len(self.open))
        self.open[level] = node

    def _joined(self, left: tuple, right: tuple | None) -> tuple:
        """The parent; the witnesses of all leaves below it grow by one entry."""
        for (_, start, end), entry in ((left, RIGHT + right[0] if right else ""), *([(right, LEFT + left[0])] if right else [])):
            for path in self.paths[start:end]:
                path.append(entry)
        return (digest(left[0], right[0]), left[1], right[2]) if right else (digest(left[0]), left[1], left[2])

    def root(self) -> str:
        """Closes the tree: what still waits for a sibling is joined with what has come after it, or stands alone."""
        last = None
        for node in self.open[:-1]:
            last = self._joined(node or last, last if node else None) if node or last else None
        return self._joined(self.open[-1], last)[0] if last else self.open[-1][0]


def _height(n: int) -> int:
    return (n - 1).bit_length()


# --- leaves ------------------------------------------------------------------------------------------------------------


def _leaf(n_chars: Column) -> Column:
    """The digest of a row's fields, as bytes."""
    parts = []
    for name in FIELDS:
        x = (n_chars if name == "n_chars" else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves_of(docs: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """(tree, ix, doc_id, leaf, tampered): the leaves of each language in order, numbered from 0, or from the numbers of after (tree, n).

    tampered is the leaf of the row with n_chars + 1, for a seventh of the ids and null for the others. Rows are read once; what is dealt
    to ranges of the order, sorted and numbered by partition is the digests alone. A stored row number parts equal rows, so that a range
    may end between them.
    """
    rows = picked(docs, **{f: f for f in FIELDS}).withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})
    marked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    made = rows.select(tree.alias("tree"), "doc_id", _leaf(F.col("n_chars")).alias("leaf"), F.when(marked, _leaf(F.col("n_chars") + 1)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"))
    out = numbered_rows(stored(made, "leaves"), ["tree", "doc_id", "leaf", "row"])
    if after is not None:
        out = out.join(after, "tree", "left").withColumn("ix", F.col("ix") + F.coalesce("n", F.lit(0)))
    return out.select("tree", "ix", "doc_id", "leaf", "tampered")


def numbered_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ix, the place from 0 of each row among those of its tree in the order, which begins with tree and is total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each tree and range
    starts = starts.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return ranged.join(starts, ["tree", "_part"]).withColumn("ix", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


# --- blocks ------------------------------------------------------------------------------------------------------------


def _built(ix: list[int], hashes: list[bytes]) -> tuple[Appender, list[int]]:
    """The tree of a block's nodes, and where each of them stands among the rows given."""
    order = sorted(range(len(ix)), key=ix.__getitem__)
    tree = Appender()
    for i in order:
        tree.append(hashes[i].hex())
    return tree, order


def roots_of(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, ix, hash) -> (tree, ix, hash, n): each block's root, of its own height, and number of nodes."""

    def run(table: pa.Table) -> pa.Table:
        ix = table.column("ix").to_pylist()
        tree, _ = _built(ix, table.column("hash").to_pylist())
        return pa.table({"tree": table.column("tree")[:1], "ix": [ix[0] >> levels], "hash": [bytes.fromhex(tree.root())], "n": [len(ix)]})

    return nodes.select("tree", "ix", "hash", F.shiftright("ix", levels).alias("block")).groupBy("tree", "block").applyInArrow(run, "tree string, ix long, hash binary, n long")


def above(roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """roots (tree, ix, hash, n) -> (tree, ix, path, top): the witness of each block from its root up, and the root of its tree.

    In a tree of several blocks the last may be lower than the others; it is lifted first, which its witness begins with.
    """
    sizes = roots.groupBy("tree").agg(F.count("*").alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    if most <= 1:
        return roots.select("tree", "ix", F.array().cast("array<string>").alias("path"), F.lower(F.hex("hash")).alias("top"))

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, steps = [], []
            for h, n, blocks in zip(*(b.column(c).to_pylist() for c in ("hash", "n", "blocks"))):
                step = levels - _height(n) if blocks > 1 else 0
                hashes.append(bytes.fromhex(folded(h.hex(), [""] * step)))
                steps.append(step)
            yield pa.RecordBatch.from_pydict({"tree": b.column("tree"), "ix": b.column("ix"), "hash": pa.array(hashes, pa.binary()), "lifted": pa.array(steps, pa.int32())})

    nodes = stored(roots.join(sizes, "tree").select("tree", "ix", "hash", "n", "blocks").mapInArrow(lift, "tree string, ix long, hash binary, lifted int"), "nodes")
    upper = above(stored(roots_of(nodes, levels), "roots"), levels)

    def run(own: pa.Table, up: pa.Table) -> pa.Table:
        ix, lifted = own.column("ix").to_pylist(), own.column("lifted").to_pylist()
        tree, order = _built(ix, own.column("hash").to_pylist())
        tree.root()
        rest = up.column("path").to_pylist()[0]
        return pa.table({"tree": own.column("tree"), "ix": own.column("ix"), "path": pa.array(_back(order, [[""] * lifted[i] + tree.paths[k] + rest for k, i in enumerate(order)]),
            pa.list_(pa.string())), "top": pa.array(up.column("top").to_pylist() * len(ix), pa.string())})

    return _with_upper(nodes, upper, levels).applyInArrow(run, "tree string, ix long, path array<string>, top string")


def _back(order: list[int], values: list) -> list:
    """values, which are in the order, at the places of the rows."""
    out = [None] * len(order)
    for i, v in zip(order, values):
        out[i] = v
    return out


def _with_upper(nodes: DataFrame, upper: DataFrame, levels: int):
    """Each block's nodes beside the one row of the block."""
    return nodes.withColumn("block", F.shiftright("ix", levels)).groupBy("tree", "block").cogroup(upper.withColumnRenamed("ix", "block").groupBy("tree", "block"))


# --- manifests ---------------------------------------------------------------------------------------------------------


def build(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(leaves, roots of their blocks), both stored: what manifest() and extend() take."""
    leaves = stored(leaves_of(docs), "leaves")
    return leaves, stored(roots_of(leaves.withColumnRenamed("leaf", "hash"), levels), "roots")


def extend(leaves: DataFrame, roots: DataFrame, docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The leaves and roots with docs appended after each tree's leaves. Only blocks that are not full are built again, with the new rows.

    docs have to come later in the order than all rows of their language before; the caller sees to that.
    """
    counts = roots.groupBy("tree").agg(F.sum("n").alias("n"))
    new = stored(leaves_of(docs, counts), "leaves")
    full = F.col("n") == 1 << levels
    opened = roots.where(~full).select("tree", F.col("ix").alias("block"))  # one a tree at most
    again = leaves.withColumn("block", F.shiftright("ix", levels)).join(opened, ["tree", "block"], "left_semi").drop("block")
    changed = again.unionByName(new)
    return leaves.unionByName(new), stored(roots.where(full).unionByName(roots_of(changed.withColumnRenamed("leaf", "hash"), levels)), "roots")


def manifest(leaves: DataFrame, roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row a leaf.

    The subroots, in the order of their languages, are the leaves of one more tree; nothing but counts reaches the driver.
    """
    upper = stored(above(roots, levels), "upper")
    tops = upper.where("ix = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("top").alias("hash"))
    tops = stored(numbered_rows(tops, ["tree", "name"]), "tops")
    over = above(stored(roots_of(tops, levels), "roots"), levels)

    def name(own: pa.Table, up: pa.Table) -> pa.Table:
        tree, order = _built(own.column("ix").to_pylist(), own.column("hash").to_pylist())
        tree.root()
        rest = up.column("path").to_pylist()[0]
        return pa.table({"tree": own.column("name"), "rest": pa.array(_back(order, [p + rest for p in tree.paths]), pa.list_(pa.string())), "root": pa.array(up.column("top").to_pylist() * len(order), pa.string())})

    langs = _with_upper(tops, over, levels).applyInArrow(name, "tree string, rest array<string>, root string")
    upper = upper.join(langs, "tree").select("tree", "ix", F.concat("path", "rest").alias("path"), F.col("top").alias("subroot"), "root")

    def run(own: pa.Table, up: pa.Table) -> pa.Table:
        hashes, tampered = own.column("leaf").to_pylist(), own.column("tampered").to_pylist()
        tree, order = _built(own.column("ix").to_pylist(), hashes)
        tree.root()
        rest, subroot, root = (up.column(c).to_pylist()[0] for c in ("path", "subroot", "root"))
        proofs, ends = [], []
        for k, i in enumerate(order):
            path = tree.paths[k] + rest
            proofs.append(digest(*[x[1:] for x in path]))
            ends.append(folded((tampered[i] or hashes[i]).hex(), path))
        proofs, ends = _back(order, proofs), _back(order, ends)
        return pa.table({"doc_id": own.column("doc_id"), "leaf": [h.hex() for h in hashes], "subroot": [subroot] * len(order), "root": [root] * len(order), "proof_sha256": proofs,
            "folded_root": ends, "verified": [e == root for e in ends]})

    return _with_upper(leaves, upper, levels).applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS STRING)) + 1), lambda i: ascii(CAST(doc_id AS STRING)[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
_FIELD = "coalesce(strlen(CAST({0} AS STRING)) || ':' || CAST({0} AS STRING), '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)

#: Levels by recursion, then each row's witness as the siblings of its ancestors, and each row's fold along it.
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT *, sha256({_LEAF}) AS leaf, CASE WHEN {CRC} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix FROM docs),
low AS (
  SELECT lang, 0 AS level, ix, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, level + 1, ix // 2, sha256(string_agg(h, '' ORDER BY ix)), (max(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, level, ix // 2
), tops AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS ix, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, ix, subroot AS h, n FROM tops
  UNION ALL SELECT level + 1, ix // 2, sha256(string_agg(h, '' ORDER BY ix)), (max(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, ix // 2
), spine AS (
  SELECT d.doc_id, d.lang, d.ix, d.leaf, d.tampered, t.subroot, t.ix AS tix, t.height, r.h AS root, r.level AS above FROM leaves d JOIN tops t ON d.lang IS NOT DISTINCT FROM t.lang CROSS JOIN (SELECT * FROM high WHERE n = 1) r
), steps AS (
  SELECT s.*, level, CASE WHEN level < height THEN (ix >> level) ELSE (tix >> (level - height)) END AS node FROM (SELECT *, unnest(range(height + above)) AS level FROM spine) s
), path AS (
  SELECT s.*, coalesce(l.h, g.h) AS sibling FROM steps s LEFT JOIN low l ON s.level < height AND l.lang IS NOT DISTINCT FROM s.lang AND l.level = s.level AND l.ix = xor(node, 1)
  LEFT JOIN high g ON s.level >= height AND g.level = s.level - height AND g.ix = xor(node, 1)
), proofs AS (
  SELECT lang, ix, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(tampered) AS tampered, any_value(subroot) AS subroot, any_value(root) AS root, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256,
    list(coalesce(sibling, '') ORDER BY level) AS siblings, list(node ORDER BY level) AS nodes FROM path GROUP BY lang, ix
), fold AS (
  SELECT lang, ix, 1 AS pos, coalesce(tampered, leaf) AS h FROM proofs
  UNION ALL SELECT f.lang, f.ix, pos + 1, sha256(CASE WHEN nodes[pos] % 2 = 1 THEN siblings[pos] || h ELSE h || siblings[pos] END) FROM fold f JOIN proofs p ON p.ix = f.ix AND p.lang IS NOT DISTINCT FROM f.lang WHERE pos <= len(siblings)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM proofs p JOIN fold f ON p.ix = f.ix AND p.lang IS NOT DISTINCT FROM f.lang AND pos = len(siblings) + 1
"""
