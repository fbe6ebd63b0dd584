"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints that differ in at most r bits agree on at least b - r of b blocks of bits. Every choice of b - r blocks
and every value of them is a shard, so no link is lost. A shard's fingerprints hang in a BK-tree (children keyed by their Hamming
distance to the parent), and a search follows only the edges within the radius. A tree has at most SHARD_ROWS fingerprints: a
larger shard has several, each built once, serialised and shipped by a join to the shard's other parts. To broadcast all trees
would put the fingerprints of all documents on the driver; so each goes to the tasks of its own shard, and to no other. A
task returns a star for each group that it finds, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.shared import lookup, picked, stored

#: Shingle words, hash seed and radius, fixed by the contract.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in one tree at most; larger shards are cut.
SHARD_ROWS = 2000
#: Shingles whose bits are counted at once, so that a long text needs no more memory.
BLOCK = 1 << 16


def majority(hashes, n: int) -> int:
    """The number whose bits are those set in over half of n hashes (arrays of unsigned 64-bit numbers)."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in range(64) if 2 * int(ones[k]) > n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    joined, starts, ends = b" ".join(words), [0, *[e + 1 for e in ends[: n - 1]]], ends[len(words) - n :]
    blocks = range(0, n, BLOCK)
    return majority((np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], dtype="<u8") for i in blocks), n)


def signed(x: int) -> int:
    """The long with the bits of x, which is a number of 64 bits."""
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null and empty texts have fp 0; every row is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """The bits of each kind of shard. More blocks for more fingerprints, so that the mean shard stays small."""
    b = radius + 1
    while b < radius + 4 and n > SHARD_ROWS / 16 * 2.0 ** (64 * (b - radius) // b):
        b += 1
    cut = [64 * i // b for i in range(b + 1)]
    blocks = [(1 << cut[i + 1]) - (1 << cut[i]) for i in range(b)]
    return [sum(c) - (sum(c) >> 63 << 64) for c in combinations(blocks, b - radius)]


class Tree:
    """A BK-tree of 64-bit numbers, kept as lists: each number, its parent's place and its distance from the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.parents: list[int] = []
        self.distances: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, x: int, radius: int) -> Iterator[int]:
        """All that lie within the radius: a child at distance d from its parent is followed only if d is within radius of x's distance."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d, children = (x ^ self.values[at]).bit_count(), self.children[at]
            if d <= radius:
                yield self.values[at]
            for k in range(max(1, d - radius), d + radius + 1):
                if k in children:
                    todo.append(children[k])

    def add(self, x: int) -> None:
        at = 0
        while self.values and (d := (x ^ self.values[at]).bit_count()):
            if d not in self.children[at]:
                self._hang(x, at, d)
                return
            at = self.children[at][d]
        if not self.values:
            self._hang(x, -1, 0)

    def _hang(self, x: int, parent: int, d: int) -> None:
        if parent >= 0:
            self.children[parent][d] = len(self.values)
        self.values.append(x)
        self.parents.append(parent)
        self.distances.append(d)
        self.children.append({})

    def pack(self) -> bytes:
        import numpy as np

        return np.array(self.values, "<u8").tobytes() + np.array(self.parents, "<i4").tobytes() + np.array(self.distances, "u1").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        import numpy as np

        n, tree = len(data) // 13, cls()
        parts = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<i4", n, 8 * n), np.frombuffer(data, "u1", n, 12 * n)
        for x, parent, d in zip(*[p.tolist() for p in parts]):
            tree._hang(x, parent, d)
        return tree


class Groups:
    """Sets of linked numbers, each known by its smallest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = sorted((self.top(x), self.top(y)))
        self.parent[b] = a

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.top(x)) != x]


MASK = (1 << 64) - 1


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """nodes (fp), n all different -> (a, b): enough of the links within the radius to connect all that are connected.

    Shards of more than SHARD_ROWS fingerprints are cut into parts by hash; a part's tree is searched by its own fingerprints as it grows,
    and by those of the shard's later parts once it is shipped to them. In a large shard the number of searches grows with the
    square of its parts: the shards are cut finer as n grows so that this stays rare.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(shard_masks(n, radius))])
    shards = nodes.select("fp", F.explode(masks).alias("s")).select("fp", "s.kind", "s.value")
    several = shards.groupBy("kind", "value").count().where("count > 1").select("kind", "value", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("parts"))
    cut = shards.join(several, ["kind", "value"]).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    keys = ["kind", "value", "part"]
    rows = cut.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "parts", "fp")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, groups = None, Tree(), Groups()

        def ended() -> list[tuple]:
            if key is None:
                return []
            trees = [(*key, tree.pack(), None, None)] if key[3] > 1 else []
            return trees + [(*key, None, a, b) for a, b in groups.stars()]

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["kind", "value", "part", "parts", "tree", "a", "b"])

        for batch in batches:
            out = []
            for *k, fp in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    out += ended()
                    key, tree, groups = k, Tree(), Groups()
                for y in tree.near(fp & MASK, radius):
                    groups.link(fp, signed(y))
                tree.add(fp & MASK)
            yield made(out)
        yield made(ended())

    grown = stored(rows.mapInArrow(grow, "kind int, value long, part int, parts int, tree binary, a long, b long"), "bk-trees")
    trees = grown.where("tree IS NOT NULL").select("kind", "value", "part", "tree")
    others = trees.select("kind", "value", F.col("part").alias("other"), F.col("tree").alias("searchers"))
    pairs = trees.join(others, ["kind", "value"]).where("part < other").select("tree", "searchers")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                tree, other = Tree.unpack(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()
                groups = Groups()
                for x in np.frombuffer(other, "<u8", len(other) // 13).tolist():
                    for y in tree.near(x, radius):
                        groups.link(signed(x), signed(y))
                found = groups.stars()
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    crossing = pairs.repartition(F.xxhash64("tree", "searchers")).mapInArrow(search, "a long, b long")
    return grown.where("tree IS NULL").select("a", "b").union(crossing)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id that links lead to.

    Null and empty texts have fingerprint 0 and link like any other. Rows without a doc_id get the id of their group, null
    if none in it has one. Very long texts are hashed whole, in blocks. Repeated rows are kept. Other columns of docs, whatever
    their names, are not returned.
    """
    rows = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprint-nodes")
    found = components(links(nodes.select("fp"), nodes.count(), radius))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return lookup(rows, classes, nodes.select("fp", "n"), "fp", F.col("doc_id")).select("doc_id", "fp", "component_id")
