"""The near-dedup stage's form of the SimHash operator: texts whose sets of 5-word shingles have a Jaccard similarity of at least
0.8, and what they link to.

Candidates come first from SimHash: fingerprints of the sets within a few bits, by the BK-trees of simhash.links(). At a similarity
of 0.8 two fingerprints differ in about 10 of 64 bits, which no tree can search through, so the pairs that SimHash leaves apart
come from MinHash bands. Every candidate is checked exactly, on the sets of shingle hashes. Texts with the same set are one node. A
band's nodes are first compared with the smallest of the band, so that a large family costs one comparison a member. Bands in which
some are then still apart are compared in full, in parts of bounded size: a task intersects two parts of a band and returns
which groups they link, never the pairs. So every candidate pair is either checked or already in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import simhash
from tallyforge.llm.components import components
from tallyforge.llm.shared import given_back, held, lookup, picked, stored

#: Shingle words and least similarity, as (numerator, denominator).
SHINGLE, LEAST = 5, (4, 5)
#: A pair at the least similarity shares none of the bands with probability (1 - 0.8 ** ROWS) ** BANDS, 6 in 100000.
ROWS, BANDS = 6, 32
SEED = 42
#: Shingles whose minima are taken at once, so that a long text needs no more memory.
BLOCK = 1 << 13
#: Nodes and shingles in a part of a band at most, about; shingles that are counted at once.
PART_NODES, PART_SHINGLES, COLUMNS = 1024, 2_000_000, 4096


def hashes(text: str | None, n: int = SHINGLE):
    """The set's members as sorted 64-bit hashes; a shorter text is one shingle, a text without words none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    found = {xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(max(1, len(words) - n + 1))} if words else ()
    return np.sort(np.fromiter(found, dtype="<u8", count=len(found)))


def sketch(text: str | None) -> tuple[int, int, list[int]]:
    """(hash of the set, SimHash fingerprint, keys of the bands) as signed longs; (0, 0, []) without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    h = hashes(text)
    if not len(h):
        return 0, 0, []
    factors = np.random.RandomState(SEED).randint(0, 1 << 62, ROWS * BANDS, dtype=np.int64).astype("<u8") * np.uint64(2) + np.uint64(1)
    least = np.min([(h[i : i + BLOCK, None] * factors).min(axis=0) for i in range(0, len(h), BLOCK)], axis=0)
    keys = [simhash.signed(xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    fp = simhash.majority((h[i : i + BLOCK] for i in range(0, len(h), BLOCK)), len(h))
    return simhash.signed(xxh64_intdigest(h.tobytes(), SEED)), simhash.signed(fp), keys


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, h) are alike. Many pairs may have the same b."""
    x = sets.select(F.col("node").alias("a"), F.col("h").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("h").alias("y"))
    pairs = stored(pairs.distinct(), "near-copy-pairs")
    both = lookup(pairs.join(x, "a"), y, pairs.groupBy("b").agg(F.count("*").alias("n")), "b", F.col("a"))
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("met"), (F.size("x") + F.size("y")).alias("all"))
    return stored(both.where(F.col("met") * LEAST[1] >= (F.col("all") - F.col("met")) * LEAST[0]).select("a", "b"), "near-copy-links")


def links_between(low: list, high: list) -> list[tuple[int, int]]:
    """Stars of the roots that alike sets link: low and high are parts (root, hashes) of a band; high is empty where a part meets itself."""
    import numpy as np

    both = low + high
    sizes = np.array([len(h) for _, h in both])
    _, column, times = np.unique(np.concatenate([h for _, h in both]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # only these can be in an intersection
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column, owner = place[column], np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left = slice(0, len(low))
    right = slice(len(low), None) if high else left
    met = np.zeros((len(low), len(high) or len(low)), dtype=np.float32)
    for start in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        has = np.zeros((len(both), min(COLUMNS, len(shared) - start)), dtype=np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        met += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - met
    groups = simhash.Groups()
    for i, j in zip(*np.nonzero(met * LEAST[1] >= union * LEAST[0])):
        x, y = both[i][0], both[j + (len(low) if high else 0)][0]
        if x != y:
            groups.link(x, y)
    return groups.stars()


def compared(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """apart (key, node, root): the nodes of bands -> (a, b): links between the roots of nodes that are alike and share a band.

    A large band is cut into parts by hash, and each two parts are a task; so the work, though not what is returned, grows with the
    square of a band of unlike texts.
    """
    weights = sets.select("node", F.size("h").alias("size"))
    parts = apart.join(weights, "node").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / PART_NODES), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    rows = apart.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["key", "low", "high"]
    tasks = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "root", "node").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near-copies")
        key, sides, found = None, {}, []

        def ended() -> list[tuple[int, int]]:
            low, high = (sides.get(key[1], []), sides.get(key[2], []) if key[1] < key[2] else []) if key else ([], [])
            return links_between(low, high) if low and (high or key[1] == key[2]) else []

        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            *heads, lists = batch.columns
            values, ends = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()
            for i, (*k, part, root) in enumerate(zip(*[c.to_pylist() for c in heads])):
                if k != key:
                    found += ended()
                    key, sides = k, {}
                sides.setdefault(part, []).append((root, values[ends[i - 1] if i else 0 : ends[i]].copy()))
            yield made(found)
            found = []
        yield made(ended())
        sides.clear()
        given_back()

    dealt = tasks.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "part", "root", "h")
    return stored(dealt.mapInArrow(run, "a long, b long"), "near-copy-links")


def rooted(nodes: DataFrame, found: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """nodes with the root that links lead to."""
    return nodes.join(found.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, root, component_id) for every row of docs: copy is a hash of the text, null for null, root a number of the
    row's group, and component_id the smallest doc_id that links lead to.

    Texts without words are one group. Rows without a doc_id get the id of their group, null if none in it has one. Very long texts are
    taken whole. Repeated rows are kept; other columns are not returned.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near-copies")  # drops what other stages have left
        for b in batches:
            found = [sketch(t.as_py()) for t in b.column(2)]
            made = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "copy", "node", "fp", "bands"])
        given_back()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near-copies")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes(t.as_py()).view("<i8") for t in b.column(1)], pa.list_(pa.int64()))], ["node", "h"])

    given = picked(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("copy"), "text")
    rows = stored(given.mapInArrow(sketches, "doc_id long, copy long, node long, fp long, bands array<long>"), "near-copy-sketches")
    of_node = [F.min("copy").alias("copy"), F.min("fp").alias("fp"), F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.count("*").alias("n")]
    per_node = stored(rows.groupBy("node").agg(*of_node), "near-copy-nodes")  # rows of a node have one set, so the same bands

    fps = stored(per_node.groupBy("fp").agg(F.min("node").alias("of")), "near-copy-fingerprints")
    ends = [fps.select(F.col("fp").alias(c), F.col("of").alias(f"of_{c}")) for c in "ab"]
    close = simhash.links(fps.select("fp"), fps.count()).join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    same = per_node.join(fps, "fp").where("node <> of").select(F.col("node").alias("a"), F.col("of").alias("b"))
    by_simhash = stored(close.union(same), "near-copy-simhash")

    bands = per_node.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    members = stored(bands.join(shared, "key").distinct(), "near-copy-bands")

    wanted = members.select("node").union(by_simhash.select("a")).union(by_simhash.select("b")).distinct()
    wanted = per_node.select("node", "copy").where("copy IS NOT NULL").join(wanted, "node", "left_semi")
    # the rows of a hot copy are dealt to several tasks, and each keeps one before the shuffle by node
    copies = lookup(given.select("copy", "doc_id", "text").where("copy IS NOT NULL"), wanted, rows.where("copy IS NOT NULL").groupBy("copy").agg(F.count("*").alias("n")), "copy", F.col("doc_id"))
    texts = copies.groupBy("node").agg(F.first("text").alias("text"))
    sets = stored(texts.mapInArrow(hashed, "node long, h array<long>"), "near-copy-sets")

    links = checked(by_simhash, sets)
    found = components(links)
    first = rooted(rooted(members, found), found, "least", "other").where("root <> other").select(F.col("node").alias("a"), F.col("least").alias("b"))
    links = links.union(checked(first, sets))
    apart = stored(rooted(members, components(links)), "near-copy-roots")
    open_ = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    groups = components(links.union(compared(apart.join(open_, "key").select("key", "node", "root"), sets)))

    nodes = rooted(per_node.select("node", "first"), groups)
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = nodes.join(smallest, "root").select("node", "root", "component_id")
    return lookup(rows.select("doc_id", "copy", "node"), classes, per_node.select("node", "n"), "node", F.col("doc_id")).select("doc_id", "copy", "root", "component_id")
