"""k-means on integer vectors, exact to the last digit, with Ptolemy's inequality in place of most distances.

For any vector x, centroid c and pivots p, q: d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|. Distances to the pivots are stored beside each
vector once; a round computes those of the centroids, and the largest bound over fixed pairs rules a centroid out where it is above
the distance to a centroid already checked. Bounds are lowered by more than any rounding could have raised them, and what they leave is
checked in whole numbers, so results are those of checking everything. The pivots are where k-means comes to rest on at most SAMPLE vectors, in
a ring of pairs.

Vectors of another length, with a null or non-finite component, or null, are left out. Null ids stay and come last in the order of first
centroids; repeated ids and vectors are rows of their own. With fewer than k vectors each is a centroid; an empty table has no rows. A
component of 2^27 or more after scaling is an error, since squared distances would not fit a long. Other columns are not read.

Vectors are never shuffled: a round reads the stored table and returns k x dims sums, which are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import picked, stored

K, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
#: Vectors at most from which the pivots are found; they change no result.
SAMPLE = 4096
#: Share by which bounds are lowered; a bound is off by less than 10 roundings of 2^-53.
MARGIN = 1e-12
LARGEST = 1 << 27


def _first(vectors: DataFrame, salt: str, n: int) -> list[list[int]]:
    """The n vectors with the smallest digest of the salt and their id; null ids last."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.orderBy(digest.asc_nulls_last(), "v").limit(n).collect()]


def distance(a: list[int], b: list[int]) -> float:
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def _pivots(sample: list[list[int]], centroids: list[list[int]]) -> list[list[int]]:
    """Where the centroids come to lie in the sample: a bound is close to the distance for a pivot close to the centroid. Any points would
    give the same results."""
    if not centroids:
        return []
    v = np.array(sample, dtype=np.int64)
    for _ in range(ROUNDS):
        cluster, _, _ = Assigner(centroids, []).nearest(v, np.zeros((len(v), 0)))
        centroids = [(v[cluster == c].sum(axis=0) // max(1, (cluster == c).sum())).tolist() if (cluster == c).any() else old for c, old in enumerate(centroids)]
    return [list(c) for c in dict.fromkeys(map(tuple, centroids))]


class Assigner:
    """Nearest centroids of many vectors at once. cached: distances to the pivots, a row for each vector."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]) -> None:
        self.centroids = np.array(centroids, dtype=np.int64).reshape(len(centroids), -1)
        ring = [(i, (i + 1) % len(pivots)) for i in range(len(pivots))][: None if len(pivots) > 2 else len(pivots) - 1]
        self.pairs = [(i, j, distance(pivots[i], pivots[j]), *(np.array([distance(c, pivots[k]) for c in centroids]) for k in (i, j))) for i, j in ring]

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Squared distances that no exact one is below, to each centroid."""
        least = np.zeros((len(cached), len(self.centroids)))
        for i, j, apart, to_i, to_j in self.pairs:
            a, b = cached[:, i, None] * to_j, cached[:, j, None] * to_i
            np.maximum(least, (np.abs(a - b) - MARGIN * (a + b)) / apart, out=least)
        return least * least * (1 - 3 * MARGIN)

    def nearest(self, v: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, the smaller number where distances tie, and how many distances were computed."""
        least = self.bounds(cached)
        cluster = first = least.argmin(axis=1)
        best = ((v - self.centroids[first]) ** 2).sum(axis=1)
        checked = len(v)
        cluster = cluster.copy()
        for c in range(len(self.centroids)):
            rows = np.nonzero((least[:, c] <= best) & (first != c))[0]
            checked += len(rows)
            d = ((v[rows] - self.centroids[c]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | (d == best[rows]) & (c < cluster[rows])
            best[rows[nearer]], cluster[rows[nearer]] = d[nearer], c
        return cluster, best, checked


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), width)


def prepared(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vectors (vec_id, v, cached), pivots): whole-number vectors with their distances to the pivots, stored once."""
    x = F.col("x")
    fits = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    vectors = picked(df, vec_id=vec_id, x=embedding).where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    pivots = _pivots(_first(vectors, "pivot:", SAMPLE), _first(vectors, "3:", k))

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), np.int64, dims)
            if len(v) and max(v.max(), -v.min()) >= LARGEST:
                raise ValueError(f"a component is {LARGEST // scale} or more: squared distances do not fit a long")
            far = np.stack([np.sqrt(((v - np.array(p)) ** 2).sum(axis=1).astype(float)) for p in pivots], axis=1) if pivots else np.zeros((len(v), 0))
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": pa.array(list(v.astype(np.int32)), pa.list_(pa.int32())), "cached": pa.array(list(far), pa.list_(pa.float64()))})

    return stored(vectors.mapInArrow(cache, "vec_id long, v array<int>, cached array<double>"), "vectors"), pivots


def _over(vectors: DataFrame, with_them: Assigner, dims: int, n_pivots: int, schema: str, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), np.int64, dims)
            yield make(b, v, *with_them.nearest(v, _matrix(b.column("cached"), np.float64, n_pivots)))

    return vectors.mapInArrow(run, schema)


def rounds(vectors: DataFrame, pivots: list[list[int]], k: int = K, n: int = ROUNDS, dims: int = DIMS) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The centroids after n rounds, and of each round that was needed the distances computed and those that checking all takes.

    A round that changes nothing ends it: those after it would change nothing either.
    """
    centroids, work = _first(vectors, "3:", k), []

    def sums(b: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, best: np.ndarray, checked: int) -> pa.RecordBatch:
        members = [v[cluster == c] for c in range(len(centroids))]
        return pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(centroids)), pa.int32()), "n": pa.array([len(m) for m in members], pa.int64()),
            "checked": pa.array([checked, *[0] * (len(centroids) - 1)], pa.int64()), "sums": pa.array([m.sum(axis=0) for m in members], pa.list_(pa.int64()))})

    while len(work) < n and centroids:
        parts = _over(vectors, Assigner(centroids, pivots), dims, len(pivots), "cluster int, n long, checked long, sums array<long>", sums)
        each = parts.select("cluster", "n", "checked", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("checked").alias("checked"),
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k x dims rows
        found = {(r.cluster, r.at): r for r in each}
        moved = [[int(found[c, i].s) // found[c, i].n for i in range(dims)] if found[c, 0].n else old for c, old in enumerate(centroids)]
        work.append((sum(found[c, 0].checked for c in range(len(centroids))), sum(found[c, 0].n for c in range(len(centroids))) * len(centroids)))
        if moved == centroids:
            break
        centroids = moved
    return centroids, work


def clustered(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, n: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each vector that fits."""
    vectors, pivots = prepared(df, vec_id, embedding, k, dims, scale)
    centroids, _ = rounds(vectors, pivots, k, n, dims)

    def rows(b: pa.RecordBatch, v: np.ndarray, cluster: np.ndarray, best: np.ndarray, checked: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(best, pa.int64())})

    own = "vec_id long, cluster int, distance long"
    placed = _over(vectors, Assigner(centroids, pivots), dims, len(pivots), own, rows) if centroids else vectors.sparkSession.createDataFrame([], own)
    placed = stored(placed, "clusters")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    facts = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    table = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _round(i: int, step: str) -> str:
    """Assignment to the centroids of round i, or their means as the centroids of the next."""
    if step == "assign":
        d = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
        return f"a{i} AS MATERIALIZED (SELECT rid, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT rid, c.cluster, {d} AS d FROM kept k CROSS JOIN c{i} c) GROUP BY rid)"
    sums = f"SELECT cluster, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{i - 1} JOIN kept USING (rid)) GROUP BY cluster, p"
    return f"c{i} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i - 1} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM ({sums}) GROUP BY cluster) m ON m.cluster = c.cluster)"


ORACLE = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS STRING)), v) - 1 AS cluster, v FROM kept ORDER BY 1 LIMIT 8),
{", ".join(_round(i, s) for i in range(ROUNDS + 1) for s in (("means", "assign") if i else ("assign",)))}
SELECT vec_id, a.cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rid) JOIN c{ROUNDS} c ON c.cluster = a.cluster
"""
