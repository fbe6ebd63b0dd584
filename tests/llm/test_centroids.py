import hashlib
import math
import random

import numpy as np
import pytest

from tallyforge.llm import centroids as C


def slow(rows, k=8, n=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else digest(r[0]), r[1]))[:k]
    at = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(n):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    found = [(i, *nearest(v)) for i, v in kept]
    of = lambda j: sum(d for _, d, c in found if c == j)
    return sorted(str((i, j, d, of(j), sum(x[1] for x in found), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest())) for i, d, j in found)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 AS cluster", "'x' AS v", "1 AS distance")


def answer(df):
    return sorted(str(tuple(r)) for r in df.collect())


def blobs(n, spread, seed=1):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(8)]
    return [(i, [x + r.gauss(0, spread) for x in middles[i % 8]]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [0.1] * 63), (903, [None] + [0.1] * 63), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (None, [-0.25] * 64), (7, [0.25] * 64), (7, [0.25] * 64)]


@pytest.mark.parametrize("rows", [blobs(60, 0.05) + ODD, [(i, [float(i % 2)] * 64) for i in range(40)], [(1, [0.0] * 64)] * 20, blobs(5, 0.1), [(i, [0.0] * 63 + [i / 1024]) for i in range(30)], ODD[:6]],
    ids=["blobs and odd rows", "ties", "one vector repeated", "fewer than k", "on a line", "none that fits"])
def test_equals_checking_everything(spark, rows):
    assert answer(C.clustered(frame(spark, rows))) == slow(rows)


def test_bounds_are_never_above_the_distance():
    r = np.random.default_rng(3)
    for scale in (3, 1000, 2**26):
        v, centroids, pivots = (r.integers(-scale, scale, (n, 64)) for n in (500, 8, 5))
        pivots[0], centroids[1], centroids[2] = centroids[0], v[0], v[1]
        a = C.Assigner(centroids.tolist(), pivots.tolist())
        cached = np.array([[C.distance(x, p) for p in pivots.tolist()] for x in v.tolist()])
        least = a.bounds(cached)
        exact = [[sum((x - y) ** 2 for x, y in zip(a, b)) for b in centroids.tolist()] for a in v.tolist()]
        assert all(l <= d for ls, ds in zip(least.tolist(), exact) for l, d in zip(ls, ds))  # noqa: E741
        cluster, best, checked = a.nearest(v, cached)
        assert [min((d, j) for j, d in enumerate(ds)) for ds in exact] == list(zip(best.tolist(), cluster.tolist())) and checked <= 4000


def test_most_distances_are_ruled_out_where_clusters_are_apart(spark):
    vectors, pivots = C.prepared(frame(spark, blobs(400, 0.02)))
    _, work = C.rounds(vectors, pivots)
    assert sum(w[0] for w in work) < 0.6 * sum(w[1] for w in work)


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        C.clustered(frame(spark, [(1, [1e30] * 64)])).collect()


def test_whole_table_at_any_partitioning(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert answer(C.clustered(table)) == answer(C.clustered(table.repartition(7))) == slow([(r.vec_id, list(r.embedding)) for r in table.collect()])
