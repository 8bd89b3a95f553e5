"""Centroid clustering against plain rounds in Python's integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from textgraph.llm import centroids


def plain(rows, dims, clusters, rounds):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, digest)]"""
    kept = [
        (i, [int(x) * 1024 if abs(x) > 1e300 else math.floor(1024 * x) for x in v], v) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    middle = [r[1] for r in sorted(kept, key=key)[:clusters]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in middle] for _, v, _ in kept]
        return [min((d, c) for c, d in enumerate(ds)) for ds in far]

    for _ in range(rounds):
        own = assign()
        for c in range(len(middle)):
            mine = [v for (_, v, _), (_, o) in zip(kept, own) if o == c]
            if mine:
                middle[c] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    fits = lambda x: x if x is not None and x < 2**63 else None

    def total(ds):
        return sum(ds) if all(d < 2**63 for d in ds) else None

    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(
        ((i, c, fits(d), fits(total([e for e, o in own if o == c])), fits(total([e for e, _ in own])), digest[c])
         for (i, _, _), (d, c) in zip(kept, own)), key=repr)


def near_groups(seed, n, dims, scale=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, scale / 4) for x in rng.choice(middles)]) for i in range(n)]


ODD = [(None, [0.5, 0.25, -1.0]), (None, None), (900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 1.0, 1.0]), (904, []), (905, [1.0] * 4)]


@pytest.mark.parametrize("case", ["groups", "ties", "repeated", "large", "huge", "few"])
def test_rounds(spark, monkeypatch, case):
    monkeypatch.setattr(centroids, "BLOCK", 37)
    rows = near_groups(1, 400, 3)
    if case == "ties":
        rows = [(i, [float(i % 5), float(i % 3), 0.0]) for i in range(300)]
    if case == "repeated":
        rows = rows[:150] + rows[:150] + [(i, [1.0, 1.0, 1.0]) for i in range(200)]
    if case == "large":
        rows = near_groups(2, 300, 3, 1e6)
    if case == "huge":
        rows = rows[:60] + [(1000, [3e38, 0.0, 1.0]), (1001, [-1.7e308, 0.0, 1.0]), (1002, [1e16, 1e16, 0.0])]
    if case == "few":
        rows = rows[:5]
    rows = rows + ODD
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got = centroids.digests(centroids.cluster(df, dims=3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, 3, 8, 10)


def test_only_expired_gaps_are_looked_at_again(spark):
    rng = random.Random(4)
    rows = [(i, [100.0 * (i % 8) + rng.gauss(0, 0.3) for _ in range(3)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = centroids.cluster(df, dims=3)
    assert found.popped[0] == 4000 and min(found.popped[1:] or [0]) < 2000
    assert sorted((tuple(r) for r in centroids.digests(found).collect()), key=repr) == plain(rows, 3, 8, 10)


def test_empty_table(spark):
    df = spark.createDataFrame(ODD[1:], "vec_id long, embedding array<double>")
    assert centroids.digests(centroids.cluster(df, dims=3)).collect() == []
    assert centroids.digests(centroids.cluster(df.filter(F.lit(False)))).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
