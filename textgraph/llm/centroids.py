"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds, exact on integers.

Vectors stand in blocks of rows, dealt once by block number and kept that way. A
block has a heap per cluster. A vector enters the heap of its cluster with its gap,
the distance to the second nearest centroid less that to its own, plus the drift
that the cluster has accumulated so far: how far its centroid moved, and the
farthest of the others. Once the accumulated drift reaches the key, the gap has
expired, the vector is popped and compared with all centroids again, and enters
the heap of its cluster anew. All other vectors keep theirs without a look at them:
a round reads the heap tops, and the vectors of blocks with an expired top.

Centroids, counts and drifts (clusters x components integers) are on the driver
and travel with the tasks. Sums of vectors are kept exactly: a round adds what
popped vectors took from one cluster to another, in limbs of 30 bits, so no sum
overflows. Bounds are integers rounded to the safe side, in sixteenths of a unit;
an equal gap counts as expired, since ties go to the smaller number.

The state of a round (heaps and moved sums, about 12 bytes a vector) is written to
the shared folder. Lost blocks are dealt again from their written table.

Defined results: vectors that are null, have another number of components, or a
null or non-finite one, take no part. With fewer vectors than clusters each is a
start. Starts go by the hash of their id; a null id comes last, ties by components.
Rows repeated with one id are rows of their own. An empty cluster keeps its centroid
and stands in no row. A distance or a sum of distances that does not fit
a long is null. An empty table gives no rows. Columns beside id and vector are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from textgraph.llm.common import shards
from textgraph.session import run_folder, stage

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK = 4096  # rows
FINE = 16  # parts of a unit that bounds are counted in
LIMB = 30
LONG = 2**63
NEVER, EXPIRED = 2**62, -(2**62)  # keys and drifts stop there, to the safe side

_BLOCK = "block long, n int, kind string, ids array<long>, vectors binary"
_BLOCKS = pa.schema([
    ("block", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
])
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
_HEAP = "block long, tops array<long>, keys array<binary>, rows array<binary>, popped long, moved array<struct<cluster int, place int, limb int, value long>>"
_HEAPS = pa.schema([
    ("block", pa.int64()), ("tops", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())), ("rows", pa.list_(pa.binary())),
    ("popped", pa.int64()), ("moved", _MOVED),
])


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite x."""
    scaled = scale * x
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale


def _packed(vectors: list[list[float]], scale: int) -> tuple[str, bytes]:
    """Rows of integers in the narrowest form that holds them: a numpy type, or decimal text."""
    scaled = scale * np.array(vectors, np.float64)
    if np.isfinite(scaled).all() and (most := np.abs(scaled).max(initial=0)) < 2.0**62:
        kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most + 1 < 2.0**bits)
        return kind, np.floor(scaled).astype(kind).tobytes()
    return "text", " ".join(str(whole(x, scale)) for v in vectors for x in v).encode()


def _rows(kind: str, data: bytes, n: int) -> np.ndarray:
    """int64, or Python integers where those do not fit."""
    flat = np.array([int(t) for t in data.split()], object) if kind == "text" else np.frombuffer(data, kind).astype(np.int64)
    return flat.reshape(n, -1)


def _blocks(scale: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list[list[float]] = []
        made = 0

        def block() -> pa.RecordBatch:
            kind, data = _packed(vectors, scale)
            number = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_pylist([{"block": number, "n": len(ids), "kind": kind, "ids": ids, "vectors": data}], _BLOCKS)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(vec_id)
                vectors.append(vector)
                if len(ids) == size:
                    yield block()
                    made, ids, vectors = made + 1, [], []
        if ids:
            yield block()

    return run


def squared(rows: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances, rows x centroids: in doubles or longs where all sums are exact there, else in Python's integers."""
    reach = max((abs(x) for c in centroids for x in c), default=0)
    reach += int(np.abs(rows).max(initial=0)) if rows.size else 0
    total = reach * reach * rows.shape[1]
    if total < 2**51:  # |v|^2 - 2 v.c + |c|^2 stays under 2^53
        v, c = rows.astype(np.float64), np.array(centroids, np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if total < LONG else object
    v, c = rows.astype(kind), np.array(centroids, dtype=kind)
    return np.stack([((v - one) ** 2).sum(1) for one in c], axis=1)


def _floor_root(d: np.ndarray) -> np.ndarray:
    """An integer at most FINE * sqrt(d), and at least that less 2."""
    if d.dtype == object:
        return np.array([math.isqrt(FINE * FINE * int(x)) for x in d], object)
    return np.maximum(np.floor(FINE * np.sqrt(d.astype(np.float64))).astype(np.int64) - 1, 0)


def ceil_root(d: int) -> int:
    """An integer at least FINE * sqrt(d); 0 for 0."""
    return math.isqrt(FINE * FINE * d - 1) + 1 if d else 0


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster, and its gap: a lower bound of the second distance less an upper one of the first."""
    d = squared(rows, centroids)
    best = np.argmin(d, axis=1)
    if len(centroids) == 1:
        return best, np.full(len(rows), NEVER, np.int64)
    at = np.arange(len(rows))
    own = d[at, best].copy()
    rest = d.copy()
    rest[at, best] = d.max() + 1
    gap = _floor_root(rest.min(axis=1)) - (_floor_root(own) + 3)
    return best, gap if gap.dtype != object else np.array([min(max(int(g), EXPIRED), NEVER) for g in gap], np.int64)


def _limbs(cluster: int, place: int, value: int) -> Iterator[dict]:
    sign, value, limb = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield {"cluster": cluster, "place": place, "limb": limb, "value": sign * (value & ((1 << LIMB) - 1))}
        value, limb = value >> LIMB, limb + 1


def _sums(rows: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if rows.dtype != object and int(np.abs(rows).max(initial=0)) < 2**31:  # fewer than 2^32 rows
        return rows.sum(0).tolist()
    return [int(s) for s in rows.astype(object).sum(0)] if len(rows) else [0] * rows.shape[1]


@dataclass
class Round:
    """What the tasks of a round know: centroids, and the drift each cluster has accumulated."""

    centroids: list[list[int]]
    drifted: list[int]


def _popped(heap: list[tuple[int, int]], drifted: int) -> list[int]:
    out = []
    while heap and heap[0][0] <= drifted:
        out.append(heapq.heappop(heap)[1])
    return out


def _rescan(now: Round):
    """Pop what has expired, compare it with all centroids, push it to the heap of its cluster."""
    k = len(now.centroids)

    def heaps(block: dict) -> list[list[tuple[int, int]]]:
        if block.get("keys") is None:  # the first round: all vectors have to be looked at
            return []
        return [
            list(zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(rows, np.int32).tolist()))
            for keys, rows in zip(block["keys"], block["rows"])
        ]

    def one(block: dict) -> dict:
        held = heaps(block)
        out = [_popped(heap, now.drifted[c]) for c, heap in enumerate(held)] or [list(range(block["n"]))]
        old = np.repeat(np.arange(len(out)), list(map(len, out))) if held else np.full(block["n"], -1)
        at = np.array([row for rows in out for row in rows], np.int64)
        vectors = _rows(block["kind"], block["vectors"], block["n"])[at]
        held = held or [[] for _ in range(k)]
        cluster, gap = nearest(vectors, now.centroids) if len(at) else (at, at)
        for c, g, row in zip(cluster.tolist(), gap.tolist(), at.tolist()):
            heapq.heappush(held[c], (min(g + now.drifted[c], NEVER), row))
        moved = []
        changed = cluster != old
        for c in range(k):
            came, went = changed & (cluster == c), changed & (old == c)
            if came.any() or went.any():
                moved += _limbs(c, 0, int(came.sum()) - int(went.sum()))
                for place, (a, b) in enumerate(zip(_sums(vectors[came]), _sums(vectors[went])), 1):
                    moved += _limbs(c, place, a - b)
        return {
            "block": block["block"], "tops": [h[0][0] if h else NEVER for h in held],
            "keys": [np.array([e[0] for e in h], np.int64).tobytes() for h in held],
            "rows": [np.array([e[1] for e in h], np.int32).tobytes() for h in held],
            "popped": len(at), "moved": moved,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([one(batch.slice(n, 1).to_pylist()[0])], _HEAPS)

    return run


_OUT = "vec_id long, cluster int, distance long"
_OUTS = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _distances(centroids: list[list[int]]):
    """Every vector with the cluster whose heap it is in and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block = batch.slice(n, 1).to_pylist()[0]
                vectors = _rows(block["kind"], block["vectors"], block["n"])
                cluster, distance = np.zeros(block["n"], np.int32), [0] * block["n"]
                for c, rows in enumerate(block["rows"]):
                    at = np.frombuffer(rows, np.int32)
                    cluster[at] = c
                    for row, d in zip(at.tolist(), squared(vectors[at], [centroids[c]])[:, 0].tolist() if len(at) else []):
                        distance[row] = d if d < LONG else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["ids"], pa.int64()), pa.array(cluster), pa.array(distance, pa.int64())], schema=_OUTS)

    return run


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    good = F.col("embedding").isNotNull() & (F.size("embedding") == dims) & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def starts(usable: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, as integers."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = usable.orderBy(order.asc_nulls_last(), "embedding").limit(clusters).collect()
    return [[whole(x, scale) for x in row["embedding"]] for row in first]


@dataclass
class Clusters:
    """Centroids by number, and a written table ``vec_id, cluster, distance``."""

    centroids: list[list[int]]
    members: DataFrame
    popped: list[int]  # vectors that were compared with all centroids, by assignment


def _applied(moves: DataFrame, counts: list[int], sums: list[list[int]]) -> None:
    """Add what moved to counts and sums: at most clusters x (components + 1) numbers of a few limbs."""
    one = moves.select(F.explode("moved").alias("m")).select("m.*")
    for row in one.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():
        value = row["value"] << (LIMB * row["limb"]) if row["value"] >= 0 else -(-row["value"] << (LIMB * row["limb"]))
        if row["place"]:
            sums[row["cluster"]][row["place"] - 1] += value
        else:
            counts[row["cluster"]] += value


def _expired(drifted: list[int]) -> Column:
    tops = F.array(*(F.lit(d).cast("long") for d in drifted))
    return F.exists(F.zip_with("tops", tops, lambda top, d: top <= d), lambda e: e)


def cluster(
    vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> Clusters:
    """``rounds`` times assign and move the centroids, then assign once more; vectors are rows of ``vec_id, embedding``."""
    spark = vectors.sparkSession
    usable = _usable(vectors, dims)
    centroids = starts(usable, clusters, seed, scale)
    folder = run_folder(spark, "centroids")
    if not centroids:
        return Clusters([], spark.createDataFrame([], _OUT), [])
    written = stage(usable.mapInArrow(_blocks(scale, BLOCK), _BLOCK), f"{folder}/blocks")
    blocks = written.repartition(shards(spark), "block").persist(StorageLevel.MEMORY_AND_DISK)
    looked = blocks.select("block", "n", "kind", "vectors")
    k = len(centroids)
    now, counts, sums, popped = Round(centroids, [0] * k), [0] * k, [[0] * dims for _ in range(k)], []
    try:
        heaps = stage(looked.mapInArrow(_rescan(now), _HEAP), f"{folder}/0")
        for n in range(1, rounds + 1):
            popped.append(heaps.agg(F.sum("popped")).first()[0])
            _applied(heaps, counts, sums)
            moved = [[s // counts[c] for s in sums[c]] if counts[c] else now.centroids[c] for c in range(k)]
            drift = [ceil_root(sum((a - b) ** 2 for a, b in zip(old, new))) for old, new in zip(now.centroids, moved)]
            if not any(drift):  # nothing can change any more
                break
            others = [max((d for j, d in enumerate(drift) if j != c), default=0) for c in range(k)]
            now = Round(moved, [min(t + d + o, NEVER) for t, d, o in zip(now.drifted, drift, others)])
            expired = _expired(now.drifted)
            kept = heaps.filter(~expired).withColumn("popped", F.lit(0).cast("long")).withColumn("moved", F.slice("moved", 1, 0))
            open_ = heaps.filter(expired).select("block", "keys", "rows").join(looked, "block")
            heaps = stage(kept.unionByName(open_.mapInArrow(_rescan(now), _HEAP)), f"{folder}/{n}")
        members = stage(
            heaps.select("block", "rows").join(blocks, "block").mapInArrow(_distances(now.centroids), _OUT), f"{folder}/members")
    finally:
        blocks.unpersist()
    return Clusters(now.centroids, members, popped)


def digests(found: Clusters) -> DataFrame:
    """Every vector with its cluster, distance, the inertia of its cluster and of all, and a digest of its centroid."""
    spark = found.members.sparkSession
    per = found.members.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"), F.count("distance").alias("good")).collect()  # one row a cluster
    fits = lambda x: x if x is not None and x < LONG else None
    inertia = {r["cluster"]: int(r["s"]) if r["n"] == r["good"] else None for r in per}
    total = None if None in inertia.values() else sum(inertia.values())
    rows = [
        (c, fits(inertia[c]), fits(total), hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()) for c in inertia
    ]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.members.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
