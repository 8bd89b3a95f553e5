"""Near-duplicates by b-bit MinHash.

A document's set holds its distinct 5-word shingles (64-bit hashes; A-Z lowered,
words between ASCII whitespace; a shorter text is one shingle; none without
words). Documents of equal sets form a class; one set per class goes on.

Band keys come from whole minima. Of each minimum the low two bits are kept and
packed into sixteen longs, so two signatures are compared by bit counts: lanes that
agree by chance (a quarter) are corrected for, which estimates the similarity.
Estimates only spare work: pairs under the threshold by more than ``MARGIN``
(about five standard deviations) are not verified.

Candidates: all pairs of a band's bucket. First every document is verified
against one member of its buckets, the most central by the sizes of the buckets
it stands in, which joins most of a large group; after that only pairs of
different components are left to look at, and of those the ones whose estimate
and sizes allow a link. Every link is confirmed on full sets. Hot buckets are
split by a salt; signatures are joined to members of shared buckets only. With 25 bands of 5, a pair at 0.85 misses
all bands with a chance under 1e-6.

Defined results: a document without words is linked with nothing and is its own
component, as is one without an id (component null, kept). Rows repeated with
one id are one document to the links. Columns beside doc_id and text are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textgraph.llm.graph import components
from textgraph.session import run_folder, stage

WORDS = 5
BANDS, ROWS = 25, 5
HASHES = 512
BITS, LONGS = 2, HASHES * 2 // 64
LANES = 0x5555555555555555
MARGIN = 0.1
PIECE = 1 << 16  # shingles hashed at once
SPLIT = 512  # members of a bucket that meet in one task

_RANDOM = np.random.default_rng(1)
_SEEDS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 2**32, (2, HASHES), dtype=np.uint32) | np.uint32(1)
_K = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_K) + hashes[k : k + len(total)]
    return np.unique(_mixed(total + np.uint64(n)))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over each set: sets x HASHES."""
    least = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    points = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(points), PIECE):
        x, who = points[at : at + PIECE], owner[at : at + PIECE]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rows = who[starts]
        for k in range(HASHES):
            v = (x ^ _SEEDS[k]) * _FACTORS[0, k]
            v ^= v >> np.uint32(16)
            v *= _FACTORS[1, k]
            least[rows, k] = np.minimum(least[rows, k], np.minimum.reduceat(v, starts))
    return least


_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
    ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64())),
])
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature array<long>"


def _signatures(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
    least = _minima(sets)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(ROWS):
            key = key * np.uint64(_K) + least[:, band * ROWS + k]
        bands[:, band] = _mixed(key)
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(sets), LONGS, -1)
    packed = np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=2)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    whole = np.concatenate(sets)
    listed = lambda a: pa.ListArray.from_arrays(
        pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
        pa.array(np.add.reduceat(whole, starts).view(np.int64)),
        pa.array(np.add.reduceat(_mixed(whole + np.uint64(_K)), starts).view(np.int64)),
        listed(bands), listed(packed),
    ], schema=_SIGNED)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets, size, blank = [], [], 0, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = shingles(text)
            if not len(found):
                blank.append({"doc_id": doc_id, "n_shingles": 0})
                continue
            ids.append(doc_id)
            sets.append(found)
            size += len(found)
            if size >= 16 * PIECE:
                yield _signatures(ids, sets)
                ids, sets, size = [], [], 0
        if ids:
            yield _signatures(ids, sets)
        if blank:
            yield pa.RecordBatch.from_pylist(blank, _SIGNED)


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the bit count of two packed signatures, corrected for chance."""
    differing = []
    for k in range(LONGS):
        x = a[k].bitwiseXOR(b[k])
        differing.append(F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(LANES))))
    agree = 1 - reduce(lambda p, q: p + q, differing) / F.lit(float(HASHES))
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and estimate leave room for a link."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (estimate(F.col(f"{a}.signature"), F.col(f"{b}.signature")) >= percent / 100 - MARGIN)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            linked = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that full sets confirm."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return met.mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    spark = documents.sparkSession
    folder = run_folder(spark, "minhash")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(texts.mapInArrow(_sign, SIGNED), f"{folder}/signed")
    one_set = ["set_a", "set_b", "n_shingles"]
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy(*one_set).agg(F.min("doc_id").alias("id"))
    classes = stage(classes, f"{folder}/classes")
    shown = usable.withColumnRenamed("doc_id", "id").join(classes, ["id", *one_set], "left_semi")
    rows = shown.select("id", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = stage(rows.join(buckets, "bucket"), f"{folder}/members")
    weights = members.groupBy("id").agg(F.sum("members").alias("weight"))
    sketches = shown.select("id", F.col("n_shingles").alias("n"), "signature", "bands").join(weights, "id")
    sketches = stage(sketches, f"{folder}/sketches")
    of_these = texts.withColumnRenamed("doc_id", "id").join(sketches.select("id"), "id", "left_semi")
    sets = stage(of_these.select("id", "text").mapInArrow(_sets_of, "id long, shingles binary"), f"{folder}/sets")

    weighed = members.join(sketches.select("id", "weight"), "id")
    centres = weighed.groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))
    pairs = members.join(centres, "bucket").filter("id <> centre").select("id", "centre").distinct()
    a = sketches.select("id", F.struct("id", "n", "signature").alias("a"))
    b = sketches.select(F.col("id").alias("centre"), F.struct("id", "n", "signature", "weight").alias("b"))
    near = pairs.join(a, "id").join(b, "centre").filter(_may_link("a", "b", percent))
    stars = near.groupBy(F.col("id").alias("a")).agg(F.max_by("centre", F.struct("b.weight", -F.col("centre"))).alias("b"))
    stars = stage(stars, f"{folder}/stars")
    links = stage(_links(stars, sets, percent), f"{folder}/star-links")
    joined = components(links)

    left = members.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = left.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    left = left.join(open_.select("bucket"), "bucket", "left_semi").join(sketches.drop("weight"), "id")
    left = stage(left, f"{folder}/left")
    salts = F.ceil(F.col("members") / SPLIT).cast("int")
    a = left.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).alias("a")
    b = left.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).alias("b")
    apart = (
        (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.id") > F.col("b.id"))
        & (F.col("a.component") != F.col("b.component")) & _may_link("a", "b", percent)
        # A pair is met in each bucket it shares and taken in the first.
        & (F.get(F.array_intersect("a.bands", "b.bands"), F.lit(0)) == F.col("a.bucket"))
    )
    rest = a.join(b, apart).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    tried = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = stage(rest.join(tried, ["a", "b"], "left_anti"), f"{folder}/rest")
    more = stage(_links(rest, sets, percent), f"{folder}/rest-links")

    found = components(links.unionByName(more))
    named = classes.join(found, "id", "left").select(*one_set, F.coalesce("component", "id").alias("component_id"))
    whole = signed.select("doc_id", *one_set).join(named, one_set, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of the document that stays of each group; of rows equal in id and text one stays.

    Rows without an id are linked with nothing and stay.
    """
    spark = documents.sparkSession
    kept = near_duplicates(documents, percent).filter("kept").select("doc_id").distinct()
    kept = stage(kept, run_folder(spark, "minhash-kept"))
    rows = documents.select("doc_id", F.xxhash64("text").alias("text"), F.struct("*").alias("row"))
    named = rows.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(rows.filter("doc_id IS NULL")).select("row.*")
