"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of its partial scores over slices of its dimensions.
Vectors stand in blocks of rows; a block of queries meets a block of vectors in
one task.

1. Every slice gives, per query and block, its local list: the k rows with the
   largest partial scores, and their whole scores. The k-th best whole score of
   all lists of a query is its cutoff: k rows reach it, so it is safe.
2. A row that reaches the cutoff has a slice with at least cutoff / slices. With
   the cutoff back at the blocks, the rows with such a slice are collected, and
   those are dropped whose upper bound (known large parts, the threshold for the
   others) stays under the cutoff.
3. What remains is scored exactly. A block sends its k best per query.

No list is longer than k per query, slice and block. The product of query blocks
and vector blocks is the stated work; queries travel to the vector blocks.

Defined results: vectors that are null, hold a null or non-finite component, or
have no id take no part; with fewer than k candidates all are returned; shorter
vectors count as filled up with zeros; ties go to the smaller id, then to the
earlier row; rows repeated with one id are rows of their own. Scores are exact;
one that does not fit a long stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textgraph.session import run_folder, stage

SCALE = 1024
K = 10
SLICES = 4
VECTORS, QUERIES = 4096, 256  # rows of a block
EXACT = 2**53

_BLOCK = "block long, n long, dims long, ids binary, vectors binary"
_BLOCKS = pa.schema([
    ("block", pa.int64()), ("n", pa.int64()), ("dims", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()),
])


def _blocks_of(size: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, rows = 0, [], []

        def block() -> pa.RecordBatch:
            dims = max(map(len, rows))
            whole = np.zeros((len(rows), dims), np.int64)
            for n, row in enumerate(rows):
                whole[n, : len(row)] = row
            number = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_pylist([{
                "block": number, "n": len(rows), "dims": dims,
                "ids": np.array(ids, np.int64).tobytes(), "vectors": whole.tobytes()}], _BLOCKS)

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = np.floor(scale * np.array(vector, np.float64))
                if len(parts) and np.abs(parts).max() >= 2.0**62:
                    raise OverflowError(f"vector {vec_id}: a component does not fit a long")
                ids.append(vec_id)
                rows.append(parts.astype(np.int64))
                if len(rows) == size:
                    yield block()
                    made, ids, rows = made + 1, [], []
        if rows:
            yield block()

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["dims"])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are exact, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _partial(q: np.ndarray, v: np.ndarray, slices: int) -> list[np.ndarray]:
    dims = min(q.shape[1], v.shape[1])  # the rest meets zeros
    cuts = [dims * s // slices for s in range(slices + 1)]
    return [_product(q[:, a:b], v[:, a:b]) for a, b in zip(cuts, cuts[1:])]


def _best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best allowed scores, ties by id and place."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        edge = np.sort(scores[at])[-k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((at, ids[at], -scores[at]))][:k]


_ENTRY = "query_block long, query_row long, query_id long, block long, row long, vec_id long, slice long, part long, score long"
_ENTRIES = pa.schema([(c.split()[0], pa.int64()) for c in _ENTRY.split(", ")])


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {name: list(column) for name, column in zip(_ENTRIES.names, zip(*rows) if rows else [[]] * len(_ENTRIES))}, _ENTRIES)


def _pairs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for pair in batch.to_pylist():
            q_ids, q = _opened({k: pair["q_" + k] for k in ("n", "dims", "ids", "vectors")})
            v_ids, v = _opened(pair)
            rows, own = np.frombuffer(pair["q_rows"], np.int64).reshape(-1, 2), []
            for block, row in rows:  # where a query itself stands in this block
                own.append(int(row) if block == pair["block"] else -1)
            yield pair, q_ids, q, v_ids, v, own


def _local_lists(k: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, q_ids, q, v_ids, v, own in _pairs(batches):
            parts = _partial(q, v, slices)
            total, out = sum(parts), []
            for n, query in enumerate(q_ids.tolist()):
                allowed = np.arange(len(v_ids)) != own[n]
                for s, part in enumerate(parts):
                    for at in _best(part[n], allowed, v_ids, k).tolist():
                        out.append((pair["q_block"], n, query, pair["block"], at, int(v_ids[at]), s, int(part[n, at]), int(total[n, at])))
            yield _entries(out)

    return run


def _sufficient(k: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, q_ids, q, v_ids, v, own in _pairs(batches):
            parts, out = _partial(q, v, slices), []
            cutoffs = {c["query_row"]: c["cutoff"] for c in pair["cutoffs"] or []}
            for n, query in enumerate(q_ids.tolist()):
                allowed = np.arange(len(v_ids)) != own[n]
                cutoff = cutoffs.get(n)
                if cutoff is not None:
                    least = -(-cutoff // slices)
                    large = [p[n] >= least for p in parts]
                    bound = sum(np.where(g, p[n], least) for g, p in zip(large, parts))
                    allowed &= np.logical_or.reduce(large) & (bound >= cutoff)
                at = np.flatnonzero(allowed)
                score = sum(p[n][at] for p in parts)
                for i in _best(score, score >= cutoff if cutoff is not None else np.ones(len(at), bool), v_ids[at], k).tolist():
                    out.append((pair["q_block"], n, query, pair["block"], int(at[i]), int(v_ids[at[i]]), -1, 0, int(score[i])))
            yield _entries(out)

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, slices: int = SLICES, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vec_id, embedding`` that is a query."""
    spark = vectors.sparkSession
    usable = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    folder = run_folder(spark, "top-k")
    blocks = stage(usable.mapInArrow(_blocks_of(VECTORS, scale), _BLOCK), f"{folder}/vectors")
    queries = stage(_query_blocks(blocks, is_query), f"{folder}/queries")
    # Queries travel to the vector blocks: an equi-join on the block, no product of rows.
    places = blocks.select("block")
    dealt = queries.select(*(F.col(c).alias("q_" + c) for c in queries.columns))
    pairs = dealt.join(places).select("block", *dealt.columns)
    lists = pairs.join(blocks, "block").mapInArrow(_local_lists(k, slices), _ENTRY)
    query = ["query_block", "query_row"]
    local = lists.withColumn("_n", F.row_number().over(Window.partitionBy(*query, "slice").orderBy(F.desc("part"), "vec_id", "block", "row")))
    whole = local.filter(F.col("_n") <= k).groupBy(*query, "block", "row").agg(F.max("score").alias("score"))
    ranked = whole.withColumn("_n", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "block", "row")))
    cutoffs = (
        ranked.filter(F.col("_n") == k).groupBy(F.col("query_block").alias("q_block"))
        .agg(F.collect_list(F.struct("query_row", F.col("score").alias("cutoff"))).alias("cutoffs"))  # at most QUERIES
    )
    cutoffs = stage(cutoffs, f"{folder}/cutoffs")
    found = pairs.join(cutoffs, "q_block", "left").join(blocks, "block").mapInArrow(_sufficient(k, slices), _ENTRY)
    rank = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id", "block", "row"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_QUERY_BLOCK = f"{_BLOCK}, rows binary"


def _query_blocks(blocks: DataFrame, is_query) -> DataFrame:
    """Blocks of the queries, with the place of each in the vector blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        made = 0

        def block(rows) -> pa.RecordBatch:
            dims = max(len(r[3]) for r in rows)
            whole = np.zeros((len(rows), dims), np.int64)
            for n, row in enumerate(rows):
                whole[n, : len(row[3])] = row[3]
            return pa.RecordBatch.from_pylist([{
                "block": (TaskContext.get().partitionId() << 32) + made, "n": len(rows), "dims": dims,
                "ids": np.array([r[2] for r in rows], np.int64).tobytes(), "vectors": whole.tobytes(),
                "rows": np.array([r[:2] for r in rows], np.int64).tobytes()}], _BLOCKS.append(pa.field("rows", pa.binary())))

        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _opened(row)
                for at in np.flatnonzero(is_query(ids)).tolist():
                    held.append((row["block"], at, int(ids[at]), vectors[at]))
                    if len(held) == QUERIES:
                        yield block(held)
                        made, held = made + 1, []
        if held:
            yield block(held)

    return blocks.mapInArrow(run, _QUERY_BLOCK)
