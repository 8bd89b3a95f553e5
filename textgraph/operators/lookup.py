"""Semantic lookup: the five nearest classes, the choice, its definition."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from textgraph.functions import fixed
from textgraph.functions.joins import lookup_join, row_join
from textgraph.session import run_folder, stage

BLOCK_BYTES = 64 * 1024 * 1024
CHUNK = 1024
CANDIDATES = "array<struct<rank:int,class_id:bigint,class_label:string,comments:string,score:double>>"


def semantic_topk(
    mentions: DataFrame, classes: DataFrame, k: int = fixed.TOP_K, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``candidates``: the k classes with the highest cosine, best first.

    ``mentions`` has ``embedding``; ``classes`` has class_id, class_label,
    comments and embedding. Exact: every mention meets every class, as one
    matrix product per Arrow batch. Scores are compared at 12 decimals; equal
    scores go by class_id, and pairs without a cosine (a zero vector) come last
    with a NULL score.

    The class side is measured first, vectors and texts. It travels as one
    broadcast if it fits in ``block_bytes``. Else its vectors are spread over
    blocks by the hash of their id, packed chunks of mentions meet every block in
    one join, and the best k of each are merged per mention; labels and comments
    are joined to what is left. The result is the same, and no task ever holds
    more than a block and a chunk.
    """
    texts = F.coalesce(F.octet_length("class_label"), F.lit(0)) + F.coalesce(F.octet_length("comments"), F.lit(0))
    size = classes.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding") * 8 + 64 + texts), F.lit(0)).alias("b")
    ).first()
    blocks = max(1, math.ceil(size["b"] / block_bytes))
    if blocks == 1:
        return _with_block(mentions, classes, k)
    return _over_blocks(mentions, classes, k, blocks)


def _over_blocks(mentions: DataFrame, classes: DataFrame, k: int, blocks: int) -> DataFrame:
    """The best k over blocks of classes, as one job behind a staged table of numbered mentions."""
    folder = run_folder(mentions.sparkSession, "topk")
    kept = mentions.drop("candidates")
    numbered = stage(kept.withColumn("_row", F.monotonically_increasing_id()), f"{folder}/mentions")
    packed = "block int, ids binary, vectors binary, width int"
    # Spark hands a group over whole; a group is one block.
    store = classes.select(F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("block"), "class_id", "embedding")
    store = store.groupBy("block").applyInArrow(_packed_block, packed)
    chunks = numbered.select("_row", "embedding").mapInArrow(_packed_chunks, "rows binary, mentions binary, mention_width int")
    dealt = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.join(store, "block").mapInArrow(_nearest_in_block(k), "_row long, class_id long, _key double, score double")
    place = F.row_number().over(Window.partitionBy("_row").orderBy("_key", "class_id"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    best = best.join(classes.select("class_id", "class_label", "comments"), "class_id")
    item = F.struct("rank", "class_id", "class_label", "comments", "score")
    lists = best.groupBy("_row").agg(F.sort_array(F.collect_list(item)).cast(CANDIDATES).alias("candidates"))  # k per mention
    whole = row_join(numbered, lists, "_row", "left").drop("_row")
    return whole.withColumn("candidates", F.coalesce("candidates", F.array().cast(CANDIDATES)))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of an Arrow column as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or flat.size != len(column) * width:
        raise ValueError(f"every vector must have {width} numbers")
    return flat.reshape(len(column), width)


def _packed_block(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("class_id")
    vectors = table["embedding"].combine_chunks()
    width = len(vectors[0])
    return pa.Table.from_pylist(
        [{"block": key[0].as_py(), "ids": table["class_id"].to_numpy().astype(np.int64).tobytes(),
          "vectors": _matrix(vectors, width).tobytes(), "width": width}],
        pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32())]),
    )


def _packed_chunks(batches):
    schema = pa.schema([("rows", pa.binary()), ("mentions", pa.binary()), ("mention_width", pa.int32())])
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            vectors = part.column("embedding")
            width = max((len(v) for v in vectors if v.is_valid), default=0)
            yield pa.RecordBatch.from_pylist(
                [{"rows": part.column("_row").to_numpy().astype(np.int64).tobytes(),
                  "mentions": _matrix(vectors, width).tobytes(), "mention_width": width}], schema)


def _nearest_in_block(k: int):
    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                rows, ids = np.frombuffer(pair["rows"], np.int64), np.frombuffer(pair["ids"], np.int64)
                if pair["mention_width"] != pair["width"]:
                    raise ValueError(f"every vector must have {pair['width']} numbers")
                query = np.frombuffer(pair["mentions"]).reshape(len(rows), -1)
                store = np.frombuffer(pair["vectors"]).reshape(len(ids), -1)
                norms = np.sqrt((query * query).sum(axis=1))[:, None] * np.sqrt((store * store).sum(axis=1))[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (query @ store.T) / norms
                key = np.where(np.isfinite(score), -np.round(score, 12), np.inf)
                picked = np.argsort(key, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(score, picked, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(rows, picked.shape[1])), pa.array(ids[picked.ravel()]),
                    pa.array(np.take_along_axis(key, picked, axis=1).ravel()), pa.array(best, mask=~np.isfinite(best)),
                ], names=["_row", "class_id", "_key", "score"])

    return run


def _with_block(mentions: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The best k of classes that fit in one broadcast, as ``candidates``."""
    spark = mentions.sparkSession
    store = classes.select("class_id", "class_label", "comments", "embedding").toPandas()
    store = store.sort_values("class_id", kind="stable")
    shipped = spark.sparkContext.broadcast(
        (
            [int(i) for i in store["class_id"]],
            list(store["class_label"]),
            list(store["comments"]),
            np.array([np.asarray(v, dtype=np.float64) for v in store["embedding"]]),
        )
    )
    kept = [f for f in mentions.schema.fields if f.name != "candidates"]
    schema = T.StructType([*kept, T.StructField("candidates", T.DataType.fromDDL(CANDIDATES))])
    return mentions.mapInArrow(_nearest(shipped, k), schema)


def _nearest(shipped, k: int):
    """The Arrow function; it imports what it needs, so it travels alone."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, labels, comments, matrix = shipped.value
        keep = min(k, len(ids))
        class_norm = np.sqrt((matrix * matrix).sum(axis=1)) if keep else None
        store = [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(comments, pa.string(), from_pandas=True)]

        def scored(part):
            """Positions in the store and cosines of the best ``keep`` classes."""
            n = part.num_rows
            if not keep:
                return np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0))
            vectors = part.column("embedding").combine_chunks()
            query = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if vectors.null_count or query.size != n * matrix.shape[1]:
                raise ValueError(f"every vector must have {matrix.shape[1]} numbers")
            query = query.reshape(n, -1)
            norm = np.sqrt((query * query).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                score = (query @ matrix.T) / (norm[:, None] * class_norm[None, :])
            picked = np.argsort(sort_key(score), axis=1, kind="stable")[:, :keep]
            return picked, np.take_along_axis(score, picked, axis=1)

        def sort_key(score):
            return np.where(np.isfinite(score), -np.round(score, 12), np.inf)

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for start in range(0, whole.num_rows, 1024):
                part = whole.slice(start, 1024)
                n = part.num_rows
                picked, score = scored(part)
                columns = [a.take(pa.array(picked.ravel())) for a in store]
                width = keep
                values = score.ravel()
                items = pa.StructArray.from_arrays(
                    [
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)),
                        *columns,
                        pa.array(values, pa.float64(), mask=~np.isfinite(values)),
                    ],
                    ["rank", "class_id", "class_label", "comments", "score"],
                )
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                whole_lists = pa.ListArray.from_arrays(offsets, items)
                yield from part.append_column("candidates", whole_lists).to_batches()

    return run


def candidate_rows(topk: DataFrame, keys: list[str]) -> DataFrame:
    """One row per mention and candidate."""
    return topk.select(*keys, F.inline("candidates"))


def choice_check(topk: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """Compare the chosen name with the candidate at the chosen number.

    The name wins; ``mismatch`` reports a difference. A number outside 1..5 is
    an invalid answer, one behind the last candidate has nothing to compare.
    """
    at = F.get("candidates", F.col("selected_number") - 1)["class_label"]
    valid = F.col("selected_number").between(1, fixed.TOP_K)
    return row_join(topk, choices, keys).select(
        *keys,
        "selected_number",
        F.col("selected_class").alias("chosen"),
        F.when(valid, at).alias("expected"),
        valid.alias("valid"),
        (valid & ~F.col("selected_class").eqNullSafe(at)).alias("mismatch"),
    )


def one_definition_per_label(definitions: DataFrame, label: str = "label") -> DataFrame:
    """The first definition of a label that is listed twice."""
    rest = [c for c in definitions.columns if c != label]
    return definitions.groupBy(label).agg(F.min_by(F.struct(*rest), "class_id").alias("d")).select(label, "d.*")


def definition_lookup(mapping: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definition of the chosen class; ``missing`` marks a label without one."""
    found = one_definition_per_label(definitions).withColumn("_found", F.lit(True))
    joined = lookup_join(mapping, found.withColumnRenamed("label", "schema_label"), ["schema_label"], "left")
    return joined.withColumn("missing", F.col("_found").isNull()).drop("_found")
