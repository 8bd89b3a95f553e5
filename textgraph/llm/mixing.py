"""Mixing sources to target weights by repetition rates.

Words are summed per source, a source's rate is its target over its size, and
each document is emitted floor(rate) times plus one copy drawn with the
fraction's probability from a hash of seed and doc_id. Reruns agree.

Defined results: null or blank texts have size 0 and are emitted like others
(no words are taken from them); a null source is a source of its own, last in
order; a source without words has target 0 and rate 0; an empty table gives an
empty table; rows repeated with one doc_id draw alike; a null doc_id draws as
the text "null". Columns of the input that are called like a result column are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textgraph.session import run_folder, stage

WORD = r"[^\x20\x09-\x0D]+"
DRAW_DIGITS = 13  # hex digits of the draw: 52 bits, exact as a double


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    The excess of capped sources is reshared by weight until none is above its
    cap. That is a common level: target = min(cap, level * weight). Sources
    are capped in the order of cap / weight, so running sums find the level.
    The windows run over one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    per = per.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    per = per.withColumn("_weight_left", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("_full", F.col("_left") * F.col("_w") >= F.col("_cap") * F.col("_weight_left"))
    level = (F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)) / F.sum(
        F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))
    ).over(whole)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w"))
    return per.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(16.0**DRAW_DIGITS)


def mix_plan(
    documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 10,
) -> DataFrame:
    """Each document with ``size, source_size, target, copies, taken``.

    The targets are written to the shared folder first. Their size is then
    known when the join is planned: Spark broadcasts a few sources and shuffles
    for many, splitting a hot one, and the texts stay where they are if it can.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    sized = documents.drop(*made).withColumn("size", words(F.col("text")))
    spark = documents.sparkSession
    targets = stage(source_targets(sized.select("source", "size"), weights, share, cap), run_folder(spark, "mix-targets"))
    targets = targets.withColumnRenamed("source", "_source")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = (whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the input's columns, once per copy, and ``copy`` from 1 (in place of an input column ``copy``)."""
    rows = documents.drop("copy")
    plan = mix_plan(rows.select("doc_id", "text", "source", F.struct("*").alias("row")), **options).filter(F.col("copies") > 0)
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*", "copy")
