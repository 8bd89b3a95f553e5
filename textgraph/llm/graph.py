"""Connected components of links, by rounds of joins over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgraph.session import run_folder, stage


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``a, b``; the component is its smallest id.

    Alternating large-star and small-star steps: each id's larger neighbours are
    linked to its smallest one, then its smaller neighbours are, until nothing
    changes. Every round is written before the next, so plans stay short and a
    lost executor costs one round. Minima are taken before the shuffle; a hub's
    rows are joined to one number.
    """
    spark = links.sparkSession
    folder = run_folder(spark, "components")
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stage(edges, f"{folder}/0"), None
    for n in range(1, 1000):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, f"{folder}/{n}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/{n}")
        before = now
    raise RuntimeError("components did not settle")
