"""A class hierarchy as intervals: which classes lie below one, without a stored closure.

Each class has one parent in a spanning forest, the smallest. A walk around the
forest gives every class an interval that holds those of all classes below it. A
further parent is an exception: what lies below the class lies below that parent,
too. Tables are as large as the hierarchy, however deep it is; where a chain of n
classes has n * n / 2 pairs, it has n intervals.

The walk is a linked list of steps down to and up from each class. Places in it
come by pointer jumping: every step knows the one that is 1, 2, 4, ... ahead, so
rounds follow the logarithm of the number of classes. A cycle is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from textgraph.session import stage

JUMPS = 2  # doublings of a round


@dataclass
class Hierarchy:
    """Staged tables: classes (label, known, lo, hi), with the names that are only parents as not known; exceptions (lo, hi, point).

    ``x`` is below ``y`` where its lo lies in the interval of ``y``, or where it
    lies in that of an exception whose point does.
    """

    classes: DataFrame
    exceptions: DataFrame
    any_exceptions: bool


def holding(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pairs of rows with ``lo <= point <= hi``, as an equal join.

    An interval of a length up to 2^k is kept under the one or two blocks of that
    size that it touches; a point is looked up once for each size in use.
    """
    size = F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int")
    sized = intervals.withColumn("_size", size)
    blocks = sized.withColumn("_block", F.explode(F.array_distinct(F.array(
        F.expr("shiftright(lo, _size)"), F.expr("shiftright(hi, _size)")))))
    sizes = [r[0] for r in sized.select("_size").distinct().collect()]  # at most 63
    looked = points.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn(
        "_block", F.expr("shiftright(point, _size)"))
    return looked.join(blocks, ["_size", "_block"]).filter("point BETWEEN lo AND hi").drop("_size", "_block")


def _walk(tree: DataFrame, folder: str) -> DataFrame:
    """``id, lo, hi`` of the nodes ``id, parent`` of a forest; parent null: a root."""
    top = F.coalesce("parent", F.lit(-1).cast("long"))
    brothers = Window.partitionBy("_top").orderBy("id")
    rows = tree.withColumn("_top", top).withColumn("next", F.lead("id").over(brothers))
    first = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    rows = rows.join(first, "id", "left")
    down, up = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    step = lambda at, to: F.struct(at.alias("step"), to.alias("ahead"))
    steps = rows.select(F.inline(F.array(
        step(down("id"), F.coalesce(down("child"), up("id"))),
        step(up("id"), F.coalesce(down("next"), up("parent"))))))
    # Roots follow one another as brothers do, so there is one walk, and one end.
    steps = stage(steps.withColumn("n", F.when(F.col("ahead").isNull(), 0).otherwise(1).cast("long")), f"{folder}/0")
    number, total = 0, steps.count()
    reach = 1
    while reach < total:
        for _ in range(JUMPS):
            further = steps.select(F.col("step").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("n").alias("_n"))
            steps = steps.join(further, "ahead", "left").select(
                "step", F.col("_ahead").alias("ahead"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
            reach *= 2
        number += 1
        steps = stage(steps, f"{folder}/{number}")
    if not steps.filter("ahead IS NOT NULL").isEmpty():
        raise ValueError("the class hierarchy has a cycle")
    place = F.lit(total) - F.col("n")
    return steps.groupBy(F.expr("shiftright(step, 1)").alias("id")).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))


def _closed(edges: DataFrame, folder: str) -> DataFrame:
    """``lo, hi, point`` for every further parent that can be reached over further parents, from ``edge, lo, hi, point``.

    An edge leads on to those of the classes that its point lies below. Rounds of
    distinct pairs of edges, each written before the next.
    """
    follows = holding(edges.select("edge", "point"), edges.select(F.col("edge").alias("after"), "lo", "hi")).select("edge", "after")
    pairs, known, number = stage(follows.distinct(), f"{folder}/0"), None, 0
    while (n := pairs.count()) != known:
        if not pairs.filter("edge = after").isEmpty():
            raise ValueError("the class hierarchy has a cycle")
        known, number = n, number + 1
        via = pairs.select(F.col("edge").alias("after"), F.col("after").alias("_after"))
        further = pairs.join(via, "after").select("edge", F.col("_after").alias("after"))
        pairs = stage(pairs.unionByName(further).distinct(), f"{folder}/{number}")
    all_ = pairs.unionByName(edges.select("edge", F.col("edge").alias("after")))
    target = edges.select(F.col("edge").alias("after"), "point")
    return all_.join(target, "after").join(edges.select("edge", "lo", "hi"), "edge").select("lo", "hi", "point").distinct()


def hierarchy(classes: DataFrame, folder: str) -> Hierarchy:
    """The index of ``label, parent`` (null: none), one row per parent."""
    rows = classes.select("label", "parent").filter("label IS NOT NULL").distinct()
    names = rows.select("label", F.lit(True).alias("known")).unionByName(
        rows.filter("parent IS NOT NULL").select(F.col("parent").alias("label"), F.lit(False).alias("known")))
    numbered = stage(
        names.groupBy("label").agg(F.max("known").alias("known")).withColumn("id", F.monotonically_increasing_id()), f"{folder}/names")
    id_of = numbered.select("label", "id")
    parents = rows.filter("parent IS NOT NULL").join(id_of, "label").join(
        id_of.select(F.col("label").alias("parent"), F.col("id").alias("up")), "parent").select("id", "label", "parent", "up")
    edges = stage(parents.withColumn(
        "first", F.row_number().over(Window.partitionBy("id").orderBy("parent")) == 1), f"{folder}/edges")
    tree = id_of.select("id").join(edges.filter("first").select("id", F.col("up").alias("parent")), "id", "left")
    walked = stage(_walk(tree, f"{folder}/walk"), f"{folder}/walked")
    done = stage(numbered.join(walked, "id").select("label", "known", "lo", "hi"), f"{folder}/classes")
    more = edges.filter("NOT first").select("id", "up").join(walked, "id").join(
        walked.select(F.col("id").alias("up"), F.col("lo").alias("point")), "up").select(
            F.monotonically_increasing_id().alias("edge"), "lo", "hi", "point")
    more = stage(more, f"{folder}/more")
    any_ = not more.isEmpty()
    exceptions = stage(_closed(more, f"{folder}/closed"), f"{folder}/exceptions") if any_ else more.drop("edge")
    return Hierarchy(done, exceptions, any_)


def covered(index: Hierarchy, rows: DataFrame, key: str) -> DataFrame:
    """``key, intervals``: for rows of ``key, label``, the classes at or below a label of a key, as disjoint intervals in order."""
    own = rows.join(index.classes.select("label", "lo", "hi"), "label").select(key, "lo", "hi").distinct()
    if index.any_exceptions:
        points = index.exceptions.select(F.col("lo").alias("from_lo"), F.col("hi").alias("from_hi"), "point")
        own = own.unionByName(holding(points, own).select(key, F.col("from_lo").alias("lo"), F.col("from_hi").alias("hi")).distinct())
    before = Window.partitionBy(key).orderBy("lo", "hi")
    reached = F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("_new", (reached.isNull() | (F.col("lo") > reached + 1)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("intervals"))
