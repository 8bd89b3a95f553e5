"""Taxonomy and labels: what may be offered, what a label belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgraph.functions import fixed
from textgraph.functions.joins import lookup_join

PRIORITY = {fixed.ONDERWERP: 1, fixed.BELEVING: 2}


def signal_topics(spark: SparkSession) -> DataFrame:
    """Which main topics belong to which signal type.

    A topic of two types is read as the type with the lower priority number,
    but is counted in both.
    """
    rows = [
        (signal, topic, PRIORITY[signal])
        for signal, topics in fixed.SIGNAL_TOPICS.items() for topic in topics
    ]
    return spark.createDataFrame(rows, "signal_type string, main_topic string, priority int")


def reading_signal(signals: DataFrame) -> DataFrame:
    """The one signal type a main topic is read as."""
    first = F.min_by("signal_type", "priority").alias("signal_type")
    return signals.groupBy("main_topic").agg(first, F.min("priority").alias("priority"))


def taxonomy_rows(taxonomy: DataFrame) -> DataFrame:
    """Sub topics grouped by main topic: main topics sorted, sub topics in file
    order. Rows in order, so no topic is collected into one list."""
    return taxonomy.select("main_topic", "pos", "sub_topic").orderBy("main_topic", "pos")


def offered_labels(taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """Labels a model may choose from, per signal type.

    Topics of no signal type are not offered. Each type also has the label for
    "nothing fits", put last where the taxonomy lacks it.
    """
    listed = taxonomy.join(reading_signal(signals), "main_topic").select(
        "signal_type", "main_topic", "pos", F.col("sub_topic").alias("label"), F.lit(0).alias("added")
    )
    types = taxonomy.sparkSession.createDataFrame([(s,) for s in PRIORITY], "signal_type string")
    has_it = listed.filter(F.col("label") == fixed.NO_LABEL).select("signal_type").distinct()
    added = types.join(has_it, "signal_type", "left_anti").select(
        "signal_type",
        F.lit(None).cast("string").alias("main_topic"),
        F.lit(None).cast("long").alias("pos"),
        F.lit(fixed.NO_LABEL).alias("label"),
        F.lit(1).alias("added"),
    )
    return listed.unionByName(added)


def allowed_labels(proposed: DataFrame, offered: DataFrame) -> DataFrame:
    """Proposed labels that are in the list of their own signal type.

    Rows, so order (``pos``) and duplicates stay.
    """
    return lookup_join(proposed, offered.select("signal_type", "label").distinct(), ["signal_type", "label"], "left_semi")


def rejected_labels(proposed: DataFrame, offered: DataFrame) -> DataFrame:
    return lookup_join(proposed, offered.select("signal_type", "label").distinct(), ["signal_type", "label"], "left_anti")


def labels_concat(allowed: DataFrame) -> DataFrame:
    """Allowed labels of a text in one order: onderwerp first, then beleving.

    Rows with the order in ``pos`` (type, then place in the answer); duplicates
    stay.
    """
    part = F.when(F.col("signal_type") == fixed.ONDERWERP, 1).otherwise(2)
    return allowed.select("doc_id", F.struct(part.alias("part"), F.col("pos").alias("place")).alias("pos"), "label")


def topic_of_label(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Main topic of a label: the first in alphabetical order.

    "Nothing fits" has a topic of its own where the taxonomy gives none.
    """
    first = taxonomy.groupBy(F.col("sub_topic").alias("label")).agg(F.min("main_topic").alias("main_topic"))
    found = lookup_join(labels, first, ["label"], "left")
    own = F.when(F.col("label") == fixed.NO_LABEL, F.lit(fixed.NO_TOPIC))
    return found.withColumn("main_topic", F.coalesce("main_topic", own))


def label_signal(taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """The one signal type a label is read as."""
    return (
        taxonomy.join(signals, "main_topic")
        .groupBy(F.col("sub_topic").alias("label"))
        .agg(F.min_by("signal_type", "priority").alias("signal_type"))
    )


def split_gold_by_signal(gold: DataFrame, taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """Gold labels with their signal type; labels of none are left out."""
    return lookup_join(gold, label_signal(taxonomy, signals), ["label"], "inner")


def skipped_gold(gold: DataFrame, taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    return lookup_join(gold, label_signal(taxonomy, signals), ["label"], "left_anti")


def valid_label_set(taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """Labels of both signal types and the one for "nothing fits"."""
    no_label = taxonomy.sparkSession.createDataFrame([(fixed.NO_LABEL,)], "label string")
    topics = signals.select("main_topic").distinct()
    return (
        taxonomy.join(topics, "main_topic", "left_semi").select(F.col("sub_topic").alias("label"))
        .union(no_label).distinct()
    )


def counted_labels(taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """Every (signal type, label) that gets a row of counts."""
    return taxonomy.join(signals, "main_topic").select("signal_type", F.col("sub_topic").alias("label")).distinct()
