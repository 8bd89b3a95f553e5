"""Label scores: parsed gold lists, confusion counts, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.functions import fixed, text
from textgraph.functions.joins import lookup_join
from textgraph.operators.labels import counted_labels, valid_label_set

COUNTS = ["tp", "fp", "fn", "tn"]


def gold_list(literal: Column) -> Column:
    """Gold labels of a text; an empty list stands for "nothing fits"."""
    parsed = text.label_literal(literal)
    return F.when(F.size(parsed) == 0, F.array(F.lit(fixed.NO_LABEL))).otherwise(parsed)


def unreadable_gold(texts: DataFrame, literal: str = "gold_labels") -> int:
    """How many cells of a dataset hold no list; they count as "nothing fits"."""
    return texts.filter(text.read_literal(F.col(literal)).isNull()).count()


def gold_rows(texts: DataFrame, key: str, labels: str = "gold_labels") -> DataFrame:
    rows = texts.select(key, F.posexplode_outer(labels).alias("pos", "label")).filter("pos IS NOT NULL")
    return rows.withColumn("pos", F.col("pos").cast("long"))


def confusion_counts(
    gold: DataFrame, generated: DataFrame, texts: DataFrame, taxonomy: DataFrame, signals: DataFrame
) -> DataFrame:
    """TP, FP, FN and TN per signal type and label over all texts.

    Gold and generated rows are (doc_id, signal_type, label). Each (text, label)
    is reduced to two flags before and after one shuffle, whose key holds the
    text, so a label that a third of all texts carry is still spread; the counts
    per label are then combined on the map side. True negatives are what is
    left of the number of texts, so texts and labels are never multiplied.
    """
    marked = gold.select("doc_id", "signal_type", "label", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        generated.select("doc_id", "signal_type", "label", F.lit(0).alias("g"), F.lit(1).alias("p"))
    )
    per_text = marked.groupBy("doc_id", "signal_type", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    hits = per_text.groupBy("signal_type", "label").agg(
        F.sum(F.col("g") * F.col("p")).alias("tp"),
        F.sum((1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counted = counted_labels(taxonomy, signals).join(hits, ["signal_type", "label"], "left").select(
        "signal_type", "label", zero("tp"), zero("fp"), zero("fn")
    )
    n = texts.agg(F.count("*").alias("n")).scalar()
    return counted.withColumn("tn", (n - F.col("tp") - F.col("fp") - F.col("fn")).cast("long"))


def scores_merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts of a batch added to the stored ones."""
    return stored.select("signal_type", "label", *COUNTS).unionByName(
        batch.select("signal_type", "label", *COUNTS)
    ).groupBy("signal_type", "label").agg(*[F.sum(c).alias(c) for c in COUNTS])


def quality_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where the divisor is 0."""
    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0))

    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1_score", ratio(2 * p * r, p + r))
    )


def invalid_label_counts(gold: DataFrame, taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """Gold labels outside the taxonomy: occurrences and first place seen."""
    invalid = lookup_join(gold, valid_label_set(taxonomy, signals), ["label"], "left_anti")
    return invalid.groupBy("label").agg(
        F.count("*").alias("occurrences"), F.min(F.struct("doc_id", "pos")).alias("first_seen")
    )


def invalid_labels_ranked(counts: DataFrame) -> DataFrame:
    """Most frequent first; ties in first-seen order."""
    return counts.orderBy(F.desc("occurrences"), F.asc("first_seen"))


def invalid_label_summary(gold: DataFrame, texts: DataFrame, taxonomy: DataFrame, signals: DataFrame) -> DataFrame:
    """Distinct invalid labels, occurrences, rows that hold one, and shares.

    One share is occurrences by rows; the share of rows that hold one is
    given beside it under its own name.
    """
    invalid = lookup_join(gold, valid_label_set(taxonomy, signals), ["label"], "left_anti")
    per_text = invalid.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    by_label = per_text.groupBy("label").agg(F.sum("n").alias("n")).agg(
        F.count("*").alias("invalid_labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")
    )
    rows = per_text.select("doc_id").distinct().agg(F.count("*").alias("n")).scalar()
    total = texts.agg(F.count("*").alias("n")).scalar()
    share = lambda n: F.round(F.try_divide(n * 100.0, F.col("total_rows")), 6)
    return (
        by_label.withColumn("affected_rows", rows).withColumn("total_rows", total)
        .withColumn("occurrence_percent", share(F.col("occurrences")))
        .withColumn("affected_percent", share(F.col("affected_rows")))
    )


def results_sorted(results: DataFrame, key: str = "id") -> DataFrame:
    return results.orderBy(key)
