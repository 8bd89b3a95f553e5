"""Scores of generated labels against a labelled dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textgraph.functions import fixed
from textgraph.functions.joins import row_join
from textgraph.operators.jsonld import document_terms, term_signals
from textgraph.operators.labels import split_gold_by_signal
from textgraph.operators.scoring import (
    confusion_counts, gold_list, gold_rows, invalid_label_counts, quality_scores,
)
from textgraph.session import run_folder, stage


NO_DOCUMENT = "no document"


@dataclass
class Evaluation:
    results: DataFrame
    rejects: DataFrame
    counts: DataFrame
    scores: DataFrame


def check_gold(gold: DataFrame, taxonomy: DataFrame, signals: DataFrame, on_invalid: str) -> None:
    """Stop, or go on, where gold labels lie outside the taxonomy."""
    if on_invalid not in ("fail", "keep"):
        raise ValueError("on_invalid is 'fail' or 'keep'")
    if on_invalid == "fail" and not invalid_label_counts(gold, taxonomy, signals).isEmpty():
        raise ValueError("gold labels outside the taxonomy; on_invalid='keep' goes on with them")


def evaluate(
    dataset: DataFrame,
    documents: DataFrame,
    taxonomy: DataFrame,
    signals: DataFrame,
    on_invalid: str = "keep",
    folder: str | None = None,
) -> Evaluation:
    """Counts and scores of a dataset (doc_id, text, gold_labels as a list
    literal) against its final documents (doc_id, json_ld and, if it has one,
    reject_reason).

    Texts that came with a reason, have no document, or whose labels cannot be
    read are rejected with the reason and not counted. The documents are parsed
    once; their terms and the scored texts are stage tables. Documents of other
    texts than those of the dataset do not count.
    """
    folder = folder or run_folder(dataset.sparkSession, "evaluate")
    gold = dataset.select("doc_id", "text", gold_list(F.col("gold_labels")).alias("gold_labels"))
    check_gold(gold_rows(gold, "doc_id"), taxonomy, signals, on_invalid)
    given = F.col("reject_reason") if "reject_reason" in documents.columns else F.lit(None).cast("string")
    own = documents.select("doc_id", "json_ld", F.when(F.col("json_ld").isNull(), F.coalesce(given, F.lit(NO_DOCUMENT))).otherwise(given).alias("given"))
    read = stage(
        document_terms(own).select("doc_id", "terms", F.coalesce("given", "reject_reason").alias("reject_reason")), f"{folder}/terms"
    )
    met = stage(
        row_join(gold, read, "doc_id", "left").withColumn(
            "reject_reason", F.when(F.col("terms").isNull(), F.coalesce("reject_reason", F.lit(NO_DOCUMENT))).otherwise(F.col("reject_reason"))
        ), f"{folder}/scored",
    )
    scored = met.filter("reject_reason IS NULL").drop("reject_reason")
    rejects = met.filter("reject_reason IS NOT NULL").select("doc_id", "reject_reason")

    generated = term_signals(scored, signals)
    actual = split_gold_by_signal(gold_rows(scored, "doc_id"), taxonomy, signals)
    wanted = generated.select("doc_id", "signal_type", "label", "pos")
    counts = confusion_counts(actual, wanted, scored, taxonomy, signals)

    # The stored list has the labels of beleving first.
    first = F.when(F.col("signal_type") == fixed.BELEVING, 0).otherwise(1)
    ordered = F.sort_array(F.collect_list(F.struct(first.alias("o"), "pos", "label")))
    lists = wanted.groupBy("doc_id").agg(F.transform(ordered, lambda l: l["label"]).alias("generated_labels"))
    results = row_join(
        scored.select(F.col("doc_id").alias("source_id"), "text", "gold_labels"),
        lists.withColumnRenamed("doc_id", "source_id"), "source_id", "left",
    ).withColumn("generated_labels", F.coalesce("generated_labels", F.array().cast("array<string>")))
    return Evaluation(results, rejects, counts, quality_scores(counts))
