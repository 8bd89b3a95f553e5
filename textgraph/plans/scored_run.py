"""A labelled dataset, slice by slice: job, scores, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgraph.operators.scoring import gold_list, gold_rows
from textgraph.plans.evaluate import check_gold, evaluate
from textgraph.session import run_folder, stage
from textgraph.sources.sinks import write_report
from textgraph.sources.tables import read_or_empty, resume_slice
from textgraph.streaming.incremental import total_scores

RESULTS = "source_id long, text string, gold_labels array<string>, generated_labels array<string>, batch_id long"
REJECTS = "source_id long, reject_reason string, batch_id long"


def scored_run(
    dataset: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    taxonomy: DataFrame,
    signals: DataFrame,
    out: str,
    limit: int | None = None,
    on_invalid: str = "fail",
) -> DataFrame | None:
    """Score the next ``limit`` texts (None: all) and return all scores; None if
    no text is left.

    ``dataset`` is (doc_id, text, gold_labels as a list literal); ``run`` makes
    documents (doc_id, json_ld, reject_reason) of texts, as ``TextToGraph.run``
    does; a text with a reason is rejected, also if it has a document. Results,
    rejects and counts of a slice go into partitions named by its first id, and
    the slice counts as done only when the ids of its texts are written after
    them: a run that was cut off replaces what it had left. ``write_scored_report``
    makes the report of all slices, once they are done.
    """
    spark = dataset.sparkSession
    rows = stage(
        resume_slice(dataset, read_or_empty(spark, f"{out}/progress", "source_id long"), limit, "doc_id"),
        run_folder(spark, "slice"),
    )
    first = rows.agg(F.min("doc_id").alias("first")).first()["first"]
    if first is None:
        return None
    gold = rows.select("doc_id", gold_list(F.col("gold_labels")).alias("gold_labels"))
    check_gold(gold_rows(gold, "doc_id"), taxonomy, signals, on_invalid)

    documents = run(rows.select("doc_id", "text")).select("doc_id", "json_ld", "reject_reason")
    done = evaluate(rows, documents, taxonomy, signals, on_invalid="keep")
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={first}")
    write(done.counts, "deltas")
    write(done.results, "results")
    write(done.rejects.withColumnRenamed("doc_id", "source_id"), "rejects")
    write(rows.select(F.col("doc_id").alias("source_id")), "progress")
    return total_scores(spark, out)


def write_scored_report(spark: SparkSession, out: str) -> None:
    """The report of all finished slices."""
    write_report(read_or_empty(spark, f"{out}/results", RESULTS).drop("batch_id"), total_scores(spark, out), f"{out}/report")
