"""Sinks: call log, results, documents, scores, reports, Turtle text.

No sink updates in place. A log or a result is appended; scores are written as
a new version; what belongs to one batch or round replaces only its own
partition, so a job that runs again repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textgraph.sources.tables import SCORE_SCHEMA

LOG_COLUMNS = [
    "source_id", "call_name", "system_prompt", "human_prompt",
    "assistant_response", "created_at", "worker_id", "model_name",
]


def call_kind(call_name: Column) -> Column:
    """The name of a call up to its variable part."""
    return F.regexp_extract(call_name, r"^(n[0-9]+_[a-z]+_[a-z]+)", 1)


def append_call_log(rows: DataFrame, path: str) -> None:
    """One row per model call, partitioned by the kind of call.

    Call names carry class names, so the partition is the name up to its
    variable part: a bounded number of folders.
    """
    rows.select(*LOG_COLUMNS, call_kind(F.col("call_name")).alias("call_kind")).write.mode("append").partitionBy("call_kind").parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.select("source_id", "text", "gold_labels", "generated_labels").write.mode("append").parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """JSON-LD versions keyed by text and round; a round replaces itself."""
    rows.select("doc_id", "json_ld", "round").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("round").parquet(path)


def write_scores(scores: DataFrame, path: str, version: int) -> None:
    scores.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_scores(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).parquet(f"{path}/version={version}")


def write_report(results: DataFrame, scores: DataFrame, path: str) -> None:
    """Texts with their labels by id, and one score table per signal type."""
    results.orderBy("source_id").write.mode("overwrite").json(f"{path}/texts_and_labels")
    scores.orderBy("label").write.mode("overwrite").partitionBy("signal_type").option("header", "true").csv(
        f"{path}/scores"
    )


def read_report_scores(spark: SparkSession, path: str) -> DataFrame:
    schema = "label string, tp long, fp long, fn long, tn long, precision double, recall double, f1_score double, signal_type string"
    return spark.read.schema(schema).option("header", "true").csv(f"{path}/scores")


def write_turtle(lines: DataFrame, path: str) -> None:
    """Lines of a Turtle document in order; a large subject may span several files."""
    order = [c for c in ("part", "subject", "section", "name", "pos", "line") if c in lines.columns]
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
