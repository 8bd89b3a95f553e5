"""A training corpus from documents: language, near-duplicates, benchmark passages, personal data, mix.

Every stage takes what the one before it kept, as a written table, and returns a
DataFrame. Documents go if they have no language (no letter), if they are not the
one that stays of their near-duplicates, or if they hold a benchmark passage;
personal data is masked in the text; the mix repeats and leaves out documents by
their source's rate. All but the last return the columns of documents.

In every stage a null or empty text counts as one without words, rows repeated with
one id are judged as the stage's operator says, other columns go along unread, and
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgraph.llm import decontaminate, language, minhash, mixing, pii
from textgraph.session import run_folder, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a null ``lang`` becomes the predicted one, another stays. Null and empty texts go."""
    return language.known(docs, language.fit(docs.select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; texts without words and rows without an id stay."""
    return minhash.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; with an empty benchmark all."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text."""
    masked = pii.masked(docs)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return masked.select(*(chars.alias(c) if c == "n_chars" else F.col(c) for c in masked.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, numbered in ``copy``."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents."""
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
