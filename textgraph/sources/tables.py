"""Sources: labelled texts, the class store, the taxonomy, resumed slices."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from textgraph.functions import fixed
from textgraph.sources.csv_records import RANGE_BYTES, read_csv

TAXONOMY_SCHEMA = "main_topic string, sub_topic string, pos long"
RESULT_SCHEMA = "id long, text string, gold_labels array<string>, generated_labels array<string>"
SCORE_SCHEMA = "signal_type string, label string, tp long, fp long, fn long, tn long"


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files of a format; a CSV file is one task, since its cells may hold line breaks."""
    if fmt == "csv":
        options = {"header": "true", "escape": '"', "multiLine": "true", **options}
    return spark.read.format(fmt).options(**options).load(path)


def pick_labelled(df: DataFrame, text_column: str, labels_column: str, keep: list[str] = ()) -> DataFrame:
    """Check two named columns, rename them to text and gold_labels, drop the rest."""
    missing = [c for c in (text_column, labels_column) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}; available: {', '.join(df.columns)}")
    return df.select(
        *keep, F.col(text_column).alias("text"), F.col(labels_column).alias("gold_labels")
    )


def read_labelled(
    spark: SparkSession,
    path: str,
    text_column: str = fixed.TEXT_COLUMN,
    labels_column: str = fixed.LABELS_COLUMN,
    fmt: str = "parquet",
    keep: list[str] = (),
    range_bytes: int = RANGE_BYTES,
    **options: str,
) -> DataFrame:
    """A labelled dataset; only the named columns are read from the files.

    CSV files are read in ranges, unless an option of their form (other escapes,
    another encoding, line ends or comments) leaves them to Spark's reader.
    """
    if fmt == "csv" and not {"multiLine", "escape", "encoding", "charset", "lineSep", "comment", "schema"} & set(options):
        files = read_csv(spark, path, range_bytes, **options)
    else:
        files = read_files(spark, path, fmt, **options)
    return pick_labelled(files, text_column, labels_column, keep)


def resume_slice(source: DataFrame, results: DataFrame, limit: int | None, source_id: str = "id") -> DataFrame:
    """The first ``limit`` rows by id of those whose id is not stored; None: all.

    A text that arrives late with a small id is still taken. With a limit the
    ids alone, not the texts, are searched for the last id of the slice.
    """
    stored = results.select(F.col("source_id").alias(source_id)).distinct()
    rest = source.join(stored, source_id, "left_anti")
    if limit is None:
        return rest
    last = rest.select(source_id).orderBy(source_id).limit(limit).agg(F.max(source_id)).first()[0]
    return rest.filter(F.col(source_id) <= last if last is not None else F.lit(False))


def class_store(df: DataFrame) -> DataFrame:
    """Label, comments and vector; the definition text stays in the files."""
    return df.select("class_id", "class_label", "comments", "embedding")


def read_taxonomy(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """Main and sub topics with their place in the file; no file, no rows.

    A taxonomy is one small file; the place is its line order.
    """
    empty = spark.createDataFrame([], TAXONOMY_SCHEMA)
    try:
        raw = read_files(spark, path, fmt, **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    named = raw.withColumnsRenamed(fixed.TAXONOMY_COLUMNS)
    if "pos" not in named.columns:
        named = named.withColumn("pos", F.monotonically_increasing_id())
    return named.select("main_topic", "sub_topic", F.col("pos").cast("long"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one of the same shape."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
