"""Scores that grow with arriving files; a text that comes again counts with its last version."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from textgraph.operators.scoring import COUNTS, confusion_counts, quality_scores
from textgraph.session import stage
from textgraph.sources.tables import read_or_empty

DELTA_SCHEMA = "signal_type string, label string, tp long, fp long, fn long, tn long, batch_id long"
BUCKETS = 256
STORE = "spark.sql.streaming.stateStore.providerClass"
STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def text_files(
    spark: SparkSession, path: str, schema: str, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def by_file() -> Column:
    """The version of a row by the file it came in, the later one last, and its place there."""
    return F.struct(F.unix_micros("_metadata.file_modification_time"), "_metadata.file_name", "_metadata.row_index")


class LastVersions(StatefulProcessor):
    """The last version of each text of a bucket, and what that changes: the old row is taken back, the new one added.

    A call into the state costs far more than a row, so it is made once a bucket.
    """

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "rows string")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        came: dict[str, tuple] = {}
        for _, id_, version, row in rows:
            now = (tuple(json.loads(version).values()), row)
            if id_ not in came or came[id_] < now:
                came[id_] = now
        kept = json.loads((self.last.get() or ("{}",))[0])
        for id_, (version, row) in came.items():
            old = kept.get(id_)
            if old is None or (tuple(old[0]), old[1]) < (version, row):
                kept[id_] = (version, row)
                if old is None or old[1] != row:
                    if old is not None:
                        yield Row(sign=-1, row=old[1])
                    yield Row(sign=1, row=row)
        self.last.update((json.dumps(kept),))

    def close(self) -> None:
        pass


def last_versions(texts: DataFrame, version: Column | None = None, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes: the columns of the texts and ``sign``, 1 for a row that counts now, -1 for one that no longer does.

    The state holds the last row per id, in buckets of ids that are read and
    written whole: give as many that one has some hundred ids, and leave out
    columns that are not counted by. A stream goes on with the buckets that it
    began with. Versions are numbers, texts, or structs of these. Of equal ones the
    greater row (as JSON) is the last; an older version that comes late changes
    nothing; rows without an id are left out.
    """
    row = F.to_json(F.struct(*texts.columns), {"ignoreNullFields": "false"})
    version = by_file() if version is None else F.struct(version)
    keyed = texts.filter(F.col(key).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("id"),
        F.to_json(version, {"ignoreNullFields": "false"}).alias("version"), row.alias("row"))
    changes = keyed.groupBy("bucket").transformWithState(
        statefulProcessor=LastVersions(), outputStructType="sign int, row string", outputMode="Update", timeMode="None")
    return changes.select("sign", F.from_json("row", texts.schema).alias("row")).select("row.*", "sign")


def evaluate_incremental(
    texts: DataFrame,
    labelled: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    taxonomy: DataFrame,
    signals: DataFrame,
    folder: str,
    version: Column | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Score all files that arrived since the last run and return all scores.

    ``labelled(batch)`` gives the gold and the generated rows (doc_id,
    signal_type, label) of a batch of texts. An id counts once: with its greatest
    ``version`` (None: the last file that holds it), the counts of the version
    before are taken back. The changes and counts of a batch replace the
    partition of its batch id, so a batch that runs again after a failure adds
    nothing, and a restart goes on behind the last finished batch. A batch
    leaves one row per label and the rows that changed.
    """
    spark = texts.sparkSession

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        gold, generated = labelled(rows)
        counts = confusion_counts(gold, generated, rows, taxonomy, signals)
        return counts.select("signal_type", "label", *((sign * F.col(c)).alias(c) for c in COUNTS))

    def score(batch: DataFrame, batch_id: int) -> None:
        changes = stage(batch, f"{folder}/changes/batch_id={batch_id}")  # the state is read once
        sides = {s: changes.filter(F.col("sign") == s).drop("sign") for s in (1, -1)}
        delta = counted(sides[1], 1)
        if not sides[-1].isEmpty():
            both = delta.unionByName(counted(sides[-1], -1))
            delta = both.groupBy("signal_type", "label").agg(*[F.sum(c).alias(c) for c in COUNTS])
        delta.write.mode("overwrite").parquet(f"{folder}/deltas/batch_id={batch_id}")

    changes = last_versions(texts, version, buckets=buckets)
    store = spark.conf.get(STORE)
    spark.conf.set(STORE, STORE_CLASS)  # keyed state needs it; a query keeps the one it started with
    try:
        query = (
            changes.writeStream.foreachBatch(score).outputMode("update")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, store)
    return total_scores(spark, folder)


def total_scores(spark: SparkSession, folder: str) -> DataFrame:
    deltas = read_or_empty(spark, f"{folder}/deltas", DELTA_SCHEMA)
    counts = deltas.groupBy("signal_type", "label").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return quality_scores(counts)
