"""From entity classes to vocabulary classes, for a whole table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgraph.functions.joins import lookup_join
from textgraph.operators.extraction import first_per_class
from textgraph.operators.lookup import one_definition_per_label, semantic_topk
from textgraph.operators.model_calls import choice_or_first
from textgraph.operators.prompts import embed_text
from textgraph.session import run_folder, stage

KEYS = ["doc_id", "class_name"]


def class_mentions(parsed: DataFrame) -> DataFrame:
    """One row per text and class: its first entity and the text to embed."""
    return first_per_class(parsed).withColumn("embed_text", embed_text(F.col("class_name"), F.col("description")))


def with_candidates(mentions: DataFrame, vectors: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Candidates for each mention.

    ``vectors`` has one row per distinct text; each is compared with the class
    store once for the whole table, however often the text occurs. The result
    is staged, then joined back: broadcast if small, else with the mentions of
    a frequent text spread by a salt.
    """
    nearest = stage(semantic_topk(vectors, classes).select("embed_text", "candidates"), f"{folder}/candidates")
    return lookup_join(mentions, nearest, ["embed_text"], "inner")


def resolve_classes(with_topk: DataFrame, definitions: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """The vocabulary class of each mention: doc_id, class_name, pos, schema_label, fell_back.

    A choice counts if its class has a definition; else the first candidate is
    taken. A mention whose class has no definition even so is dropped.
    """
    labels = definitions.select(F.col("label").alias("schema_label")).distinct()
    if choices is None:
        resolved = with_topk.withColumn("schema_label", F.get("candidates", F.lit(0))["class_label"]).withColumn(
            "fell_back", F.lit(True)
        )
    else:
        usable = lookup_join(
            choices.filter("answer IS NOT NULL").withColumn("schema_label", F.col("answer.selected_class")),
            labels, ["schema_label"], "left_semi",
        )
        resolved = choice_or_first(with_topk, usable, KEYS)
    return lookup_join(
        resolved.select(*KEYS, "pos", "schema_label", "fell_back"), labels, ["schema_label"], "left_semi"
    )


def schema_mapping(
    parsed: DataFrame,
    classes: DataFrame,
    vectors: DataFrame,
    definitions: DataFrame,
    choices: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """All steps, ending in the definition of each class of a text.

    ``parsed`` is the output of ``extraction``, best as a stage table;
    ``definitions`` has class_id, label and any definition columns.
    """
    folder = folder or run_folder(parsed.sparkSession, "mapping")
    topk = with_candidates(class_mentions(parsed), vectors, classes, folder)
    resolved = resolve_classes(topk, definitions, choices)
    found = one_definition_per_label(definitions).withColumnRenamed("label", "schema_label")
    return lookup_join(resolved, found, ["schema_label"], "inner")
