"""Prompt texts as projections over stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.functions import fixed, templates, text
from textgraph.functions.joins import lookup_join, row_join


def embed_text(class_name: Column, description: Column) -> Column:
    return text.strip(F.concat(F.lit("Class: "), class_name, F.lit("\nDescription: "), description))


def extract_prompt(texts: DataFrame, template: str = templates.EXTRACT_HUMAN) -> DataFrame:
    return texts.withColumn("human_prompt", text.fill(template, INPUT_TEXT=F.col("text")))


def candidate_lines(candidates: Column) -> Column:
    """Numbered candidates, best first, as lines; the array is in rank order."""
    comment = lambda c: F.coalesce(F.nullif(c["comments"], F.lit("")), F.lit(fixed.NO_DESCRIPTION))
    return F.array_join(
        F.transform(
            candidates,
            lambda c: F.concat(c["rank"].cast("string"), F.lit(". "), c["class_label"], F.lit(": "), comment(c)),
        ),
        "\n",
    )


def select_prompt(mentions: DataFrame, template: str = templates.SELECT_HUMAN) -> DataFrame:
    """Needs text, name, class_name, description and candidates."""
    return mentions.withColumn(
        "human_prompt",
        text.fill(
            template,
            ORIGINAL_TEXT=F.col("text"),
            ENTITY_NAME=F.col("name"),
            CLASS_NAME=F.col("class_name"),
            DESCRIPTION=F.col("description"),
            SCHEMA_CANDIDATES=candidate_lines(F.col("candidates")),
        ),
    )


def relations_text(relations: Column) -> Column:
    """Relations as lines with arrows, or the sentence that there are none."""
    lines = F.transform(
        relations,
        lambda r: F.concat(F.lit("- "), r["subject"], F.lit(" → "), r["predicate"], F.lit(" → "), r["object"]),
    )
    return F.when(F.size(relations) > 0, F.array_join(lines, "\n")).otherwise(F.lit(fixed.NO_RELATIONS))


def schema_block(label: Column, names: Column, compact: Column, rendered: Column) -> Column:
    """Head, users and fenced definition of one class.

    ``rendered`` is false where the definition could not be rendered; its raw
    text is shown then, without the language of the fence.
    """
    users = F.when(
        F.size(names) > 0,
        F.concat(
            F.lit("\n" + fixed.SCHEMA_USERS + "\n"),
            F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n)), "\n"),
        ),
    )
    return F.concat(
        text.fill(fixed.SCHEMA_HEAD, LABEL=label),
        F.coalesce(users, F.lit("")),
        F.when(rendered, "\n\n```yaml\n").otherwise("\n\n```\n"),
        compact,
        F.lit("\n```"),
    )


def schema_blocks(mapping: DataFrame, entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """All definition blocks of a text, in the order of its classes.

    ``mapping`` is (doc_id, class_name, schema_label, pos), ``entities`` is the
    output of ``entities_per_class`` and ``definitions`` holds (label, compact,
    raw). The compact text is made once per class and joined here.
    """
    used = row_join(mapping, entities.select("doc_id", "class_name", "names"), ["doc_id", "class_name"], "left")
    defined = definitions.select(F.col("label").alias("schema_label"), "compact", "raw")
    rendered = F.col("compact").isNotNull()
    block = schema_block(
        F.when(rendered, F.col("schema_label")).otherwise(F.col("class_name")),
        F.coalesce(F.col("names"), F.array().cast("array<string>")),
        F.coalesce(F.col("compact"), F.col("raw")),
        rendered,
    )
    blocks = lookup_join(used, defined, ["schema_label"], "inner").withColumn("block", block)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "block")))
    return blocks.filter("block IS NOT NULL").groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("schema_blocks")
    )


def transform_prompt(
    docs: DataFrame, template: str = templates.TRANSFORM_HUMAN, rerun: str = templates.RERUN
) -> DataFrame:
    """Prompt of a round. Needs text, schema_blocks, relations, runs and, for a
    rerun, previous_json_ld and previous_output of the round before."""
    again = F.when(
        F.col("runs") > 0,
        text.fill(
            rerun,
            PREVIOUS_JSON_LD=F.col("previous_json_ld"),
            VALIDATION_OUTPUT=F.coalesce("previous_output", F.lit(fixed.NO_VALIDATION_OUTPUT)),
        ),
    )
    whole = text.fill(
        template,
        INPUT_TEXT=F.col("text"),
        SCHEMA_DEFINITIONS=F.col("schema_blocks"),
        EXTRACTED_RELATIONS=relations_text(F.col("relations")),
        RERUN=again,
    )
    return docs.withColumn("human_prompt", text.strip(whole))


def label_prompt(texts: DataFrame, offered: DataFrame, template: str = templates.LABEL_HUMAN) -> DataFrame:
    """Prompt with both label lists; the lists are two scalar values.

    ``offered`` comes from ``labels.offered_labels``.
    """
    def listing(signal: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct("added", "main_topic", "pos", "label")))
        return (
            offered.filter(F.col("signal_type") == signal)
            .agg(F.array_join(F.transform(ordered, lambda o: o["label"]), "\n").alias("v")).scalar()
        )

    return texts.withColumn(
        "human_prompt",
        text.fill(
            template,
            ONDERWERP_LIST=listing(fixed.ONDERWERP),
            BELEVING_LIST=listing(fixed.BELEVING),
            INPUT_TEXT=F.col("text"),
        ),
    )
