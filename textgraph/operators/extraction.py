"""Parsing of extraction answers into summary, entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.functions import fixed, text
from textgraph.functions.joins import row_join
from textgraph.session import spread

ENTITY = "array<struct<pos:bigint,name:string,class_name:string,description:string>>"
RELATION = "array<struct<pos:bigint,subject:string,predicate:string,object:string>>"
ENTITY_FIELDS = ["name", "class_name", "description"]
RELATION_FIELDS = ["subject", "predicate", "object"]


def sections(answers: DataFrame, response: str = "response", partitions: int | None = None, by: str = "doc_id") -> DataFrame:
    """Summary (stripped), entity and relation sections of each answer."""
    c = F.col(response)
    return spread(answers, partitions, by).withColumns({
        "summary": text.strip(text.section(c, fixed.SUMMARY_TAG)),
        "entity_section": text.section(c, fixed.ENTITY_TAG),
        "relation_section": text.section(c, fixed.RELATION_TAG),
    })


def extraction(answers: DataFrame, response: str = "response") -> DataFrame:
    """Parsed answers: summary, entities, relations, extraction_failed, reject_reason.

    If any of the three is empty the extraction failed and all three are
    emptied. An empty answer is an error of the call, not a failed extraction.
    """
    unanswered = F.coalesce(F.col(response), F.lit("")) == ""
    found = sections(answers, response)
    failed = (F.col("summary") == "") | ~text.has_rows(F.col("entity_section")) | ~text.has_rows(F.col("relation_section"))

    def parsed(name: str, fields: list[str], kind: str) -> Column:
        rows = text.rows_of_three(F.col(name), fields)
        return F.when(F.col("extraction_failed"), F.array().cast(kind)).otherwise(rows)

    return (
        found.withColumn("extraction_failed", F.coalesce(failed, F.lit(True)))
        .withColumns({
            "summary": F.when(F.col("extraction_failed"), "").otherwise(F.col("summary")),
            "entities": parsed("entity_section", ENTITY_FIELDS, ENTITY),
            "relations": parsed("relation_section", RELATION_FIELDS, RELATION),
            "reject_reason": F.when(unanswered, "no response"),
        })
        .drop("entity_section", "relation_section")
    )


def entity_rows(parsed: DataFrame) -> DataFrame:
    """One row per entity: doc_id, pos, name, class_name, description.

    The outer form keeps Spark from parsing a cell twice, once to see whether
    its list is empty.
    """
    return parsed.select("doc_id", F.inline_outer("entities")).filter("pos IS NOT NULL")


def _by_class(parsed: DataFrame) -> DataFrame:
    """Entities of a text sorted by class and place, and where each class starts.

    All entities of a text are in its row, so this needs no shuffle.
    """
    ordered = F.sort_array(
        F.transform("entities", lambda e: F.struct(e["class_name"], e["pos"], e["name"], e["description"]))
    )
    changes = F.transform(
        "_sorted",
        lambda e, i: F.when((i == 0) | (F.get("_sorted", i - 1)["class_name"] != e["class_name"]), i),
    )
    return parsed.select("doc_id", ordered.alias("_sorted")).select("doc_id", "_sorted", F.array_compact(changes).alias("_starts"))


def first_per_class(parsed: DataFrame) -> DataFrame:
    """The first entity of each class in a text: doc_id, class_name, pos, name, description."""
    firsts = F.transform("_starts", lambda i: F.get("_sorted", i))
    return _by_class(parsed).select("doc_id", F.inline_outer(firsts)).filter("pos IS NOT NULL")


def entities_per_class(parsed: DataFrame) -> DataFrame:
    """Names per class and text, in text order: doc_id, class_name, pos, names."""
    def part(start: Column, n: Column) -> Column:
        end = F.coalesce(F.get("_starts", n + 1), F.size("_sorted"))
        first = F.get("_sorted", start)
        members = F.slice("_sorted", start + 1, end - start)
        return F.struct(
            first["class_name"].alias("class_name"), first["pos"].alias("pos"),
            F.transform(members, lambda e: e["name"]).alias("names"),
        )

    return _by_class(parsed).select("doc_id", F.inline_outer(F.transform("_starts", part))).filter("pos IS NOT NULL")


def entities_with_schema(parsed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities whose class got a definition, grouped per class."""
    mapped = mapping.select("doc_id", "class_name").distinct()
    return row_join(entities_per_class(parsed), mapped, ["doc_id", "class_name"], "left_semi")
