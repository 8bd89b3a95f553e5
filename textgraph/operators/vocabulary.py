"""Class definitions: nested rows, short and compact forms, checks on them.

A definition is one row: class_id, label, uri, parents, comments and
properties (name, comments, ranges), each list in its order. Everything below
works inside that row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.functions import fixed

STRINGS = "array<string>"


def assemble_definitions(classes: DataFrame, comments: DataFrame, properties: DataFrame) -> DataFrame:
    """Nested definitions out of long tables.

    ``classes`` is (class_id, label, parent, pos), a row per parent;
    ``comments`` is (label, comment, pos); ``properties`` is (label, property,
    range, comment, pos), a row per range or comment. A value listed twice
    counts once, at its first place. A definition is as large as one page of a
    vocabulary, so its lists fit in a row.
    """
    def ordered(table: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
        first = table.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min("pos").alias("pos"))
        items = F.sort_array(F.collect_list(F.struct("pos", value)))
        return first.groupBy(*by).agg(F.transform(items, lambda i: i[value]).alias(name))

    key = ["label", "property"]
    named = (
        properties.groupBy(*key).agg(F.min("pos").alias("pos"))
        .join(ordered(properties, key, "comment", "comments"), key, "left")
        .join(ordered(properties, key, "range", "ranges"), key, "left")
    )
    item = F.struct("pos", F.col("property").alias("name"), "comments", "ranges")
    listed = named.groupBy("label").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return (
        classes.groupBy("label").agg(F.min("class_id").alias("class_id"))
        .join(ordered(classes, ["label"], "parent", "parents"), "label", "left")
        .join(ordered(comments, ["label"], "comment", "comments"), "label", "left")
        .join(listed, "label", "left")
        .select(
            "class_id", "label",
            F.concat(F.lit("https://schema.org/"), "label").alias("uri"),
            F.coalesce("parents", F.array().cast(STRINGS)).alias("parents"),
            F.col("comments"),
            F.transform(
                F.coalesce("items", F.array().cast("array<struct<pos:bigint,name:string,comments:array<string>,ranges:array<string>>>")),
                lambda p: F.struct(p["name"].alias("name"), p["comments"].alias("comments"), p["ranges"].alias("ranges")),
            ).alias("properties"),
        )
    )


def raw_definition() -> Column:
    """The full definition as JSON text."""
    return F.to_json(
        F.struct(
            "label", "uri", F.col("parents").alias("subClassOf"), "comments",
            F.transform(
                "properties",
                lambda p: F.struct(p["name"].alias("label"), p["comments"].alias("comments"), p["ranges"].alias("ranges")),
            ).alias("properties"),
        )
    )


def short_properties() -> Column:
    """Properties with a comment or a range; the others are dropped."""
    return F.filter("properties", lambda p: p["comments"].isNotNull() | p["ranges"].isNotNull())


def definition_short(definitions: DataFrame) -> DataFrame:
    """Label, parents, comments, and properties as name to comments and ranges."""
    kept = F.map_from_entries(
        F.transform(
            short_properties(),
            lambda p: F.struct(p["name"], F.struct(p["comments"].alias("comments"), p["ranges"].alias("ranges"))),
        )
    )
    some = F.when(F.size(short_properties()) > 0, kept)  # left out where none is left
    short = F.to_json(F.struct("label", F.col("parents").alias("subClassOf"), "comments", some.alias("properties")))
    return definitions.withColumn("short", short)


def property_category(p: Column) -> Column:
    """text, simple or complex; the name alone may explain a property."""
    ranges = F.coalesce(F.size(p["ranges"]), F.lit(0))
    plain = p["comments"].isNull() | (F.size(p["comments"]) == 0) | p["name"].isin(fixed.SELF_EXPLANATORY)
    return (
        F.when((ranges == 1) & plain & (p["ranges"][0] == "Text"), "text")
        .when((ranges == 1) & plain, "simple")
        .otherwise("complex")
    )


def categorised() -> Column:
    """Properties with their category; absent lists become empty ones."""
    return F.transform(
        "properties",
        lambda p: F.struct(
            p["name"].alias("name"),
            F.coalesce(p["comments"], F.array().cast(STRINGS)).alias("comments"),
            F.coalesce(p["ranges"], F.array().cast(STRINGS)).alias("ranges"),
            property_category(p).alias("category"),
        ),
    )


def property_rows(definitions: DataFrame) -> DataFrame:
    return definitions.select("label", F.inline(categorised()))


def _listed(items: Column) -> Column:
    """A list as ``['a', 'b']``."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def _lines(items: Column, indent: str) -> Column:
    return F.transform(items, lambda i: F.concat(F.lit(f"\n{indent}- "), i))


def definition_compact(definitions: DataFrame) -> DataFrame:
    """The compact text of a definition: one line per simple property, plain
    text properties together if there are more than five, sorted by name."""
    def property_text(p: Column) -> Column:
        comments, ranges = p["comments"], p["ranges"]
        told = ~p["name"].isin(fixed.SELF_EXPLANATORY)
        detail = F.concat(
            F.when(told & (F.size(comments) == 1), F.concat(F.lit("\n    comment: "), comments[0])).otherwise(""),
            F.when(told & (F.size(comments) > 1), F.concat(F.lit("\n    comments:"), F.array_join(_lines(comments, "      "), "")))
            .otherwise(""),
            F.when(F.size(ranges) == 1, F.concat(F.lit("\n    range: "), ranges[0])).otherwise(""),
            F.when(F.size(ranges) > 1, F.concat(F.lit("\n    ranges: "), _listed(ranges))).otherwise(""),
        )
        return (
            F.when(p["category"] != "complex", F.concat(F.lit("\n  "), p["name"], F.lit(": "), ranges[0]))
            .when(detail != "", F.concat(F.lit("\n  "), p["name"], F.lit(":"), detail))
            .otherwise("")
        )

    texts = F.filter("_p", lambda p: p["category"] == "text")
    together = F.size(texts) >= fixed.TEXT_LIST_FROM
    single = F.array_sort(F.filter("_p", lambda p: ~(together & (p["category"] == "text"))))
    body = F.concat(
        F.when(together, F.concat(F.lit("\n  _text: "), _listed(F.transform(texts, lambda p: p["name"])))).otherwise(""),
        F.array_join(F.transform(single, property_text), ""),
    )
    parents = F.when(F.size("parents") == 1, F.col("parents")[0]).when(F.size("parents") == 0, "[]").otherwise(
        _listed(F.col("parents"))
    )
    comments = (
        F.when(F.size("comments") == 1, F.concat(F.lit("\ncomment: "), F.col("comments")[0]))
        .when(F.size("comments") > 1, F.concat(F.lit("\ncomments:"), F.array_join(_lines(F.col("comments"), "  "), "")))
        .otherwise("")
    )
    compact = F.concat(
        F.lit("label: "), "label", F.lit("\nsubClassOf: "), parents, comments,
        F.when(F.col("_body") != "", F.concat(F.lit("\nproperties:"), F.col("_body"))).otherwise(""),
    )
    return definitions.withColumn("_p", categorised()).withColumn("_body", body).withColumn("compact", compact).drop("_p", "_body")


def missing_properties(definitions: DataFrame) -> DataFrame:
    """Properties of the full definition that the short one lacks."""
    full = definitions.select("label", F.explode("properties.name").alias("property"))
    short = definitions.select("label", F.explode(F.transform(short_properties(), lambda p: p["name"])).alias("property"))
    return full.distinct().join(short, ["label", "property"], "left_anti")


def unexpected_fields(definitions: DataFrame, raw: str = "raw") -> DataFrame:
    """Fields of a definition text outside the five known ones."""
    names = F.map_keys(F.from_json(raw, "map<string,variant>"))
    extra = F.array_except(names, F.array(*[F.lit(f) for f in fixed.DEFINITION_FIELDS]))
    return definitions.select("label", F.explode(extra).alias("field"))


def definition_sizes(definitions: DataFrame) -> DataFrame:
    """Characters of the full, short and compact text, and percent saved."""
    saved = lambda c: F.round((1 - F.length(c) / F.length("raw")) * 100, 6)
    return definitions.select(
        "label",
        F.length("raw").alias("full_chars"), F.length("short").alias("short_chars"), F.length("compact").alias("compact_chars"),
        saved("short").alias("short_saved"), saved("compact").alias("compact_saved"),
    )
