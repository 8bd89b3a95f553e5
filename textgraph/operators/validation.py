"""Validation of documents by joins with the vocabulary, and routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.functions import fixed
from textgraph.functions.joins import lookup_join, table_bytes
from textgraph.operators.hierarchy import covered, hierarchy
from textgraph.operators.jsonld import INVALID, minimal_document, nodes
from textgraph.session import run_folder, stage

ROOT_TYPE = "Thing"


@dataclass
class Vocabulary:
    """Staged lookup tables of one job.

    known (label, lo), the place of a class in its hierarchy; properties
    (property, ranges, domain, accepted), with the places of the classes that
    have a property and of those that it accepts as disjoint intervals; sizes, the
    bytes of each. Both are as large as what they come from, whatever the depth
    of the hierarchy.
    """

    known: DataFrame
    properties: DataFrame
    sizes: dict[str, int]
    usable: bool


def prepare_vocabulary(classes: DataFrame, properties: DataFrame, folder: str | None = None) -> Vocabulary:
    """Index the class hierarchy once and stage the tables.

    ``classes`` is (label, parent), one row per parent; ``properties`` is
    (class_label, property, range).
    """
    folder = folder or run_folder(classes.sparkSession, "vocabulary")
    properties = stage(properties.select("class_label", "property", "range").distinct(), f"{folder}/properties")
    index = hierarchy(classes, f"{folder}/hierarchy")
    known = stage(index.classes.filter("known").select("label", "lo"), f"{folder}/known")
    below = lambda column: covered(index, properties.select("property", F.col(column).alias("label")).distinct(), "property")
    ranges = properties.groupBy("property").agg(F.array_sort(F.collect_set("range")).alias("ranges"))
    table = ranges.join(below("class_label").withColumnRenamed("intervals", "domain"), "property", "left")
    table = stage(table.join(below("range").withColumnRenamed("intervals", "accepted"), "property", "left"), f"{folder}/tables")
    return Vocabulary(
        known, table, {"known": table_bytes(known), "properties": table_bytes(table)},
        usable=not known.isEmpty() and not table.isEmpty())


def errors_per_document(found: DataFrame, vocabulary: Vocabulary, keys: list[str]) -> DataFrame:
    """One row per document with its errors: keys, errors.

    ``found`` is the output of ``jsonld.nodes``. One pass over the objects and their
    entries: types are looked up once per object, not once per value. An object may
    have several types and needs one that fits, so an entry fails where all its
    types fail. Lookups in tables within the bound of a broadcast do not move the
    rows; beyond it each is one shuffle join. Only suspects and one root row per
    document are shuffled, once, by document.
    """
    def look(rows: DataFrame, kind: str, table: DataFrame, on: list[str], flag: str) -> DataFrame:
        return lookup_join(rows, table.withColumn(flag, F.lit(True)), on, "left", size=vocabulary.sizes[kind])

    via_ranges = vocabulary.properties.select(F.col("property").alias("via"), F.col("ranges").alias("via_ranges"))
    inferred = F.when(F.size("types") > 0, F.col("types")).when(F.col("via").isNull(), F.array(F.lit(ROOT_TYPE)))
    child = vocabulary.known.select(F.col("label").alias("child"), F.col("lo").alias("child_lo"))
    own = vocabulary.properties.select("property", "domain", F.col("accepted").alias("accepts"))
    inside = lambda place, intervals: F.when(
        F.exists(intervals, lambda i: F.col(place).between(i["lo"], i["hi"])), F.lit(True))  # null if not

    rows = look(found, "properties", via_ranges, ["via"], "_via")
    rows = rows.withColumn("types", F.coalesce(inferred, "via_ranges", F.array().cast("array<string>")))
    rows = rows.select(*keys, "path", "entries", "types", F.explode_outer("types").alias("label"))
    rows = look(rows, "known", vocabulary.known, ["label"], "type_known")
    rows = rows.select(*keys, "path", "types", "label", "lo", "type_known", F.inline("entries"))
    rows = look(rows, "properties", own, ["property"], "declared")
    rows = rows.withColumn("fits", inside("lo", "domain")).drop("domain", "lo")
    rows = rows.select("*", F.explode_outer("child_types").alias("child"))
    rows = look(rows, "known", child, ["child"], "child_known")
    rows = rows.withColumn("accepted", inside("child_lo", "accepts")).drop("accepts", "child_lo")

    known = F.col("declared").isNotNull() & ~F.col("property").startswith("@")
    flags = {
        "bad_type": (F.col("property") == "@type") & F.col("label").isNotNull() & F.col("type_known").isNull(),
        "bad_property": ~F.col("property").startswith("@") & F.col("declared").isNull(),
        "bad_domain": known & F.col("label").isNotNull() & F.col("fits").isNull(),
        "bad_range": known & F.col("child").isNotNull() & F.col("accepted").isNull(),
    }
    document = F.col("property").isNull() | (F.col("property") == INVALID)
    suspect = document
    for flag in flags.values():
        suspect = suspect | F.coalesce(flag, F.lit(False))
    suspects = rows.filter(suspect).withColumns({n: F.coalesce(f, F.lit(False)) for n, f in flags.items()})
    suspects = suspects.withColumn("bad", F.when(F.col("bad_type"), F.col("label")))

    # Where all types of an entry fail, all of them are among the suspects, each with
    # every child, so they can be counted, and whether each is known can be seen here.
    # Sums over distinct rows are hashed; sets would be sorted.
    entry = [*keys, "path", "property", "bad", "types", "child_types"]
    seen = suspects.repartition(*keys).select(
        *entry, "label", "child", "bad_property", "bad_domain", "bad_range",
        F.col("type_known").isNotNull().alias("type_known"), F.col("child_known").isNotNull().alias("child_known"),
    ).distinct()
    fails = lambda flag: F.sum(F.col(flag).cast("int"))
    per_entry = seen.groupBy(*entry).agg(
        F.bool_or("bad_property").alias("bad_property"),
        fails("bad_domain").alias("domain_fails"),
        fails("bad_range").alias("range_fails"),
        F.bool_and("type_known").alias("types_known"),
        F.bool_and("child_known").alias("children_known"),
    )
    error = lambda order, rule, value: F.struct(
        F.coalesce("path", F.lit("$")).alias("path"), F.lit(order).alias("n"),
        F.lit(rule).alias("rule"), value.alias("value"),
    )
    prop = F.col("property")
    pairs = F.greatest(F.size("types"), F.lit(1)) * F.greatest(F.size("child_types"), F.lit(1))
    all_types = F.col("types_known") & (F.col("domain_fails") == pairs)
    all_children = F.col("types_known") & F.col("children_known") & (F.col("range_fails") == pairs)
    errors = F.array_compact(
        F.array(
            F.when(prop == INVALID, error(1, "json", F.lit("invalid"))),
            F.when(F.col("bad").isNotNull(), error(2, "type", F.col("bad"))),
            F.when(F.col("bad_property"), error(3, "property", prop)),
            F.when(all_types, error(4, "domain", prop)),
            F.when(all_children, error(5, "range", prop)),
        )
    )
    return per_entry.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(errors)))).alias("errors")
    )


def jsonld_validate(
    docs: DataFrame, vocabulary: Vocabulary, keys: list[str] = ("doc_id",), partitions: int | None = None
) -> DataFrame:
    """Code and output per document.

    Code 0 is valid, 1 has errors, 2 means that there is no vocabulary to
    check against. The output has a line ``path rule value`` per error.
    """
    keys = list(keys)
    if not vocabulary.usable:
        return docs.select(*keys, F.lit(2).alias("code"), F.lit("no vocabulary").alias("output"))
    found = errors_per_document(nodes(docs, keys, partitions), vocabulary, keys)
    line = lambda e: F.concat_ws(" ", e["path"], e["rule"], e["value"])
    return found.select(
        *keys,
        F.when(F.size("errors") > 0, 1).otherwise(0).alias("code"),
        F.array_join(F.transform("errors", line), "\n").alias("output"),
    )


def attempt_state(attempts: DataFrame, max_runs: int = fixed.MAX_RUNS) -> DataFrame:
    """Runs and flags after a validation; needs ``runs`` before it and ``code``."""
    runs = F.when(F.col("code") == 1, F.col("runs") + 1).otherwise(F.col("runs"))
    return (
        attempts.withColumn("max_reached", (F.col("code") == 1) & (runs >= max_runs))
        .withColumn("infrastructure_error", F.col("code") == 2)
        .withColumn("runs", runs)
    )


def route_outcome() -> Column:
    """Where a document goes: label, halt or repair. The order of the cases counts."""
    return (
        F.when(F.col("code") == 0, "label")
        .when(F.col("infrastructure_error"), "halt")
        .when((F.col("code") == 1) & ~F.col("max_reached"), "repair")
        .otherwise("label")
    )


def failed_branch(parsed: DataFrame) -> DataFrame:
    """Final rows of texts whose extraction failed: the minimal document, taken
    as valid, with the label for "nothing fits"."""
    return parsed.filter("extraction_failed AND reject_reason IS NULL").select(
        "doc_id",
        minimal_document().alias("json_ld"),
        F.lit(0).alias("code"),
        F.lit(fixed.SKIPPED_VALIDATION).alias("output"),
        F.lit(fixed.NO_LABEL).alias("label"),
    )
