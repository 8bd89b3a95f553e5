"""Triples as Turtle lines, an ontology summary and a property profile.

Triples are (subject, node_type, predicate, object, is_literal, literal_type,
pos); ``pos`` orders the triples of a subject and is unique among them. Output
is one row per line with the columns that order it: a subject that holds a
third of all triples is then sorted and written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.functions import text
from textgraph.functions.joins import BROADCAST_BYTES, lookup_join
from textgraph.session import run_folder, stage

NUMERIC_TYPES = ["xsd:integer", "xsd:decimal", "xsd:double", "xsd:float", "xsd:int", "xsd:long"]


def prefixed(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(F.lit(":"), name))


def object_text() -> Column:
    quoted = F.concat(F.lit('"'), "object", F.lit('"'))
    typed = F.when(F.col("literal_type").isNotNull(), F.concat(quoted, F.lit("^^"), "literal_type")).otherwise(quoted)
    return F.when(F.col("is_literal"), typed).otherwise(F.col("object"))


def turtle_document(
    individuals: DataFrame, standalone: DataFrame | None = None, prefixes: dict[str, str] | None = None
) -> DataFrame:
    """All lines of a Turtle file: prefixes, blocks of subjects, lone triples.

    Adds ``part`` to the columns that order the lines.
    """
    spark = individuals.sparkSession
    heads = [f"@prefix {name}: <{uri}> ." for name, uri in (prefixes or {}).items()] + [""]
    columns = ["part", "subject", "section", "pos", "line"]
    out = spark.createDataFrame([(0, "", 0, i, h) for i, h in enumerate(heads)], "part int, subject string, section int, pos long, line string")
    out = out.unionByName(individuals.withColumn("part", F.lit(1)).select(*columns))
    if standalone is not None:
        out = out.unionByName(turtle_triples(standalone).withColumns({"part": F.lit(2), "section": F.lit(0)}).select(*columns))
    return out


def turtle_individuals(triples: DataFrame, folder: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Blocks per subject: types, then literals, then relations.

    Columns: subject, section, pos, line. Sections: 0 subject, 1 types,
    2 literals, 3 relations, 4 the lone full stop of a subject without lines,
    5 the empty line behind a block. A row without a predicate only states that
    its subject (and type) exists. The table of subjects is staged, as it is
    read three times.
    """
    stated = triples.filter("predicate IS NOT NULL").select(
        "subject",
        F.when(F.col("is_literal"), 2).otherwise(3).alias("section"),
        "pos",
        F.concat(F.lit("    "), prefixed(F.col("predicate")), F.lit(" "), object_text()).alias("body"),
    )
    # One row per subject: types are a set, the last place is one value.
    subjects = triples.groupBy("subject").agg(
        F.array_sort(F.collect_set("node_type")).alias("types"),
        F.max(
            F.when(
                F.col("predicate").isNotNull(),
                F.struct(F.when(F.col("is_literal"), 2).otherwise(3).alias("section"), "pos"),
            )
        ).alias("last"),
    )
    subjects = stage(subjects, f"{folder or run_folder(triples.sparkSession, 'subjects')}/subjects")
    ends = lookup_join(stated, subjects.select("subject", "last"), ["subject"], "inner", limit).select(
        "subject", "section", "pos",
        F.concat("body", F.when(F.struct("section", "pos") == F.col("last"), " .").otherwise(" ;")).alias("line"),
    )
    has_types, has_triples = F.size("types") > 0, F.col("last").isNotNull()
    type_line = F.concat(
        F.lit("    rdf:type "), F.array_join(F.transform("types", prefixed), ", "),
        F.when(has_triples, " ;").otherwise(" ."),
    )
    frame = F.array(
        F.struct(F.lit(0).alias("section"), F.col("subject").alias("line")),
        F.when(has_types, F.struct(F.lit(1).alias("section"), type_line.alias("line"))),
        F.when(~has_types & ~has_triples, F.struct(F.lit(4).alias("section"), F.lit("    .").alias("line"))),
        F.struct(F.lit(5).alias("section"), F.lit("").alias("line")),
    )
    framed = subjects.select("subject", F.inline(F.array_compact(frame))).select(
        "subject", "section", F.lit(0).cast("long").alias("pos"), "line"
    )
    return framed.unionByName(ends)


def turtle_triples(triples: DataFrame) -> DataFrame:
    """One line per triple that stands outside a block."""
    line = F.concat("subject", F.lit(" "), prefixed(F.col("predicate")), F.lit(" "), object_text(), F.lit(" ."))
    return triples.select("subject", "pos", line.alias("line"))


def object_properties(triples: DataFrame) -> DataFrame:
    """Distinct (name, domain, range) of relations whose object has a type.

    Repeats of an object are combined before the join, so a popular object is
    joined once per property and type.
    """
    used = triples.filter("NOT is_literal AND predicate IS NOT NULL").select(
        F.col("predicate").alias("name"), F.col("node_type").alias("domain"), "object"
    ).distinct()
    typed = triples.select(F.col("subject").alias("object"), F.col("node_type").alias("range")).distinct()
    return used.join(typed, "object").select("name", "domain", "range").distinct()


def datatype_properties(triples: DataFrame) -> DataFrame:
    return triples.filter("is_literal").select(
        F.col("predicate").alias("name"), F.col("node_type").alias("domain"),
        F.coalesce("literal_type", F.lit("xsd:string")).alias("range"),
    ).distinct()


def owl_summary(triples: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Classes and properties in use, as Turtle statements.

    Columns: section (1 classes, 2 object, 3 datatype properties), name, line.
    ``parents`` is (label, parent).
    """
    classes = triples.select(F.col("node_type").alias("label")).distinct()
    if parents is None:
        parents = triples.sparkSession.createDataFrame([], "label string, parent string")
    below = F.concat(F.lit(" ;\n         rdfs:subClassOf :"), "parent")
    class_lines = classes.join(parents, "label", "left").select(
        F.lit(1).alias("section"), F.col("label").alias("name"),
        F.concat(F.lit(":"), "label", F.lit(" rdf:type owl:Class"), F.coalesce(below, F.lit("")), F.lit(" .")).alias("line"),
    )

    def statement(kind: str, section: int, range_name: Column) -> list[Column]:
        return [
            F.lit(section).alias("section"), F.col("name"),
            F.concat(
                F.lit(":"), "name", F.lit(f" rdf:type owl:{kind} ;\n             rdfs:domain :"), "domain",
                F.lit(" ;\n             rdfs:range "), range_name, F.lit(" ."),
            ).alias("line"),
        ]

    objects = object_properties(triples).select(*statement("ObjectProperty", 2, F.concat(F.lit(":"), "range")))
    values = datatype_properties(triples).select(*statement("DatatypeProperty", 3, F.col("range")))
    return class_lines.unionByName(objects).unionByName(values)


def owl_document(summary: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """The lines of an ontology document: part, name, line.

    Prefixes come first (part 0, in their order), then the statements of
    ``owl_summary`` per section, each section behind an empty line.
    """
    heads = [(0, f"{n:06d}", f"@prefix {prefix}: <{uri}> .") for n, (prefix, uri) in enumerate(prefixes)]
    gaps = [(2 * section - 1, "", "") for section in (1, 2, 3)]
    framed = summary.sparkSession.createDataFrame(heads + gaps, "part int, name string, line string")
    return framed.unionByName(summary.select((F.col("section") * 2).alias("part"), "name", "line"))


def property_profile(triples: DataFrame) -> DataFrame:
    """Per node type and property: datatype, bounds, example, required, unique."""
    number = F.when(F.col("literal_type").isin(NUMERIC_TYPES), F.col("object").try_cast("double"))
    nodes = triples.groupBy("node_type").agg(F.count_distinct("subject").alias("nodes"))
    # Two counts of distinct values beside others would triple every fact; here
    # each is a sum over groups that were made first.
    facts = triples.filter("is_literal").withColumn("name", F.col("predicate"))
    per_value = facts.groupBy("node_type", "name", "object").agg(
        F.min(F.coalesce("literal_type", F.lit("xsd:string"))).alias("datatype"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n"),
    )
    values = per_value.groupBy("node_type", "name").agg(
        F.min("datatype").alias("datatype"), F.min("low").alias("min_value"), F.max("high").alias("max_value"),
        F.min("object").alias("example"), F.sum("n").alias("n"), F.count("object").alias("values"),
    )
    subjects = facts.select("node_type", "name", "subject").distinct().groupBy("node_type", "name").agg(
        F.count("subject").alias("with_it")
    )
    described = values.join(subjects, ["node_type", "name"])
    return described.join(nodes, "node_type").select(
        "node_type", "name", "datatype", "min_value", "max_value", "example",
        (F.col("with_it") == F.col("nodes")).alias("is_required"),
        (F.col("values") == F.col("n")).alias("is_unique"),
    )


def property_description() -> Column:
    """One property as text: name, type, example, bounds."""
    holds = lambda mark: F.contains(F.col("example"), F.lit(mark))
    quote = F.when(holds('"') & ~holds("'"), "'").otherwise('"')
    return F.concat_ws(
        " ",
        F.concat(F.lit("`"), "name", F.lit("`: "), "datatype"),
        F.concat(F.lit("Example: "), quote, "example", quote),
        F.concat(F.lit("Min: "), text.general_number(F.col("min_value"))),
        F.concat(F.lit("Max: "), text.general_number(F.col("max_value"))),
    )


def graph_description(
    nodes: DataFrame,
    edges: DataFrame | None = None,
    relationships: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """The schema of a property graph as lines.

    ``nodes`` and ``edges`` are property profiles (for edges, node_type is the
    edge type); ``relationships`` has a column ``pattern``. Columns: section,
    item, line_no, line; sections without rows are left out. Profiles are
    aggregates of all triples and are read several times, so they are staged.
    """
    folder = folder or run_folder(nodes.sparkSession, "description")
    kept = lambda df, name: None if df is None else stage(df, f"{folder}/{name}")
    nodes, edges, relationships = kept(nodes, "nodes"), kept(edges, "edges"), kept(relationships, "relationships")

    def profile_lines(profile: DataFrame, section: int, title: str, gap: bool) -> DataFrame:
        item = F.col("node_type").alias("item")
        head = profile.select(F.lit("").alias("item")).limit(1).select("item", F.lit("").alias("line_no"), F.lit(title).alias("line"))
        names = profile.select(item, F.lit("").alias("line_no"), F.concat(F.lit("- **"), "node_type", F.lit("**")).alias("line")).distinct()
        rows = profile.select(item, F.col("name").alias("line_no"), F.concat(F.lit("  - "), property_description()).alias("line"))
        out = head.unionByName(names).unionByName(rows)
        if gap:
            out = out.unionByName(head.select(F.lit("￿").alias("item"), "line_no", F.lit("").alias("line")))
        return out.select(F.lit(section).alias("section"), "item", "line_no", "line")

    out = profile_lines(nodes, 1, "Node properties:", gap=edges is not None or relationships is not None)
    if edges is not None:
        out = out.unionByName(profile_lines(edges, 2, "Relationship properties:", gap=relationships is not None))
    if relationships is not None:
        head = relationships.limit(1).select(F.lit(3).alias("section"), F.lit("").alias("item"), F.lit("").alias("line_no"), F.lit("The relationships:").alias("line"))
        rows = relationships.select(F.lit(3).alias("section"), F.lit("").alias("item"), F.col("pattern").alias("line_no"), F.col("pattern").alias("line"))
        out = out.unionByName(head).unionByName(rows)
    return out


def relationship_patterns(triples: DataFrame) -> DataFrame:
    return object_properties(triples).select(
        F.concat(F.lit("(:"), "domain", F.lit(")-[:"), "name", F.lit("]->(:"), "range", F.lit(")")).alias("pattern")
    )
