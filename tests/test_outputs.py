"""Definitions, Turtle, profiles, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from textgraph.operators import graph_output as go, vocabulary as vo
from textgraph.sources import sinks, tables


@pytest.fixture(scope="module")
def definitions(spark):
    classes = [(1, "Person", "Thing", 1), (2, "Thing", None, 1), (3, "Mix", "B", 2), (3, "Mix", "A", 1)]
    comments = [("Person", "A person.", 1), ("Mix", "one", 1), ("Mix", "two", 2)]
    properties = [
        ("Person", "zeta", "Number", None, 1), ("Person", "email", "Text", "explained by its name", 2), ("Person", "image", "URL", "so is this", 3),
        ("Person", "knows", "Person", "who", 4), ("Person", "knows", "Organization", "whom", 5), ("Person", "bare", None, None, 6),
        ("Person", "told", None, "only told", 7), ("Person", "logo", None, "dropped comment", 8),
    ] + [("Mix", f"t{i}", "Text", None, 10 - i) for i in range(6)] + [("Mix", "n", "Number", None, 20)]
    return vo.assemble_definitions(
        spark.createDataFrame(classes, "class_id long, label string, parent string, pos long"),
        spark.createDataFrame(comments, "label string, comment string, pos long"),
        spark.createDataFrame(properties, "label string, property string, range string, comment string, pos long"),
    )


def test_compact(definitions):
    got = {r["label"]: r["compact"] for r in vo.definition_compact(definitions).collect()}
    assert got["Thing"] == "label: Thing\nsubClassOf: []"
    assert got["Person"] == (
        "label: Person\nsubClassOf: Thing\ncomment: A person.\nproperties:\n  email: Text\n  image: URL\n"
        "  knows:\n    comments:\n      - who\n      - whom\n    ranges: ['Person', 'Organization']\n"
        "  told:\n    comment: only told\n  zeta: Number"
    )
    assert got["Mix"] == (
        "label: Mix\nsubClassOf: ['A', 'B']\ncomments:\n  - one\n  - two\nproperties:\n"
        "  _text: ['t5', 't4', 't3', 't2', 't1', 't0']\n  n: Number"
    )


def test_five_text_properties_are_not_listed(spark):
    made = vo.assemble_definitions(
        spark.createDataFrame([(1, "C", "Thing", 1)], "class_id long, label string, parent string, pos long"),
        spark.createDataFrame([], "label string, comment string, pos long"),
        spark.createDataFrame([("C", f"t{i}", "Text", None, i) for i in range(5)], "label string, property string, range string, comment string, pos long"),
    )
    assert "_text" not in vo.definition_compact(made).first()["compact"]


def test_short_and_missing(definitions):
    got = {r["label"]: r["short"] for r in vo.definition_short(definitions).collect()}
    assert got["Thing"] == '{"label":"Thing","subClassOf":[]}'
    assert '"knows":{"comments":["who","whom"],"ranges":["Person","Organization"]}' in got["Person"] and "bare" not in got["Person"]
    assert [tuple(r) for r in vo.missing_properties(definitions).collect()] == [("Person", "bare")]


def test_unexpected_fields(spark):
    raw = spark.createDataFrame([("a", '{"label":"a","uri":"u","extra":1}'), ("b", '{"comments":[]}')], "label string, raw string")
    assert [tuple(r) for r in vo.unexpected_fields(raw).collect()] == [("a", "extra")]


TRIPLE = "subject string, node_type string, predicate string, object string, is_literal boolean, literal_type string, pos long"


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame([
        ("ex:a", "P", "name", "A", True, None, 1), ("ex:a", "P", "age", "3", True, "xsd:integer", 2), ("ex:a", "P", "ex:knows", "ex:b", False, None, 3),
        ("ex:b", "P", "name", "say \"hi\"", True, None, 1), ("ex:b", "ex:Q", "age", "12", True, "xsd:integer", 2),
        ("ex:c", "P", None, None, None, None, 1), ("ex:d", None, None, None, None, None, 1),
    ], TRIPLE)


LINES = [
    "ex:a", "    rdf:type :P ;", '    :name "A" ;', '    :age "3"^^xsd:integer ;', "    ex:knows ex:b .", "",
    "ex:b", "    rdf:type :P, ex:Q ;", '    :name "say "hi"" ;', '    :age "12"^^xsd:integer .', "",
    "ex:c", "    rdf:type :P .", "", "ex:d", "    .", "",
]


@pytest.mark.parametrize("limit", [10**6, 100])
def test_turtle(spark, triples, folder, limit):
    lines = go.turtle_individuals(triples, limit=limit)
    assert [r["line"] for r in lines.orderBy("subject", "section", "pos").collect()] == LINES
    sinks.write_turtle(lines, f"{folder}/turtle")
    assert [r["value"] for r in spark.read.text(f"{folder}/turtle").collect()] == LINES


def test_turtle_document(spark, triples, folder):
    one = triples.filter("subject = 'ex:c'")
    lines = go.turtle_document(go.turtle_individuals(one), triples.filter("subject = 'ex:a' AND pos = 1"), {"ex": "http://e/"})
    sinks.write_turtle(lines, f"{folder}/turtle")
    assert [r["value"] for r in spark.read.text(f"{folder}/turtle").collect()] == [
        "@prefix ex: <http://e/> .", "", "ex:c", "    rdf:type :P .", "", 'ex:a :name "A" .',
    ]


def test_lone_triples(triples):
    got = {r["line"] for r in go.turtle_triples(triples.filter("subject = 'ex:a'")).collect()}
    assert got == {'ex:a :name "A" .', 'ex:a :age "3"^^xsd:integer .', "ex:a ex:knows ex:b ."}


def test_ontology(spark, triples):
    parents = spark.createDataFrame([("P", "Thing")], "label string, parent string")
    got = {r["line"] for r in go.owl_summary(triples.filter("node_type = 'P'"), parents).collect()}
    assert got == {
        ":P rdf:type owl:Class ;\n         rdfs:subClassOf :Thing .",
        ":ex:knows rdf:type owl:ObjectProperty ;\n             rdfs:domain :P ;\n             rdfs:range :P .",
        ":name rdf:type owl:DatatypeProperty ;\n             rdfs:domain :P ;\n             rdfs:range xsd:string .",
        ":age rdf:type owl:DatatypeProperty ;\n             rdfs:domain :P ;\n             rdfs:range xsd:integer .",
    }


def test_profile_and_description(triples):
    profile = go.property_profile(triples.filter("node_type = 'P'"))
    got = {r["name"]: r.asDict() for r in profile.collect()}
    assert got["age"]["min_value"] == 3.0 and got["age"]["datatype"] == "xsd:integer" and not got["age"]["is_required"]
    assert got["name"]["min_value"] is None and got["name"]["is_unique"] and not got["name"]["is_required"]
    lines = go.graph_description(profile, relationships=go.relationship_patterns(triples.filter("node_type = 'P'")))
    assert [r["line"] for r in lines.orderBy("section", "item", "line_no").collect()] == [
        "Node properties:", "- **P**", '  - `age`: xsd:integer Example: "3" Min: 3 Max: 3', '  - `name`: xsd:string Example: "A"', "",
        "The relationships:", "(:P)-[:ex:knows]->(:P)",
    ]


def test_example_quotes(spark):
    rows = spark.createDataFrame([('a "b"',), ("it's \"b\"",), ("plain",)], "example string").withColumns({
        "name": F.lit("n"), "datatype": F.lit("t"), "min_value": F.lit(None).cast("double"), "max_value": F.lit(None).cast("double")
    })
    assert [r[0] for r in rows.select(go.property_description()).collect()] == [
        "`n`: t Example: 'a \"b\"'", "`n`: t Example: \"it's \"b\"\"", '`n`: t Example: "plain"'
    ]


def test_read_labelled(spark, folder):
    rows = spark.createDataFrame([("t, \"q\"\nline", "a; b", 1), ("u", None, 2)], "body string, tags string, other int")
    for fmt in ("parquet", "json", "csv", "orc"):
        path = f"{folder}/{fmt}"
        writer = rows.write.format(fmt)
        (writer.option("header", "true").option("escape", '"') if fmt == "csv" else writer).save(path)
        read = tables.read_labelled(spark, path, "body", "tags", fmt)
        assert read.columns == ["text", "gold_labels"]
        assert sorted(map(tuple, read.collect()), key=repr) == [("t, \"q\"\nline", "a; b"), ("u", None)]
        with pytest.raises(ValueError, match="columns not found: nothing; available: .*body"):
            tables.read_labelled(spark, path, "nothing", "tags", fmt)


def test_resume(spark):
    source = spark.range(10).withColumnRenamed("id", "id")
    stored = spark.createDataFrame([(3,), (1,)], "source_id long")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert sorted(ids(tables.resume_slice(source, stored, 4))) == [0, 2, 4, 5]
    assert sorted(ids(tables.resume_slice(source, stored.limit(0), 3))) == [0, 1, 2]
    # A late text with a small id is not lost.
    assert sorted(ids(tables.resume_slice(source, stored, None))) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert ids(tables.resume_slice(source, source.withColumnRenamed("id", "source_id"), 3)) == []


def test_taxonomy_file(spark, folder):
    assert tables.read_taxonomy(spark, f"{folder}/none").collect() == []
    with open(f"{folder}/t.csv", "w") as out:
        out.write("Hoofd_klantsignaal,Sub_klantsignaal\nB,y\nA,x\nB,z\n")
    read = tables.read_taxonomy(spark, f"{folder}/t.csv")
    assert [(r["main_topic"], r["sub_topic"]) for r in read.orderBy("pos").collect()] == [("B", "y"), ("A", "x"), ("B", "z")]


def test_document_rounds_replace_themselves(spark, folder):
    rows = lambda n, text: spark.createDataFrame([(1, text, n)], "doc_id long, json_ld string, round int")
    sinks.write_documents(rows(0, "a"), folder)
    sinks.write_documents(rows(1, "b"), folder)
    sinks.write_documents(rows(1, "c"), folder)
    assert sorted((r["round"], r["json_ld"]) for r in spark.read.parquet(folder).collect()) == [(0, "a"), (1, "c")]


def test_missing_tables_are_empty(spark, folder):
    assert tables.read_or_empty(spark, f"{folder}/none", tables.RESULT_SCHEMA).count() == 0
