"""Edge rows of the text functions, with results written by hand."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textgraph.functions import fixed, templates, text
from textgraph.operators import extraction as ex, jsonld as jl, prompts, scoring as sc


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("c"))).collect()]


def answer(summary="s", entities="a | B | c", relations="a | b | c"):
    return (
        f"<summary>\n{summary}\n</summary>\n<entiteiten>\n{entities}\n</entiteiten>\n<relaties>\n{relations}\n</relaties>"
    )


def parse(spark, responses):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "doc_id long, response string")
    return {r["doc_id"]: r for r in ex.extraction(rows).collect()}


def test_strip_is_that_of_python(spark):
    values = ["", " \t\n", " a ", "\x1cx\x1f", "　y\x85", "a b", fixed.SPACE + "z" + fixed.SPACE]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_sections(spark):
    values = [
        "", "\n\n", "<summary>x</summary>", "<summary>\nx\n</summary>", "<summary>\na\n</summary>\n<summary>\nb\n</summary>",
        "<summary>\n\n</summary>", "<summary>\n</summary>", "<summary>\na\nb\n</summary>",
    ]
    assert column(spark, values, lambda c: text.section(c, "summary")) == ["", "", "", "x", "a", "", "", "a\nb"]


def test_rows_of_three(spark):
    def rows(c):
        return F.to_json(text.rows_of_three(c, ["a", "b", "c"]))

    cases = {
        "x | y | z": '[{"pos":0,"a":"x","b":"y","c":"z"}]',
        "x | y": "[]",
        "": "[]",
        # An empty third part counts inside the section ...
        "x | y | \nu | v | w | more": '[{"pos":0,"a":"x","b":"y","c":""},{"pos":1,"a":"u","b":"v","c":"w"}]',
        # ... but not in its last row, whose end is stripped.
        "u | v | w\n\n  \nx | y | ": '[{"pos":0,"a":"u","b":"v","c":"w"}]',
        "  x  |  y  |  z  ": '[{"pos":0,"a":"x","b":"y","c":"z"}]',
        "x|y|z": "[]",
    }
    assert column(spark, list(cases), rows) == list(cases.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab| \n\t", max_size=25), min_size=1, max_size=8))
def test_rows_follow_the_plain_rule(spark, sections):
    def plain(section):
        out = []
        for line in section.strip().split("\n"):
            parts = [p.strip() for p in line.split(" | ")]
            if line.strip() and len(parts) >= 3:
                out.append(parts[:3])
        return out

    rows = column(
        spark, sections,
        lambda c: F.struct(text.rows_of_three(c, ["a", "b", "c"]).alias("rows"), text.has_rows(c).alias("any")),
    )
    assert [[[r["a"], r["b"], r["c"]] for r in row["rows"]] for row in rows] == [plain(s) for s in sections]
    assert [row["any"] for row in rows] == [bool(plain(s)) for s in sections]


def test_failed_and_rejected_extractions(spark):
    got = parse(spark, [answer(), answer(summary=" "), answer(entities="a | b"), answer(relations=""), "", None, "{ no end"])
    assert [got[i]["extraction_failed"] for i in range(7)] == [False, True, True, True, True, True, True]
    assert [got[i]["reject_reason"] for i in range(7)] == [None, None, None, None, "no response", "no response", None]
    assert got[1]["entities"] == [] and got[1]["relations"] == [] and got[1]["summary"] == ""
    assert got[0]["entities"][0].asDict() == {"pos": 0, "name": "a", "class_name": "B", "description": "c"}


def test_first_entity_of_a_class(spark):
    rows = spark.createDataFrame(
        [(1, 2, "late", "A", "d2"), (1, 0, "first", "A", "d0"), (1, 1, "b", "B", "d1")],
        "doc_id long, pos long, name string, class_name string, description string",
    )
    listed = rows.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "name", "class_name", "description")).alias("entities"))
    listed = listed.union(spark.createDataFrame([(2, [])], listed.schema))
    assert {tuple(r) for r in ex.first_per_class(listed).collect()} == {(1, "A", 0, "first", "d0"), (1, "B", 1, "b", "d1")}
    names = {tuple(r)[:3]: r["names"] for r in ex.entities_per_class(listed).collect()}
    assert names == {(1, "A", 0): ["first", "late"], (1, "B", 1): ["b"]}
    assert ex.entity_rows(listed).count() == 3


def test_json_object(spark):
    values = ["", "\n", "{", "x {\"a\": 1} y", "{a}{b}", "}{", "{\n}"]
    assert column(spark, values, text.json_object) == [None, None, None, '{"a": 1}', "{a}{b}", None, "{\n}"]


def plain_labels(cell):
    import ast

    try:
        found = ast.literal_eval(cell.strip())
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError, AttributeError):
        return None
    return [v if v is None else str(v) for v in found] if isinstance(found, list) else None


def test_lists_are_read_as_python_reads_them(spark):
    rng = random.Random(11)
    items = ["'a'", '"b c"', "''", '""', "None", "'it''s'", r"'a\'b'", r"'\n'", "'é, ]'", '"[x"', "1", "1.5", "True", "['n']", "b'x'", "u'x'", "'a' 'b'", "'''t'''", "None ", "'N\tone'", "'a\nb'"]
    seps = [",", ", ", " ,\n", ", ,", " "]
    cells = ["[" + rng.choice(seps).join(rng.choice(items) for _ in range(rng.randrange(5))) + rng.choice(["]", ",]", " ]", "] ", ""]) for _ in range(600)]
    cells += [None, "", "[]", "[ ]", "[,]", " [ 'a' ] ", "\n['a']\n", " ['a']", "('a',)", "x", "['a'", "['a']]", "[" + "'ab', " * 3000 + "]", "['\x00']", "[None]", "[Nonesuch]"]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cells)], "n long, c string")
    got = {r["n"]: r["labels"] for r in df.select("n", text.read_literal(F.col("c")).alias("labels")).collect()}
    assert got == {n: plain_labels(c) for n, c in enumerate(cells)}
    assert df.filter(text.plain_list(F.col("c"))).count() > 50


def test_label_literals(spark):
    values = ["['a', 'it\\'s']", '["it\'s"]', "[]", "no list", "'x'", "", None, "['a'"]
    values += ["['a', 'b',]", "['a', None]", "['caf\\xe9']", "['a'] x", " ['a']"]
    nothing = [fixed.NO_LABEL]
    assert column(spark, values, sc.gold_list) == [
        ["a", "it's"], ["it's"], nothing, nothing, nothing, nothing, nothing, nothing, ["a", "b"], ["a", None], ["café"], nothing, ["a"],
    ]
    cells = spark.createDataFrame([(v,) for v in values], "gold_labels string")
    assert sc.unreadable_gold(cells) == 6


def test_label_cells(spark):
    assert column(spark, ["a; b", "a", None, "a;b"], text.label_cell) == [["a", "b"], ["a"], [], ["a;b"]]


def test_template_is_filled_in_one_pass(spark):
    got = column(spark, ["{B}", None], lambda c: text.fill("{{x}} {A}/{B}", A=c, B=F.lit("b")))
    assert got == ["{x} {B}/b", "{x} /b"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=10))
def test_numbers_print_as_in_c(spark, numbers):
    rows = spark.createDataFrame([(i, float(n)) for i, n in enumerate(numbers)], "i int, c double")
    got = [r[0] for r in rows.orderBy("i").select(text.general_number(F.col("c"))).collect()]
    for number, shown in zip(numbers, got):
        # Ties may round another way in the sixth digit.
        assert float(shown) == pytest.approx(float(f"{number:g}"), rel=2e-5)
        assert len(shown) <= len(f"{number:g}") + 1


def test_whole_and_large_numbers(spark):
    rows = spark.createDataFrame([(0, 3.0), (1, 0.0), (2, 1234567.0), (3, 0.00001), (4, 100000.0), (5, -2.5), (6, None)], "i int, c double")
    got = [r[0] for r in rows.orderBy("i").select(text.general_number(F.col("c"))).collect()]
    assert got == ["3", "0", "1.23457e+06", "1e-05", "100000", "-2.5", None]


def test_prompts(spark):
    texts = spark.createDataFrame([(1, "{SCHEMA_DEFINITIONS}")], "doc_id long, text string")
    shown = prompts.extract_prompt(texts).first()["human_prompt"]
    assert shown == templates.EXTRACT_HUMAN.format(INPUT_TEXT="{SCHEMA_DEFINITIONS}")
    docs = texts.withColumns({
        "schema_blocks": F.lit(None).cast("string"), "relations": F.array().cast(ex.RELATION), "runs": F.lit(1),
        "previous_json_ld": F.lit("{}"), "previous_output": F.lit(None).cast("string"),
    })
    shown = prompts.transform_prompt(docs).first()["human_prompt"]
    assert fixed.NO_RELATIONS in shown and fixed.NO_VALIDATION_OUTPUT in shown and shown == shown.strip()


def test_block_without_a_rendered_definition(spark):
    mapping = spark.createDataFrame([(1, "k", "X", 0), (1, "l", "Y", 1)], "doc_id long, class_name string, schema_label string, pos long")
    names = spark.createDataFrame([(1, "k", ["e", "f"])], "doc_id long, class_name string, names array<string>")
    defined = spark.createDataFrame([("X", "cx", "rx"), ("Y", None, "ry")], "label string, compact string, raw string")
    assert prompts.schema_blocks(mapping, names, defined).first()["schema_blocks"] == (
        "**Schema: X**\nEntiteiten die dit schema gebruiken:\n- e\n- f\n\n```yaml\ncx\n```\n\n**Schema: l**\n\n```\nry\n```"
    )


def test_minimal_document(spark):
    assert spark.range(1).select(jl.minimal_document()).first()[0] == '{"@context":"https://schema.org","@type":"Thing"}'
