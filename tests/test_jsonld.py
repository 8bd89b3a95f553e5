"""Documents: terms, facts, validation, routing, repair."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textgraph.functions import fixed
from textgraph.operators import jsonld as jl, labels as lb, validation as va
from textgraph.operators.hierarchy import covered, hierarchy
from textgraph.plans.repair import final_documents, repair_loop

CLASSES = [("Thing", None), ("Person", "Thing"), ("Place", "Thing"), ("Country", "Place"), ("Robot", "Thing")]
PROPERTIES = [
    ("Thing", "name", "Text"), ("Person", "nationality", "Country"), ("Person", "knows", "Person"),
    ("Place", "containedInPlace", "Place"), ("Robot", "maker", "Person"), ("Robot", "maker", "Robot"), ("Thing", "about", "Thing"),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return va.prepare_vocabulary(
        spark.createDataFrame(CLASSES, "label string, parent string"),
        spark.createDataFrame(PROPERTIES, "class_label string, property string, range string"),
    )


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, json_ld string")


def test_facts(spark):
    text = json.dumps({
        "@context": "x", "@type": ["Person", "Robot"], "@id": "#p", "name": ["a", "b"], "age": 1.50, "ok": True, "gone": None,
        "knows": [{"@id": "#q"}, {"@type": "Person", "@id": "#r", "name": "r"}], "nested": [[{"k": 1}]], "empty": [], "none": {},
    })
    rows = jl.jsonld_triples(documents(spark, [text]), ["doc_id"]).collect()
    got = {(r["path"], r["node_id"], r["node_type"], r["property"], r["value"], r["value_type"]) for r in rows}
    top = ("$", "#p", "Person Robot")
    assert got == {
        (*top, "@type", "Person", "type"), (*top, "@type", "Robot", "type"),
        (*top, "name", "a", "string"), (*top, "name", "b", "string"), (*top, "age", "1.5", "number"),
        (*top, "ok", "true", "boolean"), (*top, "gone", None, "null"),
        (*top, "knows", "#q", "ref"), (*top, "knows", "#r", "node"),
        ("$.knows[1]", "#r", "Person", "@type", "Person", "type"), ("$.knows[1]", "#r", "Person", "name", "r", "string"),
        (*top, "nested", "$.nested[0][0]", "node"), ("$.nested[0][0]", None, "", "k", "1", "number"),
        (*top, "none", "$.none", "node"),
    }


def test_an_object_is_one_row_for_validation(spark):
    """Types are looked up once per object: a row each, not one per value."""
    text = json.dumps({
        "@context": "x", "@type": ["Person", "Robot"], "@id": "#p", "name": ["a", "b"], "age": 1.5, "@odd": 1, "empty": [],
        "knows": [{"@id": "#q"}, {"@type": "Person", "name": "r"}, {"@type": ["Person"], "@id": "#s"}], "maker": [[{"name": 1}]], "none": {},
    })
    rows = jl.nodes(documents(spark, [text, "x"]), ["doc_id"]).collect()
    got = {(r["doc_id"], r["path"]): (r["types"], r["via"], sorted((e["property"] or "", *e["child_types"]) for e in r["entries"])) for r in rows}
    assert len(got) == len(rows) and got == {
        (0, "$"): (["Person", "Robot"], None, [
            ("",), ("@type",), ("age",), ("knows",), ("knows", "Person"), ("knows", "Person"), ("maker",), ("name",), ("none",)]),
        (0, "$.knows[1]"): (["Person"], "knows", [("@type",), ("name",)]),
        (0, "$.knows[2]"): (["Person"], "knows", [("@type",)]),
        (0, "$.maker[0][0]"): ([], "maker", [("name",)]),
        (1, None): ([], None, [(jl.INVALID,)]),
    }


def test_deep_documents_are_whole(spark):
    text = '{"a":' * 200 + "1" + "}" * 200
    assert jl.jsonld_triples(documents(spark, [text]), ["doc_id"]).count() == 200


def test_numbers_keep_their_text(spark):
    rows = jl.jsonld_triples(documents(spark, ['{"a": 1.50, "b": 12345678901234567890, "c": 1e3}']), ["doc_id"]).collect()
    assert {r["property"]: r["value"] for r in rows} == {"a": "1.50", "b": "12345678901234567890", "c": "1e3"}


def test_broken_documents_do_not_stop_the_job(spark):
    texts = ['{"a":"\\ud800x","b\\ud800":["\\ud83d\\ude00"]}', "[" * 200_000, '{"a":' * 200_000, '{"a":NaN}', '{"a":1} x', None]
    rows = jl.facts(documents(spark, texts), ["doc_id"]).collect()
    assert {(r["doc_id"], r["property"], r["kind"], r["value"]) for r in rows} == {
        (0, None, "root", None), (0, "a", "string", "?x"), (0, "b?", "string", "😀"),
        *((i, None, "invalid", None) for i in range(1, 6)),
    }


CASES = {
    '{"@type":"Person","name":"x"}': (0, ""),
    '{"name":"x"}': (0, ""),
    '{"nationality":{"name":"x"}}': (1, "$ domain nationality"),
    "no json": (1, "$ json invalid"),
    "[1]": (1, "$ json invalid"),
    '{"name":"x","name":"y"}': (1, "$ json invalid"),
    '{"@type":"Persoon","name":"x","nationality":"y"}': (1, "$ type Persoon"),
    '{"@type":"Person","size":1}': (1, "$ property size"),
    '{"@type":"Person","containedInPlace":"x","size":[1,2]}': (1, "$ property size\n$ domain containedInPlace"),
    # An object without a type takes the range of its property.
    '{"@type":"Person","nationality":{"containedInPlace":{"name":"x"}}}': (0, ""),
    '{"@type":"Person","nationality":{"knows":"x"}}': (1, "$.nationality domain knows"),
    '{"@type":"Person","nationality":{"@type":"Place"}}': (1, "$ range nationality"),
    '{"@type":"Place","containedInPlace":{"@type":"Country"}}': (0, ""),
    # A reference and a plain value pass as values of any property.
    '{"@type":"Person","nationality":{"@id":"#n"},"knows":"someone"}': (0, ""),
    # One fitting type of several is enough.
    '{"@type":["Person","Robot"],"knows":{"@type":"Person"},"maker":{"@type":["Place","Robot"]}}': (0, ""),
    '{"@type":["Person","Place"],"maker":"x"}': (1, "$ domain maker"),
    '{"@type":["Person","Nobody"],"maker":"x"}': (1, "$ type Nobody"),
    # Children of an unknown type are not measured against a range.
    '{"@type":"Person","knows":{"@type":"Nobody","name":"x"}}': (1, "$.knows type Nobody"),
    '{"@type":"Person","name":{"@type":"Person"}}': (1, "$ range name"),
    "{}": (0, ""),
}


def test_validation(spark, vocabulary):
    rows = va.jsonld_validate(documents(spark, list(CASES)), vocabulary).collect()
    assert {list(CASES)[r["doc_id"]]: (r["code"], r["output"]) for r in rows} == CASES


ABOVE = {"Thing": ["Thing"], "Person": ["Person", "Thing"], "Place": ["Place", "Thing"], "Country": ["Country", "Place", "Thing"], "Robot": ["Robot", "Thing"]}


def plain_errors(node, path="$", via=None):
    """The rules, document by document and node by node."""
    def types_of(value):
        kinds = value.get("@type", [])
        return list(dict.fromkeys(kinds if isinstance(kinds, list) else [kinds]))

    def ranges(name):
        return [r for _, p, r in PROPERTIES if p == name]

    own, found = types_of(node), set()
    found |= {(path, 2, "type", t) for t in own if t not in ABOVE}
    types = own or (["Thing"] if via is None else ranges(via))
    for name, value in node.items():
        if name.startswith("@"):
            continue
        for place, item in [(f"{path}.{name}", value)] if not isinstance(value, list) else [(f"{path}.{name}[{i}]", v) for i, v in enumerate(value)]:
            known = bool(ranges(name))
            judged = bool(types) and all(t in ABOVE for t in types)
            if not known:
                found.add((path, 3, "property", name))
            elif judged and not any((a, name) in {(c, p) for c, p, _ in PROPERTIES} for t in types for a in ABOVE[t]):
                found.add((path, 4, "domain", name))
            if isinstance(item, dict) and list(item) != ["@id"]:
                kinds = types_of(item)
                if known and judged and kinds and all(k in ABOVE for k in kinds) and not any(r in ABOVE[k] for k in kinds for r in ranges(name)):
                    found.add((path, 5, "range", name))
                found |= plain_errors(item, place, name)
    return found


KINDS = st.lists(st.sampled_from(["Person", "Place", "Country", "Robot", "Thing", "Nobody"]), max_size=2)
NAMES = st.sampled_from(["name", "nationality", "knows", "containedInPlace", "maker", "about", "size"])


def nodes(values):
    def build(kinds, members, ref):
        node = {**({"@type": kinds if len(kinds) != 1 else kinds[0]} if kinds else {}), **members}
        return {"@id": "#x"} if ref and not node else node

    return st.builds(build, KINDS, st.dictionaries(NAMES, st.one_of(values, st.lists(values, min_size=1, max_size=3)), max_size=3), st.booleans())


NODE = st.recursive(nodes(st.sampled_from(["text", 1, True])), lambda inner: nodes(st.one_of(inner, st.just("text"))), max_leaves=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(NODE, min_size=20, max_size=40))
def test_validation_follows_the_plain_rules(spark, vocabulary, made):
    rows = va.jsonld_validate(documents(spark, [json.dumps(d) for d in made]), vocabulary).collect()
    got = {r["doc_id"]: (r["code"], r["output"]) for r in rows}
    for i, doc in enumerate(made):
        lines = "\n".join(f"{p} {rule} {v}" for p, _, rule, v in sorted(plain_errors(doc)))
        assert got[i] == (int(bool(lines)), lines), doc


def test_validation_with_large_vocabulary_tables(spark, vocabulary):
    import dataclasses

    shuffled = dataclasses.replace(vocabulary, sizes=dict.fromkeys(vocabulary.sizes, 10**12))
    checked = va.jsonld_validate(documents(spark, list(CASES)), shuffled)
    assert {list(CASES)[r["doc_id"]]: (r["code"], r["output"]) for r in checked.collect()} == CASES
    # However large the tables, documents are parsed once.
    assert checked._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1


def plain_below(edges, labels):
    """{label: classes at or below it} by a search upwards from each class."""
    parents, out = {}, {}
    for label, parent in edges:
        if parent is not None:
            parents.setdefault(label, set()).add(parent)
    for label in labels:
        seen, todo = {label}, [label]
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        for p in seen:
            out.setdefault(p, set()).add(label)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_with_several_parents(spark, folder, seed):
    rng = random.Random(seed)
    names = [f"c{n}" for n in range(60)]
    edges = [(n, None) for n in names[:3]] + [("c7", "unlisted"), ("c9", "unlisted")]
    for n in range(3, 60):
        edges += [(names[n], names[rng.randrange(n)]) for _ in range(rng.choice([1, 1, 1, 2, 4]))]
    index = hierarchy(spark.createDataFrame(edges + edges[:5], "label string, parent string"), folder)
    places = {r["label"]: r["lo"] for r in index.classes.filter("known").collect()}
    assert set(places) == set(names) and index.classes.count() == 61
    keyed = index.classes.select(F.col("label").alias("key"), "label")
    got = {
        r["key"]: {n for n, lo in places.items() if any(i["lo"] <= lo <= i["hi"] for i in r["intervals"])}
        for r in covered(index, keyed, "key").collect()
    }
    assert got == plain_below(edges, names)


def test_a_deep_chain_has_tables_of_its_own_size(spark, folder):
    n = 20_000
    classes = spark.range(n).select(
        F.concat(F.lit("C"), "id").alias("label"), F.when(F.col("id") > 0, F.concat(F.lit("C"), F.col("id") - 1)).alias("parent"))
    properties = spark.range(n).select(
        F.concat(F.lit("C"), "id").alias("class_label"), F.concat(F.lit("p"), F.col("id") % 1000).alias("property"), F.concat(F.lit("C"), "id").alias("range"))
    vocabulary = va.prepare_vocabulary(classes, properties, folder)
    assert vocabulary.known.count() == n and vocabulary.properties.count() == 1000
    assert sum(vocabulary.sizes.values()) < 100 * n
    docs = ['{"@type":"C19999","p0":{"@type":"C5"}}', '{"@type":"C5","p6":"x","p5":"x"}', '{"@type":"C1000","p7":{"@type":"C6"}}']
    assert [r["output"] for r in va.jsonld_validate(documents(spark, docs), vocabulary).orderBy("doc_id").collect()] == [
        "", "$ domain p6", "$ range p7"]


@pytest.mark.parametrize("edges", [
    [("A", "B"), ("B", "C"), ("C", "A")], [("A", "A")], [("A", None), ("B", "A"), ("B", "Z"), ("Z", "B")],
    [("A", None), ("B", "A"), ("C", "B"), ("C", "Z"), ("Y", "A"), ("Z", "Y"), ("Z", "X"), ("X", "A"), ("Y", "X"), ("X", "W"), ("W", "C"), ("W", "A")],
])
def test_cycles_are_an_error(spark, folder, edges):
    with pytest.raises(ValueError, match="cycle"):
        hierarchy(spark.createDataFrame(edges, "label string, parent string"), folder)


def test_deep_documents(spark):
    nested = lambda n: '{"a":' * n + "1" + "}" * n
    texts = [nested(jl.MAX_DEPTH), nested(jl.MAX_DEPTH + 1), nested(3000), nested(50_000), '{"a":"' + "{" * 1000 + '"}']
    roots = jl.facts(documents(spark, texts), ["doc_id"]).filter("kind IN ('root', 'invalid')").orderBy("doc_id").collect()
    assert [r["kind"] for r in roots] == ["root", "invalid", "invalid", "invalid", "root"]
    read = jl.document_terms(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["reject_reason"] for r in read] == ["no about", "no JSON object", "no JSON object", "no JSON object", "no about"]


def test_empty_vocabulary_is_code_2(spark):
    empty = va.prepare_vocabulary(
        spark.createDataFrame([], "label string, parent string"),
        spark.createDataFrame([], "class_label string, property string, range string"),
    )
    assert [r["code"] for r in va.jsonld_validate(documents(spark, ["{}"]), empty).collect()] == [2]


def test_routes_in_order(spark):
    rows = spark.createDataFrame([(0, 4), (1, 0), (1, 4), (1, 5), (2, 0), (3, 0), (None, 0)], "code int, runs int")
    state = va.attempt_state(rows).withColumn("route", va.route_outcome())
    got = [(r["code"], r["runs"], r["route"]) for r in state.collect()]
    assert got == [(0, 4, "label"), (1, 1, "repair"), (1, 5, "label"), (1, 6, "label"), (2, 0, "halt"), (3, 0, "label"), (None, 0, "label")]


def scripted(spark, codes):
    """Documents whose validation gives the listed codes, one after the other."""
    rows = [(doc, n, '{"code": %d}' % code if code is not None else "sorry") for doc, cs in codes.items() for n, code in enumerate(cs)]
    answers = spark.createDataFrame(rows, "doc_id long, round int, response string")

    def answer(open_docs, number):
        return open_docs.select("doc_id").join(answers.filter(F.col("round") == number), "doc_id", "left")

    def validate(docs):
        code = F.try_variant_get(F.try_parse_json("json_ld"), "$.code", "int")
        return docs.select("doc_id", code.alias("code"), F.concat(F.lit("told "), code).alias("output"))

    return spark.createDataFrame([(d,) for d in codes], "doc_id long"), answer, validate


def test_repair_rounds(spark, folder):
    codes = {1: [0], 2: [1, 0], 3: [1] * 4 + [0], 4: [1] * 5 + [0], 5: [1] * 6, 6: [3], 7: [1, None]}
    rounds = repair_loop(*scripted(spark, codes), folder)
    done = {r["doc_id"]: (r["round"], r["code"], r["runs"], r["max_reached"]) for r in final_documents(rounds).collect()}
    assert done == {1: (0, 0, 0, False), 2: (1, 0, 1, False), 3: (4, 0, 4, False), 4: (4, 1, 5, True), 5: (4, 1, 5, True), 6: (0, 3, 0, False)}
    assert [(r["doc_id"], r["round"], r["reject_reason"]) for r in rounds.filter("route = 'reject'").collect()] == [
        (7, 1, "no JSON object in the answer")
    ]


def test_a_document_without_an_answer_is_rejected(spark, folder):
    docs, answer, validate = scripted(spark, {1: [0]})
    rounds = repair_loop(docs.union(spark.createDataFrame([(9,)], "doc_id long")), answer, validate, folder)
    assert {(r["doc_id"], r["route"]) for r in rounds.collect()} == {(1, "label"), (9, "reject")}


def test_infrastructure_error_stops_after_the_round_is_stored(spark, folder):
    with pytest.raises(RuntimeError, match="Infrastructure error in validator: told 2"):
        repair_loop(*scripted(spark, {1: [0], 2: [1, 0], 3: [2]}), folder)
    assert spark.read.parquet(f"{folder}/rounds/round=0").count() == 3


TAXONOMY = [("B", "x", 1), ("A", "x", 2), ("B", "y", 3), ("Both", "z", 4), ("B", "y", 5), ("Free", "f", 6)]
SIGNALS = [("onderwerp", "A", 1), ("onderwerp", "Both", 1), ("beleving", "Both", 2), ("beleving", "B", 2)]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "main_topic string, sub_topic string, pos long")


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame(SIGNALS, "signal_type string, main_topic string, priority int")


def labelled(spark, taxonomy, rows):
    return lb.topic_of_label(spark.createDataFrame(rows, "doc_id long, pos long, label string"), taxonomy)


def test_add_terms(spark, taxonomy):
    term = lambda label, topic: {"@type": "DefinedTerm", "name": label, "inDefinedTermSet": {"@type": "DefinedTermSet", "name": topic}}
    texts = ['{"name":"n"}', '{"about":{"a":1},"z":1}', '{"about":[{"a":1}],"b":{"d":1,"c":2}}', '{"about":"one"}', "no", '{"a":1,"a":2}', '{"about":null}']
    labels = labelled(spark, taxonomy, [
        (0, 1, "y"), (0, 0, "x"), (0, 2, "unknown"), (2, 0, fixed.NO_LABEL), (1, 0, "y"), (1, 1, "y"), (4, 0, "x"), (6, 0, "x"),
    ])
    rows = {r["doc_id"]: r for r in jl.add_terms(documents(spark, texts), labels).collect()}
    read = {k: json.loads(r["json_ld"]) if r["reject_reason"] is None else r["reject_reason"] for k, r in rows.items()}
    assert read == {
        0: {"name": "n", "about": [term("x", "A"), term("y", "B")]},
        1: {"z": 1, "about": [{"a": 1}, term("y", "B"), term("y", "B")]},
        2: {"about": [{"a": 1}, term(fixed.NO_LABEL, fixed.NO_TOPIC)], "b": {"d": 1, "c": 2}},
        3: {"about": "one"},
        4: "no JSON object", 5: "no JSON object",
        6: {"about": [None, term("x", "A")]},
    }
    empty = jl.add_terms(documents(spark, ['{"a":1}']), labels.filter("doc_id = 99")).first()
    assert json.loads(empty["json_ld"]) == {"a": 1, "about": []}


def test_read_terms(spark, signals):
    item = '{"name":"%s","inDefinedTermSet":{"name":"%s"}}'
    texts = [
        '{"about":[%s,%s,%s]}' % (item % ("l1", "A"), item % ("l2", "B"), item % ("l3", "Other")),
        '{"about":%s}' % item % ("one", "Both"),
        "{}", '{"about":[{"name":"x"}]}', '{"about":[{"inDefinedTermSet":{"name":"A"}}]}', "no", '{"about":["text"]}', '{"about":[]}',
    ]
    docs = documents(spark, texts)
    assert {(r["doc_id"], r["pos"], r["label"], r["signal_type"]) for r in jl.read_terms(docs, signals).collect()} == {
        (0, 0, "l1", "onderwerp"), (0, 1, "l2", "beleving"), (1, 0, "one", "onderwerp"),
    }
    assert {r["doc_id"]: r["reject_reason"] for r in jl.rejected_documents(docs).collect()} == {
        2: "no about", 3: "term without a term set", 4: "term without a name", 5: "no JSON object", 6: "term without a term set",
    }


def test_terms_come_back(spark, taxonomy, signals):
    labels = labelled(spark, taxonomy, [(0, 0, "x"), (0, 1, "z"), (0, 2, "x"), (0, 3, "y")])
    termed = jl.add_terms(documents(spark, ['{"@type":"Thing"}']), labels)
    got = [(r["pos"], r["label"], r["signal_type"]) for r in jl.read_terms(termed, signals).orderBy("pos").collect()]
    assert got == [(0, "x", "onderwerp"), (1, "z", "onderwerp"), (2, "x", "onderwerp"), (3, "y", "beleving")]
