"""Chat formatting, top-k search, suffix order, components, the pipeline."""

import random

import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from check import compare, database
import brute
from textgraph.llm import chat, graph, queries, topk
from textgraph.llm.suffix import suffix_order

SF = "/root/testdata/sf0.001"
PARTS = st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "Assistant: ", ":", "@", "<", "/turn>", "#", "é", "\x00", "x "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(PARTS, st.sampled_from(list(chat.NAMES))), PARTS), max_size=5))
def test_round_trip(turns):
    formatted = "".join(chat.render(role, text) for role, text in turns)
    read = chat.parse(formatted)
    assert [t[:2] for t in read] == turns
    assert all(chat.unescape(formatted[a:b]) == text for _, text, a, b in read)


def test_plain_texts_are_not_escaped():
    assert chat.render("user", "a # b < c") == "### User: a # b < c</turn>\n"
    assert chat.parse("### User: a") is None and chat.parse("### Bot: a</turn>\n") is None


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_queries_with_sql(spark, name):
    con = database(SF)
    assert compare(spark, con, SF, name).startswith("ok")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, None, None), (None, None, "user", "x"), (1, 1, "assistant", "b"), (2, 0, "", "\\"), (2, 1, "o:d", "é" * 90_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == brute.sha("user\na\nassistant\nb\nassistant\nb\n\n\n")
    assert got[1]["loss_sha256"] == brute.sha("bb") and got[1]["loss_chars"] == 2
    assert got[2]["turns_sha256"] == brute.sha("\n\\\no:d\n" + "é" * 90_000 + "\n") and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_turns(df.limit(0))).collect() == []


def plain_top(rows, k):
    import math

    usable = [
        (n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in usable:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in usable if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, -1.0, 2e5])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "VECTORS", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, scale) for _ in range(10)]) for i in range(800)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(100, rows[7][1]), (None, rows[0][1]), (2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 10)]
    rows += [(2300, [float("inf")] * 10), (2400, []), (2500, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, lambda ids: ids % 100 == 0).collect()))
    assert got == plain_top(rows, 10)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, lambda ids: ids % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(df.limit(0), lambda ids: ids >= 0).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=14).map(str.encode), min_size=1, max_size=4), min_size=1, max_size=4))
def test_suffix_order(texts):
    import numpy as np

    data, separator, text = [], [], []
    for n, pieces in enumerate(texts):
        for piece in pieces:
            data += [0, *piece]
            separator += [True, *[False] * len(piece)]
            text += [n] * (len(piece) + 1)
    order = suffix_order(np.array(data, np.uint8), np.array(separator), np.array(text), len(texts)).tolist()
    ends = [i for i, s in enumerate(separator) if s] + [len(data)]
    suffix = lambda i: [] if separator[i] else data[i : min(e for e in ends if e > i)]
    keys = [(text[i], suffix(i)) for i in order]
    assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps, kept = dict(corpus_pipeline.STAGES), docs
    known = steps["language_id"](spark, kept, SF).cache()
    assert {r["doc_id"] for r in known.collect()} == {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    single = steps["near_duplicates"](spark, known, SF).cache()
    wanted = brute.near_duplicates([(r["doc_id"], r["text"]) for r in known.collect()], 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in wanted.items() if c == d}
    clean = steps["decontamination"](spark, single, SF).cache()
    items = [" ".join(w.decode() for w in queries.licences.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: f" {' '.join(w.decode() for w in queries.licences.words(t))} "
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not any(f" {i} " in plain(r["text"]) for i in items)}
    masked = steps["pii"](spark, clean, SF).cache()
    assert masked.count() == clean.count() and all(not brute.pii_base(r["text"]) and r["n_chars"] == len(r["text"]) for r in masked.collect())
    assert all(df.columns == docs.columns for df in (known, single, clean, masked))
    assert set(steps["mixing"](spark, masked, SF).columns) == {*docs.columns, "copy"}


def test_pipeline_on_odd_rows(spark, odd, empty):
    for given in (odd, empty):
        docs, counts = given, []
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF)
            counts.append(docs.count())
        if given is empty:
            assert counts == [0] * 5
        else:  # rows without a letter go, then copies; masking keeps all; each source is mixed to 1.5 times its size in all
            assert given.count() > counts[0] > counts[1] >= counts[2] == counts[3] > 0
            assert docs.filter("lang IS NULL").isEmpty() and {"copy", *given.columns} == set(docs.columns)
