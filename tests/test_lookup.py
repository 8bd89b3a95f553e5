"""The semantic lookup and the lookup joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgraph.functions.joins import lookup_join
from textgraph.operators import lookup as lk, model_calls as mc
from textgraph.plans import schema_mapping as sm

CLASS = "class_id long, class_label string, comments string, embedding array<float>"
MENTION = "mention_id long, embedding array<float>"


def brute(mentions, classes, k=5):
    out = {}
    for key, vector in mentions:
        a, scored = np.array(vector, dtype=np.float32).astype(float), []
        for class_id, _, _, other in classes:
            b = np.array(other, dtype=np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b / norm), 12) if norm else np.inf, class_id))
        out[key] = [c for _, c in sorted(scored)[:k]]
    return out


def ids(topk):
    return {r["mention_id"]: [c["class_id"] for c in r["candidates"]] for r in topk.collect()}


@pytest.fixture(scope="module")
def stores():
    rng = np.random.default_rng(7)
    classes = [(i, f"C{i}", None if i % 3 else f"about {i}", rng.normal(size=6).tolist()) for i in range(40)]
    classes += [(100, "C1", "same vector", classes[1][3]), (101, "Z", None, [0.0] * 6)]
    mentions = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(60, [0.0] * 6), (61, classes[1][3])]
    return mentions, classes


def test_topk_is_exact(spark, stores):
    mentions, classes = stores
    got = lk.semantic_topk(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(classes, CLASS))
    assert ids(got) == brute(mentions, classes)
    zero = got.filter("mention_id = 60").first()["candidates"]
    assert [c["score"] for c in zero] == [None] * 5 and [c["rank"] for c in zero] == [1, 2, 3, 4, 5]
    assert [c["class_id"] for c in got.filter("mention_id = 61").first()["candidates"]][:2] == [1, 100]


def test_topk_over_blocks_is_the_same(spark, stores):
    mentions, classes = stores
    left, right = spark.createDataFrame(mentions, MENTION), spark.createDataFrame(classes, CLASS)
    blocks = lk.semantic_topk(left, right, block_bytes=500)
    assert ids(blocks) == brute(mentions, classes)
    assert blocks.schema.simpleString() == lk.semantic_topk(left, right).schema.simpleString()


@pytest.mark.parametrize("block_bytes", [10**6, 200])
def test_equal_scores_at_the_cut_go_by_store_order(spark, block_bytes):
    classes = spark.createDataFrame([(i, f"C{i}", None, [1.0, 2.0]) for i in (8, 3, 5, 1, 9, 2, 7)], CLASS)
    got = lk.semantic_topk(spark.createDataFrame([(1, [2.0, 4.0])], MENTION), classes, block_bytes=block_bytes)
    assert ids(got) == {1: [1, 2, 3, 5, 7]}


def test_fewer_classes_than_candidates(spark, stores):
    mentions, classes = stores
    left = spark.createDataFrame(mentions, MENTION)
    assert ids(lk.semantic_topk(left, spark.createDataFrame(classes[:3], CLASS))) == brute(mentions, classes[:3])
    assert ids(lk.semantic_topk(left, spark.createDataFrame(classes[:3], CLASS), block_bytes=100)) == brute(mentions, classes[:3])
    assert set(map(tuple, ids(lk.semantic_topk(left, spark.createDataFrame([], CLASS))).values())) == {()}


def test_vectors_of_another_length_are_an_error(spark, stores):
    _, classes = stores
    with pytest.raises(Exception, match="every vector must have 6 numbers"):
        lk.semantic_topk(spark.createDataFrame([(1, [1.0, 2.0])], MENTION), spark.createDataFrame(classes, CLASS)).collect()


def test_first_definition_of_a_repeated_label(spark):
    definitions = spark.createDataFrame([(5, "A", "later"), (2, "A", "first"), (3, "B", "b")], "class_id long, label string, definition string")
    mapping = spark.createDataFrame([(1, "A"), (2, "None")], "doc_id long, schema_label string")
    got = {r["doc_id"]: (r["definition"], r["missing"]) for r in lk.definition_lookup(mapping, definitions).collect()}
    assert got == {1: ("first", False), 2: (None, True)}


def test_choice_without_a_definition_falls_back(spark):
    candidates = "array<struct<rank:int,class_label:string>>"
    topk = spark.createDataFrame(
        [(1, "a", 0, [(1, "X"), (2, "Y")]), (1, "b", 1, [(1, "X"), (2, "Y")]), (2, "a", 0, [(1, "None")]), (3, "a", 0, [])],
        f"doc_id long, class_name string, pos long, candidates {candidates}",
    )
    definitions = spark.createDataFrame([("X",), ("Y",)], "label string")
    choices = spark.createDataFrame(
        [(1, "a", ("r", "Y", 2)), (1, "b", ("r", "Unknown", 1)), (2, "a", None)],
        f"doc_id long, class_name string, answer struct<{', '.join(f.replace(' ', ':') for f in mc.CHOICE.split(', '))}>",
    )
    got = {(r["doc_id"], r["class_name"]): (r["schema_label"], r["fell_back"]) for r in sm.resolve_classes(topk, definitions, choices).collect()}
    assert got == {(1, "a"): ("Y", False), (1, "b"): ("X", True)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_beyond_the_bound_are_the_same(spark, how):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    left = spark.range(500).select("id", key.alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 5), ("k1", 2), ("k2", 3), ("other", 4)], "k string, v int")
    small = lookup_join(left, right, ["k"], how)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    want = sorted(map(tuple, small.collect()), key=repr)
    spread = lookup_join(left, right, ["k"], how, limit=10)
    assert spread.columns == small.columns
    assert sorted(map(tuple, spread.collect()), key=repr) == want
