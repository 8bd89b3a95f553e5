"""Taxonomy, labels, counts and scores, batch and incremental."""

import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textgraph.functions import fixed, templates
from textgraph.operators import labels as lb, model_calls as mc, prompts, scoring as sc
from textgraph.plans.evaluate import evaluate
from textgraph.sources import sinks
from textgraph.streaming import incremental as inc

TAXONOMY = [("B", "x", 1), ("A", "x", 2), ("B", "y", 3), ("Both", "z", 4), ("B", "y", 5), ("Free", "f", 6)]
SIGNALS = [("onderwerp", "A", 1), ("onderwerp", "Both", 1), ("beleving", "Both", 2), ("beleving", "B", 2)]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "main_topic string, sub_topic string, pos long")


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame(SIGNALS, "signal_type string, main_topic string, priority int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_signal_topics(spark):
    got = lb.signal_topics(spark)
    assert got.count() == 24 and got.filter("signal_type = 'onderwerp'").count() == 13
    assert rows(got.filter("main_topic = 'No topic found'")) == [("beleving", fixed.NO_TOPIC, 2), ("onderwerp", fixed.NO_TOPIC, 1)]


def test_taxonomy_keeps_file_order(taxonomy):
    assert [tuple(r) for r in lb.taxonomy_rows(taxonomy).collect()] == [
        ("A", 2, "x"), ("B", 1, "x"), ("B", 3, "y"), ("B", 5, "y"), ("Both", 4, "z"), ("Free", 6, "f"),
    ]


def test_first_topic_in_alphabetical_order(spark, taxonomy):
    labels = spark.createDataFrame([(l,) for l in ("x", "y", "f", "gone", fixed.NO_LABEL)], "label string")
    assert rows(lb.topic_of_label(labels, taxonomy)) == sorted(
        [("x", "A"), ("y", "B"), ("f", "Free"), ("gone", None), (fixed.NO_LABEL, fixed.NO_TOPIC)], key=repr
    )


def test_offered_and_allowed(spark, taxonomy, signals):
    offered = lb.offered_labels(taxonomy, signals)
    assert rows(offered.select("signal_type", "label")) == sorted([
        ("onderwerp", "x"), ("onderwerp", "z"), ("onderwerp", fixed.NO_LABEL),
        ("beleving", "x"), ("beleving", "y"), ("beleving", "y"), ("beleving", fixed.NO_LABEL),
    ])
    proposed = spark.createDataFrame(
        [(1, "beleving", "y", 0), (1, "beleving", "y", 1), (1, "beleving", "z", 2), (1, "onderwerp", "z", 0), (1, "onderwerp", "f", 1)],
        "doc_id long, signal_type string, label string, pos long",
    )
    ordered = lb.labels_concat(lb.allowed_labels(proposed, offered)).orderBy("pos")
    assert [r["label"] for r in ordered.collect()] == ["z", "y", "y"]
    assert rows(lb.rejected_labels(proposed, offered).select("signal_type", "label")) == [("beleving", "z"), ("onderwerp", "f")]


def test_the_taxonomy_may_hold_the_empty_label(spark, signals):
    taxonomy = spark.createDataFrame([("Both", fixed.NO_LABEL, 1)], "main_topic string, sub_topic string, pos long")
    offered = lb.offered_labels(taxonomy, signals)
    assert rows(offered.select("signal_type", "added")) == [("beleving", 1), ("onderwerp", 0)]
    # Read as one type, counted in both.
    assert rows(lb.label_signal(taxonomy, signals)) == [(fixed.NO_LABEL, "onderwerp")]
    assert rows(lb.counted_labels(taxonomy, signals)) == [("beleving", fixed.NO_LABEL), ("onderwerp", fixed.NO_LABEL)]


def test_label_prompt(spark, taxonomy, signals):
    texts = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    shown = prompts.label_prompt(texts, lb.offered_labels(taxonomy, signals)).first()["human_prompt"]
    assert shown == templates.LABEL_HUMAN.format(
        ONDERWERP_LIST=f"x\nz\n{fixed.NO_LABEL}", BELEVING_LIST=f"x\ny\ny\n{fixed.NO_LABEL}", INPUT_TEXT="t"
    )


def test_split_gold(spark, taxonomy, signals):
    gold = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "f", 2), (1, "z", 3), (1, "q", 4)], "doc_id long, label string, pos long")
    got = lb.split_gold_by_signal(gold, taxonomy, signals).select("label", "signal_type")
    assert rows(got) == [("x", "onderwerp"), ("y", "beleving"), ("z", "onderwerp")]
    assert rows(lb.skipped_gold(gold, taxonomy, signals).select("label")) == [("f",), ("q",)]


def plain_counts(gold, generated, docs):
    """The counts label by label and text by text."""
    out = {}
    listed = {(s, sub) for s, main, _ in SIGNALS for m, sub, _ in TAXONOMY if m == main}
    for signal, label in listed:
        cell = [0, 0, 0, 0]
        for doc in docs:
            g, p = (doc, signal, label) in gold, (doc, signal, label) in generated
            cell[0 if g and p else 1 if p else 2 if g else 3] += 1
        out[(signal, label)] = tuple(cell)
    return out


HITS = st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["onderwerp", "beleving"]), st.sampled_from(["x", "y", "z", "q"])), max_size=25)
HIT = "doc_id long, signal_type string, label string"


@settings(max_examples=15, deadline=None)
@given(HITS, HITS)
def test_confusion_counts(spark, taxonomy, signals, gold, generated):
    counts = sc.confusion_counts(
        spark.createDataFrame(gold, HIT), spark.createDataFrame(generated, HIT), spark.range(5).withColumnRenamed("id", "doc_id"), taxonomy, signals
    ).collect()
    got = {(r["signal_type"], r["label"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in counts}
    assert got == plain_counts(set(gold), set(generated), range(5))
    assert all(sum(v) == 5 for v in got.values())


def test_scores(spark):
    counts = spark.createDataFrame(
        [("a", "l", 0, 0, 0, 9), ("a", "m", 2, 1, 3, 0), ("a", "n", 0, 4, 4, 0)], "signal_type string, label string, tp long, fp long, fn long, tn long"
    )
    got = {r["label"]: (r["precision"], r["recall"], r["f1_score"]) for r in sc.quality_scores(counts).collect()}
    assert got["l"] == got["n"] == (0.0, 0.0, 0.0)
    assert got["m"] == pytest.approx((2 / 3, 2 / 5, 0.5))
    merged = sc.scores_merge(counts, counts.filter("label = 'm'"))
    assert rows(merged) == [("a", "l", 0, 0, 0, 9), ("a", "m", 4, 2, 6, 0), ("a", "n", 0, 4, 4, 0)]


def test_invalid_labels(spark, taxonomy, signals):
    gold = spark.createDataFrame(
        [(1, 0, "x"), (1, 1, "bad"), (1, 2, "bad"), (2, 0, "worse"), (2, 1, "f"), (3, 0, "worse"), (4, 0, fixed.NO_LABEL)],
        "doc_id long, pos long, label string",
    )
    ranked = sc.invalid_labels_ranked(sc.invalid_label_counts(gold, taxonomy, signals))
    assert [(r["label"], r["occurrences"]) for r in ranked.collect()] == [("bad", 2), ("worse", 2), ("f", 1)]
    told = sc.invalid_label_summary(gold, spark.range(4), taxonomy, signals).first()
    assert (told["invalid_labels"], told["occurrences"], told["affected_rows"], told["total_rows"]) == (3, 5, 3, 4)
    assert (told["occurrence_percent"], told["affected_percent"]) == (125.0, 75.0)


def item(label, topic):
    return '{"@type":"DefinedTerm","name":"%s","inDefinedTermSet":{"name":"%s"}}' % (label, topic)


def test_evaluate(spark, taxonomy, signals, folder):
    dataset = spark.createDataFrame(
        [(1, "one", "['x', 'y']"), (2, "two", "[]"), (3, "three", "bad list"), (4, "four", "['x']")], "doc_id long, text string, gold_labels string"
    )
    docs = spark.createDataFrame(
        [(1, '{"about":[%s,%s]}' % (item("x", "A"), item("x", "A"))), (2, '{"about":%s}' % item("y", "B")), (3, "{}"), (4, '{"about":[]}')],
        "doc_id long, json_ld string",
    )
    done = evaluate(dataset, docs, taxonomy, signals)
    assert rows(done.rejects) == [(3, "no about")]
    assert rows(done.results) == [(1, "one", ["x", "y"], ["x", "x"]), (2, "two", [fixed.NO_LABEL], ["y"]), (4, "four", ["x"], [])]
    counts = {(r["signal_type"], r["label"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in done.counts.collect()}
    assert counts[("onderwerp", "x")] == (1, 0, 1, 1)
    assert counts[("beleving", "y")] == (0, 1, 1, 1)
    assert counts[("beleving", "z")] == (0, 0, 0, 3)
    sinks.write_report(done.results, done.scores, folder)
    assert sinks.read_report_scores(spark, folder).count() == done.scores.count()
    assert spark.read.json(f"{folder}/texts_and_labels").count() == 3
    with pytest.raises(ValueError, match="outside the taxonomy"):
        evaluate(dataset.withColumn("gold_labels", F.lit("['nowhere']")), docs, taxonomy, signals, on_invalid="fail")


BATCH = "doc_id long, signal_type string, gold array<string>, generated array<string>"


def labelled(batch):
    side = lambda c: batch.select("doc_id", "signal_type", F.explode(c).alias("label"))
    return side("gold"), side("generated")


def test_stream_equals_batch_and_restarts(spark, taxonomy, signals, folder):
    texts = [(i, "onderwerp" if i % 2 else "beleving", ["x", "y"][: i % 3], ["x", "z"][: (i + 1) % 3]) for i in range(30)]
    whole = spark.createDataFrame(texts, BATCH)

    def arrive(first, last):
        spark.createDataFrame(texts[first:last], BATCH).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def score(**options):
        stream = inc.text_files(spark, f"{folder}/in", BATCH, **options)
        return inc.evaluate_incremental(stream, labelled, taxonomy, signals, f"{folder}/out")

    arrive(0, 7)
    arrive(7, 12)
    score(files_per_batch=1)
    arrive(12, 30)
    got = rows(score().select("signal_type", "label", *sc.COUNTS))
    gold, generated = labelled(whole)
    assert got == rows(sc.confusion_counts(gold, generated, whole, taxonomy, signals))
    # A run without new files and a batch that is written again change nothing.
    assert rows(score().select("signal_type", "label", *sc.COUNTS)) == got


VERSIONED = f"{BATCH}, version int"


def test_the_last_version_of_a_text_counts_once(spark, taxonomy, signals, folder):
    first = [(i, "onderwerp", ["x"], ["z"], 1) for i in range(12)]
    files = [
        first[:4], first[4:8], first[8:],
        [(i, "onderwerp", ["x"], ["x"], 3) for i in range(2, 6)] + [(2, "onderwerp", ["y"], [], 2)],  # corrected, with an older one beside it
        [(i, "onderwerp", ["y"], ["y"], 2) for i in range(4, 8)],  # too late for 4 and 5
        [first[9], first[9], (None, "onderwerp", ["x"], ["x"], 9), (30, "beleving", [], ["x"], 0), (10, "beleving", None, None, 7)],
    ]

    def run(some):
        for rows_ in some:
            spark.createDataFrame(rows_, VERSIONED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = inc.text_files(spark, f"{folder}/in", VERSIONED, files_per_batch=1)
        return inc.evaluate_incremental(stream, labelled, taxonomy, signals, f"{folder}/out", F.col("version"), buckets=3)

    def expected(rows_):
        last = {}
        for r in rows_:
            if r[0] is not None and (r[0] not in last or last[r[0]][4] <= r[4]):
                last[r[0]] = r
        texts = spark.createDataFrame(list(last.values()), VERSIONED)
        return rows(sc.confusion_counts(*labelled(texts), texts, taxonomy, signals))

    counts = lambda df: rows(df.select("signal_type", "label", *sc.COUNTS))
    assert counts(run(files[:2])) == expected(sum(files[:2], []))
    got = counts(run(files[2:]))  # a restart, with four batches
    assert got == expected(sum(files, []))
    assert counts(run([])) == got
    assert spark.conf.get(inc.STORE) != inc.STORE_CLASS


def test_without_a_version_the_later_file_wins(spark, taxonomy, signals, folder):
    for n, label in enumerate(["x", "y", "z"]):
        spark.createDataFrame([(1, "onderwerp", [label], [label]), (n + 2, "onderwerp", [], [])], BATCH).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # file times have whole seconds on some systems
    stream = inc.text_files(spark, f"{folder}/in", BATCH)
    scores = inc.evaluate_incremental(stream, labelled, taxonomy, signals, f"{folder}/out")
    found = {r["label"]: (r["tp"], r["tn"]) for r in scores.filter("signal_type = 'onderwerp'").collect()}
    assert found["z"] == (1, 3) and found["x"] == (0, 4)


def test_a_failed_batch_runs_again_and_counts_once(spark, taxonomy, signals, folder):
    texts = [(i, "onderwerp", ["x"], ["x"]) for i in range(4)]
    spark.createDataFrame(texts, BATCH).coalesce(1).write.parquet(f"{folder}/in")
    stream = lambda: inc.text_files(spark, f"{folder}/in", BATCH)

    def broken(batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        inc.evaluate_incremental(stream(), broken, taxonomy, signals, f"{folder}/out")
    assert inc.total_scores(spark, f"{folder}/out").count() == 0
    scores = inc.evaluate_incremental(stream(), labelled, taxonomy, signals, f"{folder}/out")
    assert scores.filter("signal_type = 'onderwerp' AND label = 'x'").first()["tp"] == 4


def test_proposed_rows(spark):
    answers = spark.createDataFrame(
        [(1, '{"onderwerp_labels":["a","b"],"beleving_labels":["c"]}'), (2, '{"onderwerp_labels":[],"beleving_labels":["c"]}'), (3, "no"), (4, None)],
        "doc_id long, response string",
    )
    read = mc.structured_labels(answers)
    assert {r["doc_id"]: r["reject_reason"] for r in read.collect()} == {
        1: None, 2: "answer does not fit its type", 3: "answer does not fit its type", 4: "no response"
    }
    assert rows(mc.proposed_rows(read)) == [(1, "beleving", 0, "c"), (1, "onderwerp", 0, "a"), (1, "onderwerp", 1, "b")]
