"""Model calls and the whole job with local stand-ins."""

import pytest
from pyspark.sql import functions as F

from textgraph.functions import fixed, templates
from textgraph.operators import model_calls as mc
from textgraph.plans.text_to_graph import TextToGraph
from textgraph.session import run_folder, stage
from workload.fixtures import view
from workload.graph_queries import scripted_model, stores
from workload.text_queries import shipped, vowel_embedder

SF = "/root/testdata/sf0.001"


def asked(spark, humans):
    rows = [(i, f"call{i}", "s", h) for i, h in enumerate(humans)]
    return spark.createDataFrame(rows, "source_id long, call_name string, system_prompt string, human_prompt string")


def make_model():
    tried = {}

    def call(system, human):
        class RefusalError(Exception):
            pass

        tried[human] = tried.get(human, 0) + 1
        if human.startswith("refuse") and tried[human] <= int(human[-1]):
            raise RefusalError("will not")
        if human.startswith("limit") and tried[human] <= int(human[-1]):
            raise ValueError("Error 429: rate LIMIT")
        if human == "broken":
            raise KeyError("x")
        return "" if human == "silent" else f"{system}:{human}"

    return call


def test_retries(spark):
    humans = ["ok", "refuse1", "refuse3", "limit2", "limit3", "broken", "silent"]
    rows = mc.model_map(asked(spark, humans).coalesce(1), shipped_maker(), tries=3, wait=0.0).collect()
    got = {r["human_prompt"]: (r["response"], r["error"], r["attempts"]) for r in rows}
    assert got["ok"] == ("s:ok", None, 1)
    assert got["refuse1"] == ("s:refuse1", None, 2)
    assert got["refuse3"] == (None, "RefusalError: will not", 3)
    assert got["limit2"] == ("s:limit2", None, 3)
    assert got["limit3"][2] == 3 and got["limit3"][0] is None
    assert got["broken"] == (None, "KeyError: 'x'", 1)
    assert got["silent"] == ("", "no response", 1)


def shipped_maker():
    made = make_model()
    return lambda: made


def test_model_is_made_once_per_partition(spark):
    def counting():
        made = []

        def factory():
            made.append(1)
            return lambda system, human: str(len(made))

        return factory

    rows = mc.model_map(asked(spark, ["a"] * 20).coalesce(1), counting(), threads=4).collect()
    assert {r["response"] for r in rows} == {"1"}


def test_stored_answers_come_first(spark):
    stored = spark.createDataFrame([(0, "call0", "kept"), (2, "call2", "")], "source_id long, call_name string, assistant_response string")
    both = mc.answered(asked(spark, ["a", "b", "c"]), stored, shipped_maker())
    assert {r["source_id"]: (r["response"], r["error"]) for r in both.collect()} == {0: ("kept", None), 1: ("s:b", None), 2: ("", "no response")}
    only = mc.answered(asked(spark, ["a", "b", "c"]), stored)
    assert {r["source_id"]: r["error"] for r in only.collect()} == {0: None, 1: "no response", 2: "no response"}
    with pytest.raises(ValueError):
        mc.answered(asked(spark, ["a"]), None)


def test_choice_answers(spark):
    answers = spark.createDataFrame([
        ('{"reasoning":"r","selected_class":"A","selected_number":5}',), ('{"reasoning":"r","selected_class":"A","selected_number":6}',),
        ('{"selected_class":"A","selected_number":1}',), ("x",), (None,),
    ], "response string")
    assert [r["reject_reason"] for r in mc.structured_choice(answers).collect()] == [
        None, "answer does not fit its type", "answer does not fit its type", "answer does not fit its type", "no response"
    ]


def job(spark, **options):
    made = dict(models=shipped(scripted_model), embedder=shipped(vowel_embedder), add_labels=True, wait=0.0)
    return TextToGraph(stores(spark, SF), **{**made, **options})


TEXTS = [
    (0, "a text of more than forty characters, even!!"), (1, "a text of more than forty characters, odd!!"), (2, "short"), (3, ""),
    (4, "quoted \"text\" with { braces } and | bars | and more"),
]


def run(spark, job):
    return {r["doc_id"]: r for r in job.run(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()}


def test_whole_job_and_its_log(spark, folder):
    done = run(spark, job(spark, log_path=f"{folder}/log", worker_id="w"))
    assert len(done) == len(TEXTS)
    assert {k: (r["extraction_failed"], r["runs"], r["code"]) for k, r in done.items()} == {
        0: (False, 0, 0), 1: (False, 1, 0), 2: (True, 0, 0), 3: (True, 0, 0), 4: (False, len(TEXTS[4][1]) % 2, 0),
    }
    assert done[2]["labels"] == [fixed.NO_LABEL] and fixed.NO_TOPIC in done[2]["json_ld"]
    log = spark.read.parquet(f"{folder}/log")
    names = {r["call_name"]: r["n"] for r in log.groupBy("call_name").agg(F.count("*").alias("n")).collect()}
    odd = sum(len(t) % 2 for i, t in TEXTS if len(t) >= 40)
    assert names == {
        "n1_entity_extraction": 5, "n2_schema_selection_Word": 3, "n2_schema_selection_Text": 3,
        "n3_transform_to_kg_run_0": 3, "n3_transform_to_kg_run_1": odd, "n5_add_labels": 3,
    }
    # The log answers the same job without a model.
    again = run(spark, job(spark, models=None, answers=log))
    assert {k: (r["json_ld"], r["labels"], r["runs"]) for k, r in again.items()} == {
        k: (r["json_ld"], r["labels"], r["runs"]) for k, r in done.items()
    }


def test_two_runs_of_one_job(spark):
    one = job(spark)
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    first, second = one.run(texts), one.run(texts)
    assert first.exceptAll(second).count() == 0 and first.count() == len(TEXTS)


def test_calls_survive_a_stop(spark, folder):
    """A step that stops between slices has logged what it asked; the next run asks for the rest."""
    log, flag, model = f"{folder}/log", f"{folder}/go", scripted_model()

    def stopping():
        import glob
        import os

        if not os.path.exists(flag) and len(glob.glob(f"{log}/call_kind=n1*/*.parquet")) >= 2:
            raise RuntimeError("stopped")
        return model

    texts = [(n, f"text number {n}, which has more than forty characters in it") for n in range(12)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    made = dict(models=stopping, log_path=log, slices=4, partitions=1, add_labels=False)
    with pytest.raises(Exception, match="stopped"):
        job(spark, **made).run(rows)
    kept = spark.read.parquet(log).select("source_id").collect()
    assert 0 < len(kept) < len(texts)
    open(flag, "w").close()
    done = job(spark, **made, answers=spark.read.parquet(log)).run(rows)
    assert done.count() == len(texts)
    asked = spark.read.parquet(log).filter("call_kind = 'n1_entity_extraction'")
    assert asked.count() == len(texts) == asked.select("source_id").distinct().count()
    assert asked.select("created_at").distinct().count() > 1


def test_repeated_log_rows_count_once(spark):
    rows = [(0, "call0", "old", "2024-01-01"), (0, "call0", "new", "2024-01-02"), (0, "call0", "older", "2023-01-01")]
    stored = spark.createDataFrame(rows, "source_id long, call_name string, assistant_response string, created_at string")
    got = mc.answered(asked(spark, ["a"]), stored.withColumn("created_at", F.col("created_at").cast("timestamp"))).collect()
    assert [r["response"] for r in got] == ["new"]


def failing_embedder():
    tried = {}

    def embed(texts):
        for text in texts:
            tried[text] = tried.get(text, 0) + 1
            if text.startswith("bad") or "Word" in text:
                raise ValueError("no vector for this")
            if text.startswith("limit") and tried[text] < 3:
                raise ValueError("429")
        return [[1.0, 2.0, 3.0, 4.0, 5.0]] * len(texts)

    return embed


def test_embedder_fails_by_text(spark):
    texts = spark.createDataFrame([("a",), ("bad",), ("limit",), ("b",)], "embed_text string").coalesce(1)
    got = {r["embed_text"]: (r["embedding"] is None, r["error"]) for r in mc.embed_map(texts, shipped(failing_embedder), wait=0.0).collect()}
    assert got == {"a": (False, None), "b": (False, None), "limit": (False, None), "bad": (True, "ValueError: no vector for this")}


def test_a_bad_text_costs_few_calls(spark):
    def counting():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            if "bad" in texts:
                raise ValueError("no vector for this")
            return [[float(len(calls))]] * len(texts)

        return embed

    texts = spark.createDataFrame([(f"t{n}",) for n in range(1999)] + [("bad",)], "embed_text string").coalesce(1)
    rows = mc.embed_map(texts, shipped(counting), wait=0.0).collect()
    assert [r["embed_text"] for r in rows if r["embedding"] is None] == ["bad"]
    assert len(rows) == 2000 and max(r["embedding"][0] for r in rows if r["embedding"]) <= 2 * 11 + 1


def test_a_limit_makes_batches_smaller(spark):
    def small_only():
        calls = []

        def embed(texts):
            calls.append(1)
            if sum(map(len, texts)) > 600:
                raise ValueError("Error 429")
            return [[float(len(calls))]] * len(texts)

        return embed

    texts = spark.createDataFrame([(f"{n:010d}",) for n in range(2000)], "embed_text string").coalesce(1)
    rows = mc.embed_map(texts, shipped(small_only), wait=0.0, batch_bytes=1000).collect()
    assert len(rows) == 2000
    assert all(r["error"] is None for r in rows)
    assert max(r["embedding"][0] for r in rows if r["embedding"]) < 200


def test_a_service_that_stays_limited_is_not_asked_text_by_text(spark):
    def limited():
        calls = []

        def embed(texts):
            calls.append(1)
            raise ValueError(f"429 after {len(calls)}")

        return embed

    texts = spark.createDataFrame([(f"t{n}",) for n in range(500)], "embed_text string").coalesce(1)
    rows = mc.embed_map(texts, shipped(limited), wait=0.0).collect()
    assert len(rows) == 500 and max(int(r["error"].rsplit(" ", 1)[1]) for r in rows) <= 7


def timed():
    import time

    def call(system, human):
        if human == "slow":
            time.sleep(3)
        return str(time.time())

    return call


def test_all_tasks_together_keep_the_rate(spark):
    rows = mc.model_map(asked(spark, [f"h{n}" for n in range(96)]), shipped(timed), partitions=8, threads=4, rate=40.0).collect()
    at = sorted(float(r["response"]) for r in rows)
    assert len(at) == 96
    assert all(b - a > 0.9 for a, b in zip(at, at[41:]))  # at most 40 in a second, and one at its edge


def test_a_slow_call_holds_up_no_other(spark):
    rows = mc.model_map(asked(spark, ["slow"] + [f"h{n}" for n in range(400)]).coalesce(1), shipped(timed), threads=4, partitions=0).collect()
    at = {r["human_prompt"]: float(r["response"]) for r in rows}
    others = [t for h, t in at.items() if h != "slow"]
    assert len(at) == 401 and max(others) < at["slow"] - 1


def test_a_class_without_a_vector_is_reported(spark):
    made = job(spark, embedder=shipped(failing_embedder))
    done = run(spark, made)
    assert len(done) == len(TEXTS)
    dropped = made.dropped_classes.collect()
    assert {r["class_name"] for r in dropped} == {"Word"} and {r["doc_id"] for r in dropped} == {0, 1, 4}


def test_a_failed_label_call_is_no_score(spark, folder):
    from textgraph.plans.scored_run import REJECTS, scored_run
    from textgraph.sources.tables import read_or_empty

    def limited():
        made = scripted_model()

        def call(system, human):
            if system == templates.LABEL_SYSTEM:
                raise ValueError("429 rate limit")
            return made(system, human)

        return call

    made = stores(spark, SF)
    data = spark.createDataFrame([(i, t, "['NATION_0']") for i, t in TEXTS[:3]], "doc_id long, text string, gold_labels string")
    scores = scored_run(data, job(spark, models=shipped(limited)).run, made.taxonomy, made.signals, folder, on_invalid="keep")
    rejects = {r["source_id"]: r["reject_reason"] for r in read_or_empty(spark, f"{folder}/rejects", REJECTS).collect()}
    assert set(rejects) == {0, 1}  # the third text needs no label call
    assert scores.agg(F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).first()[0] == 1


def test_job_without_labels(spark):
    done = run(spark, job(spark, add_labels=False))
    assert all(r["labels"] == [] and "about" not in r["json_ld"] for r in done.values())


def test_missing_models_are_named(spark):
    with pytest.raises(ValueError, match="n3, n5"):
        job(spark, models={"n1": make_model, "n2": make_model})
    with pytest.raises(ValueError):
        job(spark, models=None)


def test_lost_vocabulary_stops_the_job(spark):
    broken = stores(spark, SF)
    broken.class_parents = broken.class_parents.limit(0)
    made = TextToGraph(broken, models=shipped(scripted_model), embedder=shipped(vowel_embedder))
    with pytest.raises(RuntimeError, match="Infrastructure error in validator: no vocabulary"):
        run(spark, made)


def test_an_answer_without_an_object_is_rejected(spark):
    def no_json():
        made = scripted_model()
        return lambda system, human: "sorry" if "JSON-LD" in system else made(system, human)

    done = run(spark, job(spark, models=shipped(no_json)))
    assert done[0]["reject_reason"] == "no JSON object in the answer" and done[2]["extraction_failed"]


def test_shared_folder_is_that_of_the_session(spark):
    assert run_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert view(spark, SF, "orders").count() > 0


def test_scored_run_in_slices(spark, folder):
    from textgraph.operators.scoring import COUNTS
    from textgraph.plans.evaluate import evaluate
    from textgraph.plans.scored_run import REJECTS, RESULTS, scored_run, write_scored_report
    from textgraph.sources.tables import read_or_empty

    data = spark.createDataFrame(
        [(i, t, ["['NATION_0']", "['NATION_3', 'NATION_4']", "[]", "bad", "['NATION_0', 'NATION_9']"][i]) for i, t in TEXTS],
        "doc_id long, text string, gold_labels string",
    )
    made = stores(spark, SF)
    short = lambda texts: TextToGraph(made, models=shipped(scripted_model), embedder=shipped(vowel_embedder), add_labels=True).run(texts)
    lost = []

    def run(texts):
        if not lost:
            lost.append(1)
            raise RuntimeError("lost")
        return short(texts).withColumn("json_ld", F.when(F.col("doc_id") != 1, F.col("json_ld"))).withColumn(
            "reject_reason", F.when(F.col("doc_id") == 1, "dropped")
        )

    step = lambda: scored_run(data, run, made.taxonomy, made.signals, folder, limit=2, on_invalid="keep")
    with pytest.raises(RuntimeError, match="lost"):
        step()
    first = step()
    assert first.agg(F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).first()[0] == 1
    step()
    scores = step()
    assert step() is None
    whole = evaluate(data.filter("doc_id <> 1"), short(data.select("doc_id", "text")), made.taxonomy, made.signals)
    columns = ["signal_type", "label", *COUNTS]
    assert sorted(map(tuple, scores.select(columns).collect())) == sorted(map(tuple, whole.counts.select(columns).collect()))
    assert [r["source_id"] for r in read_or_empty(spark, f"{folder}/results", RESULTS).orderBy("source_id").collect()] == [0, 2, 3, 4]
    assert [(r["source_id"], r["reject_reason"]) for r in read_or_empty(spark, f"{folder}/rejects", REJECTS).collect()] == [(1, "dropped")]
    write_scored_report(spark, folder)
    assert spark.read.json(f"{folder}/report/texts_and_labels").count() == 4
    with pytest.raises(ValueError, match="outside the taxonomy"):
        scored_run(data, run, made.taxonomy.limit(1), made.signals, f"{folder}/other", limit=5)


def test_tables_that_grow_with_the_texts_are_not_broadcast(spark, monkeypatch):
    """Tables of repeated texts are small as files only; one of 7 MB did not fit a driver of 1 GB."""
    from textgraph.plans import repair, schema_mapping, text_to_graph

    plans = []

    def noted(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, path)

    for module in (repair, schema_mapping, text_to_graph):
        monkeypatch.setattr(module, "stage", noted)
    done = run(spark, job(spark))
    assert len(done) == len(TEXTS)
    assert any("SortMergeJoin [doc_id" in p for p in plans)
    met = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin [doc_id" in line]
    assert all(", LeftSemi, " in line and "class_name" not in line for line in met)  # ids to be repaired, counted before
