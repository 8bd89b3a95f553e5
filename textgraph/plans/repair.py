"""Transform, validate, route: rounds of repair over the open documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from textgraph.functions import fixed
from textgraph.functions.joins import lookup_join, row_join
from textgraph.operators.jsonld import extract_documents
from textgraph.operators.validation import attempt_state, route_outcome
from textgraph.session import stage

# A generous size of one document key.
KEY_BYTES = 100
# Fields of a round's table.
ROUND = ["doc_id", "json_ld", "code", "output", "runs", "max_reached", "infrastructure_error", "route", "reject_reason"]


def repair_loop(
    docs: DataFrame,
    answer: Callable[[DataFrame, int], DataFrame],
    validate: Callable[[DataFrame], DataFrame],
    folder: str,
    max_runs: int = fixed.MAX_RUNS,
) -> DataFrame:
    """Rounds until no document is open, at most ``max_runs``.

    ``docs`` has doc_id and whatever a prompt needs. ``answer(open, round)``
    gives one row (doc_id, response) per open document, where the response may
    be NULL; ``open`` has the columns of ``docs``, runs, previous_json_ld and
    previous_output; answers are asked for once. ``validate(docs)`` gives
    (doc_id, code, output).

    Every round is a written table. A round writes the inputs of the documents
    it leaves open, so the next one reads these only and not all inputs again.
    An infrastructure error stops the job after its round is stored.

    Returns all rounds: the fields of ``ROUND`` and ``round``.
    """
    none = F.lit(None).cast("string")
    open_docs = docs.withColumns({"runs": F.lit(0), "previous_json_ld": none, "previous_output": none})
    rounds = None
    for number in range(max_runs):
        answers = stage(extract_documents(answer(open_docs, number)).select(
            "doc_id", F.lit(number).alias("runs"), "json_ld", "reject_reason"
        ), f"{folder}/answers/round={number}")
        checked = validate(answers.filter("json_ld IS NOT NULL").select("doc_id", "json_ld"))
        judged = attempt_state(row_join(answers, checked, "doc_id", "left"), max_runs)
        route = F.when(F.col("json_ld").isNull(), "reject").otherwise(route_outcome())
        done = stage(judged.withColumn("route", route).select(*ROUND), f"{folder}/rounds/round={number}")
        part = done.withColumn("round", F.lit(number))
        rounds = part if rounds is None else rounds.unionByName(part)
        routes = {r["route"]: r["n"] for r in done.groupBy("route").agg(F.count("*").alias("n")).collect()}
        if "halt" in routes:
            told = done.filter("route = 'halt'").select("output").first()["output"]
            raise RuntimeError(f"Infrastructure error in validator: {told}")
        if "repair" not in routes:
            break
        repair = done.filter("route = 'repair'").select(
            "doc_id", "runs", F.col("json_ld").alias("previous_json_ld"), F.col("output").alias("previous_output")
        )
        inputs = lookup_join(
            open_docs.select(*docs.columns), repair.select("doc_id"), ["doc_id"], "left_semi",
            size=routes["repair"] * KEY_BYTES,
        )
        open_docs = stage(row_join(inputs, repair, "doc_id"), f"{folder}/open/round={number + 1}")
    return rounds


def final_documents(rounds: DataFrame) -> DataFrame:
    """The last row of each document; all earlier ones went to repair."""
    return rounds.filter("route = 'label'")
