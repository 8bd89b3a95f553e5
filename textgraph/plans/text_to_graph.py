"""The whole job: texts in, validated and labelled graph documents out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from textgraph.functions import fixed, templates
from textgraph.functions.joins import row_join
from textgraph.operators import extraction as ex, jsonld, labels as lb, model_calls as mc, prompts, validation as va
from textgraph.operators.vocabulary import definition_compact, raw_definition
from textgraph.plans.repair import final_documents, repair_loop
from textgraph.plans.schema_mapping import class_mentions, resolve_classes, with_candidates
from textgraph.session import run_folder, stage
from textgraph.sources.sinks import append_call_log, call_kind

# Steps and how the names of their calls start.
STEPS = {"n1": fixed.CALL_EXTRACT, "n2": fixed.CALL_SELECT, "n3": fixed.CALL_TRANSFORM, "n5": fixed.CALL_LABELS}


LOGGED_SLICES = 8


@dataclass
class Stores:
    """What the job reads beside the texts.

    classes: class_id, class_label, comments, embedding. definitions: nested
    definitions of ``operators.vocabulary``. class_parents (label, parent) and
    class_properties (class_label, property, range) feed the validation.
    taxonomy and signals are needed for labels only.
    """

    classes: DataFrame
    definitions: DataFrame
    class_parents: DataFrame
    class_properties: DataFrame
    taxonomy: DataFrame | None = None
    signals: DataFrame | None = None


@dataclass
class TextToGraph:
    """The job with its models.

    ``models`` is one factory for all steps or one per step (n1, n2, n3 and,
    with labels, n5); a step may go without where ``answers`` holds all its
    calls. ``embedder`` makes vectors of texts, unless ``vectors`` has them.
    ``partitions`` tasks of ``threads`` calls each ask at a time.

    The calls of a step go in ``slices`` by the hash of their source, each
    answered, stored and logged before the next: a run that is stopped loses the
    calls of one slice, and one with ``answers`` from its log asks for the rest.
    Every run has a folder of its own below ``folder``. ``model_name`` is one name
    or one per step. After a run ``dropped_classes`` has the classes that got no
    vector: doc_id, class_name, error.
    """

    stores: Stores
    models: Callable | dict[str, Callable] | None = None
    answers: DataFrame | None = None
    embedder: Callable | None = None
    vectors: DataFrame | None = None
    add_labels: bool = False
    folder: str | None = None
    log_path: str | None = None
    worker_id: str = "spark"
    model_name: str | dict[str, str] = "unknown"
    threads: int = 1
    partitions: int | None = None
    slices: int | None = None
    tries: int = fixed.MAX_TRIES
    wait: float = 1.0
    max_runs: int = fixed.MAX_RUNS
    dropped_classes: DataFrame | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        needed = [s for s in STEPS if s != "n5" or self.add_labels]
        if isinstance(self.models, dict):
            missing = [s for s in needed if s not in self.models]
            if missing and self.answers is None:
                raise ValueError(f"no model for: {', '.join(missing)}")
        elif self.models is not None:
            self.models = dict.fromkeys(needed, self.models)
        elif self.answers is None:
            raise ValueError("a model or stored answers are needed")

    def _stored(self, step: str) -> DataFrame | None:
        """The stored answers of a step; of a log only its folder is read."""
        if self.answers is None:
            return None
        found = self.answers.filter(F.col("call_name").startswith(STEPS[step]))
        if "call_kind" in found.columns:
            found = found.filter(F.col("call_kind") == call_kind(F.lit(STEPS[step])))
        return found

    def _call(self, step: str, rows: DataFrame, system: str, name: str) -> DataFrame:
        """Ask, write the answers, log them. ``rows`` has doc_id, call_name, human_prompt.

        Prompts repeat whole texts, so they are written only for a log.
        """
        keys = [c for c in ("doc_id", "class_name") if c in rows.columns]
        asked = rows.select(
            *keys, F.col("doc_id").alias("source_id"), "call_name", F.lit(system).alias("system_prompt"), "human_prompt"
        )
        model = (self.models or {}).get(step)
        options = {"tries": self.tries, "wait": self.wait, "threads": self.threads, "partitions": self.partitions}
        model_name = self.model_name.get(step, "unknown") if isinstance(self.model_name, dict) else self.model_name
        slices = self.slices or (LOGGED_SLICES if self.log_path else 1)
        parts = []
        for number in range(slices):
            part = asked.filter(F.pmod(F.xxhash64("source_id"), F.lit(slices)) == number) if slices > 1 else asked
            made = mc.answered(part, self._stored(step), model, **(options if model else {}))
            made = made if self.log_path else made.drop("system_prompt", "human_prompt")
            calls = stage(made, f"{self.folder}/{name}/slice={number}")
            if self.log_path:
                logged = mc.call_log_rows(calls.filter("attempts > 0"), F.lit(self.worker_id), F.lit(model_name))
                append_call_log(logged, self.log_path)
            parts.append(calls)
        return reduce(DataFrame.unionByName, parts)

    def run(self, texts: DataFrame) -> DataFrame:
        """Texts (doc_id, text) to documents: doc_id, json_ld, code, output,
        runs, labels, extraction_failed, reject_reason."""
        folder = f"{self.folder}/{uuid4().hex}" if self.folder else run_folder(texts.sparkSession, "graph")
        own = replace(self, folder=folder)
        result = own._run(texts.select("doc_id", "text"))
        self.dropped_classes = own.dropped_classes
        return result

    def _run(self, texts: DataFrame) -> DataFrame:

        asked = prompts.extract_prompt(texts).withColumn("call_name", F.lit(fixed.CALL_EXTRACT))
        calls = self._call("n1", asked, templates.EXTRACT_SYSTEM, "n1")
        parsed = stage(
            ex.extraction(calls.select("doc_id", "response")).drop("response"), f"{self.folder}/extraction"
        )
        usable = parsed.filter("reject_reason IS NULL AND NOT extraction_failed")
        mapping = self._map_classes(texts, usable)
        rounds = self._transform(texts, usable, mapping)
        done = stage(
            final_documents(rounds).select("doc_id", "json_ld", "code", "output", "runs"), f"{self.folder}/documents"
        )
        failed = va.failed_branch(parsed).withColumn("runs", F.lit(0))
        rejected = parsed.filter("reject_reason IS NOT NULL").select("doc_id", "reject_reason").unionByName(
            rounds.filter("route = 'reject'").select("doc_id", "reject_reason")
        )
        if self.add_labels:
            done = self._label(texts, done)
            own = jsonld.add_terms(
                failed.drop("label"),
                lb.topic_of_label(failed.select("doc_id", F.lit(0).cast("long").alias("pos"), "label"), self.stores.taxonomy),
            ).withColumn("labels", F.array(F.lit(fixed.NO_LABEL)))
        else:
            none = F.array().cast("array<string>")
            done = done.withColumns({"labels": none, "reject_reason": F.lit(None).cast("string")})
            own = failed.drop("label").withColumns({"labels": none, "reject_reason": F.lit(None).cast("string")})
        return stage(
            done.withColumn("extraction_failed", F.lit(False))
            .unionByName(own.withColumn("extraction_failed", F.lit(True)))
            .unionByName(rejected.withColumn("extraction_failed", F.lit(False)), allowMissingColumns=True),
            f"{self.folder}/result",
        )

    def _map_classes(self, texts: DataFrame, usable: DataFrame) -> DataFrame:
        mentions = stage(class_mentions(usable), f"{self.folder}/mentions")
        vectors = self.vectors
        if vectors is None:
            vectors = mc.embed_map(mentions, self.embedder, tries=self.tries, wait=self.wait)
        vectors = stage(
            row_join(vectors, mentions.select("embed_text").distinct(), "embed_text", "left_semi"), f"{self.folder}/vectors"
        )
        if "error" in vectors.columns:
            failed = vectors.filter("embedding IS NULL").select("embed_text", "error")
            self.dropped_classes = stage(
                row_join(mentions, failed, "embed_text").select("doc_id", "class_name", "error"), f"{self.folder}/dropped"
            )
            vectors = vectors.filter("embedding IS NOT NULL").drop("error")
        topk = stage(with_candidates(mentions, vectors, self.stores.classes, self.folder), f"{self.folder}/topk")
        asked = prompts.select_prompt(row_join(topk, texts, "doc_id")).withColumn(
            "call_name", F.concat(F.lit(fixed.CALL_SELECT), "class_name")
        )
        calls = self._call("n2", asked, templates.SELECT_SYSTEM, "n2")
        choices = mc.structured_choice(calls)
        return stage(resolve_classes(topk, self.stores.definitions, choices), f"{self.folder}/mapping")

    def _transform(self, texts: DataFrame, usable: DataFrame, mapping: DataFrame) -> DataFrame:
        defined = stage(
            definition_compact(self.stores.definitions).select("label", "compact", raw_definition().alias("raw")),
            f"{self.folder}/definitions",
        )
        blocks = prompts.schema_blocks(mapping, ex.entities_with_schema(usable, mapping), defined)
        inputs = stage(
            row_join(row_join(texts, usable.select("doc_id", "relations"), "doc_id"), blocks, "doc_id", "left"),
            f"{self.folder}/inputs",
        )
        vocabulary = va.prepare_vocabulary(
            self.stores.class_parents, self.stores.class_properties, f"{self.folder}/vocabulary"
        )

        def answer(open_docs: DataFrame, number: int) -> DataFrame:
            asked = prompts.transform_prompt(open_docs).withColumn("call_name", F.lit(f"{fixed.CALL_TRANSFORM}{number}"))
            return self._call("n3", asked, templates.TRANSFORM_SYSTEM, f"n3/round={number}")

        return repair_loop(
            inputs, answer, lambda docs: va.jsonld_validate(docs, vocabulary), f"{self.folder}/repair", self.max_runs
        )

    def _label(self, texts: DataFrame, done: DataFrame) -> DataFrame:
        offered = lb.offered_labels(self.stores.taxonomy, self.stores.signals)
        asked = prompts.label_prompt(row_join(texts, done.select("doc_id"), "doc_id"), offered).withColumn(
            "call_name", F.lit(fixed.CALL_LABELS)
        )
        calls = self._call("n5", asked, templates.LABEL_SYSTEM, "n5")
        answers = mc.structured_labels(calls)
        allowed = lb.allowed_labels(mc.proposed_rows(answers), offered)
        ordered = stage(lb.labels_concat(allowed), f"{self.folder}/labels")
        termed = jsonld.add_terms(done, lb.topic_of_label(ordered, self.stores.taxonomy))
        names = F.sort_array(F.collect_list(F.struct("pos", "label")))
        lists = ordered.groupBy("doc_id").agg(F.transform(names, lambda n: n["label"]).alias("labels"))
        unread = answers.filter("answer IS NULL").select("doc_id", F.col("reject_reason").alias("label_reason"))
        return (
            row_join(row_join(termed, lists, "doc_id", "left"), unread, "doc_id", "left")
            .withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
            .withColumn("reject_reason", F.coalesce("reject_reason", "label_reason")).drop("label_reason")
        )


def result_summary(parsed: DataFrame, mapping: DataFrame, final: DataFrame, max_runs: int = fixed.MAX_RUNS) -> DataFrame:
    """Per text: summary, counts, class mapping, status, attempts, last output."""
    pair = F.struct("pos", F.concat("class_name", F.lit(" → "), "schema_label").alias("text"))
    classes = mapping.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["text"]), "; ").alias("classes")
    )
    counts = parsed.select("doc_id", "summary", F.size("entities").alias("entities"), F.size("relations").alias("relations"))
    return (
        row_join(row_join(counts, classes, "doc_id", "left"), final.select("doc_id", "code", "output", "runs"), "doc_id", "left")
        .select(
            "doc_id", "summary", "entities", "relations", F.coalesce("classes", F.lit("")).alias("classes"),
            F.when(F.col("code") == 0, "PASSED").otherwise("FAILED").alias("status"),
            F.concat(F.coalesce("runs", F.lit(0)).cast("string"), F.lit(f"/{max_runs}")).alias("attempts"),
            F.coalesce("output", F.lit("")).alias("last_output"),
        )
    )
