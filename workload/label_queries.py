"""Queries on labels and scores, with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from textgraph.operators import labels as lb, prompts, scoring as sc
from textgraph.functions import templates
from textgraph.plans import evaluate as ev
from textgraph.operators import jsonld as jl
from textgraph.session import run_folder, spread, stage
from textgraph.sources import sinks
from textgraph.streaming import incremental as inc
from workload.fixtures import view
from workload.text_queries import _template, query


def taxonomy(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_taxonomy")


def signals(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_signals")


def part_labels(spark, sf) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf, "fx_part_taxonomy"), view(spark, sf, "fx_part_signals")


@query("taxonomy_load", """
SELECT main_topic, pos, sub_topic FROM fx_part_taxonomy ORDER BY main_topic, pos
""")
def taxonomy_load(spark, sf):
    return lb.taxonomy_rows(part_labels(spark, sf)[0])


@query("valid_label_set", """
SELECT DISTINCT sub_topic AS label FROM fx_part_taxonomy WHERE main_topic IN (SELECT main_topic FROM fx_part_signals)
UNION SELECT 'No subtopic found' AS label
""")
def valid_label_set(spark, sf):
    return lb.valid_label_set(*part_labels(spark, sf))


READING = "reading AS (SELECT main_topic, min_by(signal_type, priority) AS signal_type FROM fx_signals GROUP BY main_topic)"
OFFERED = f"""
{READING}, listed AS (SELECT signal_type, t.main_topic, pos, sub_topic AS label, 0 AS added FROM fx_taxonomy t JOIN reading r ON t.main_topic = r.main_topic),
offered AS (SELECT * FROM listed UNION ALL
  SELECT s, NULL, NULL, 'No subtopic found', 1 FROM (VALUES ('onderwerp'), ('beleving')) v(s)
  WHERE NOT EXISTS (SELECT 1 FROM listed WHERE signal_type = s AND label = 'No subtopic found'))
"""


def offered(spark, sf) -> DataFrame:
    return lb.offered_labels(taxonomy(spark, sf), signals(spark, sf))


def _listing(signal: str) -> str:
    return f"(SELECT string_agg(label, chr(10) ORDER BY added, main_topic, pos) FROM offered WHERE signal_type = '{signal}')"


@query("prompt_labels", f"""
WITH {OFFERED}
SELECT doc_id, {_template(templates.LABEL_HUMAN, ONDERWERP_LIST=_listing('onderwerp'), BELEVING_LIST=_listing('beleving'), INPUT_TEXT='text')} AS human_prompt
FROM documents
""")
def prompt_labels(spark, sf):
    return prompts.label_prompt(view(spark, sf, "documents"), offered(spark, sf)).select("doc_id", "human_prompt")


ALLOWED = f"{OFFERED.strip()}, allowed AS (SELECT p.* FROM fx_proposed p WHERE (signal_type, label) IN (SELECT (signal_type, label) FROM offered))"


def allowed(spark, sf) -> DataFrame:
    return lb.allowed_labels(view(spark, sf, "fx_proposed"), offered(spark, sf))


@query("allowed_labels", f"WITH {ALLOWED} SELECT doc_id, signal_type, label, pos FROM allowed")
def allowed_labels(spark, sf):
    return allowed(spark, sf).select("doc_id", "signal_type", "label", "pos")


@query("rejected_labels", f"""
WITH {OFFERED} SELECT p.* FROM fx_proposed p ANTI JOIN offered o ON p.signal_type = o.signal_type AND p.label = o.label
""")
def rejected_labels(spark, sf):
    return lb.rejected_labels(view(spark, sf, "fx_proposed"), offered(spark, sf)).select("doc_id", "signal_type", "label", "pos")


@query("labels_concat", f"""
WITH {ALLOWED} SELECT doc_id, CASE WHEN signal_type = 'onderwerp' THEN 1 ELSE 2 END AS part, pos AS place, label FROM allowed
""")
def labels_concat(spark, sf):
    return lb.labels_concat(allowed(spark, sf)).select("doc_id", "pos.part", "pos.place", "label")


@query("topic_of_label", """
SELECT g.doc_id, g.pos, g.label, t.main_topic FROM fx_gold g
LEFT JOIN (SELECT sub_topic, min(main_topic) AS main_topic FROM fx_taxonomy GROUP BY sub_topic) t ON t.sub_topic = g.label
""")
def topic_of_label(spark, sf):
    return lb.topic_of_label(view(spark, sf, "fx_gold"), taxonomy(spark, sf))


LABEL_SIGNAL = """
label_signal AS (SELECT sub_topic AS label, min_by(signal_type, priority) AS signal_type FROM fx_taxonomy t JOIN fx_signals s ON t.main_topic = s.main_topic GROUP BY sub_topic),
gold AS (SELECT g.doc_id, g.label, g.pos, signal_type FROM fx_gold g JOIN label_signal l ON g.label = l.label)
"""


def gold(spark, sf) -> DataFrame:
    return lb.split_gold_by_signal(view(spark, sf, "fx_gold"), taxonomy(spark, sf), signals(spark, sf))


@query("split_gold_by_signal", f"WITH {LABEL_SIGNAL} SELECT * FROM gold")
def split_gold_by_signal(spark, sf):
    return gold(spark, sf)


@query("skipped_gold", f"WITH {LABEL_SIGNAL} SELECT g.* FROM fx_gold g WHERE label NOT IN (SELECT label FROM label_signal)")
def skipped_gold(spark, sf):
    return lb.skipped_gold(view(spark, sf, "fx_gold"), taxonomy(spark, sf), signals(spark, sf))


def _counts(gold_rows: str, generated: str, texts: str) -> str:
    """Counts by plain membership, one row per counted label and text with either."""
    return f"""
pairs_seen AS (SELECT doc_id, signal_type, label FROM {gold_rows} UNION SELECT doc_id, signal_type, label FROM {generated}),
judged AS (SELECT s.*, (doc_id, signal_type, label) IN (SELECT (doc_id, signal_type, label) FROM {gold_rows}) AS g,
                  (doc_id, signal_type, label) IN (SELECT (doc_id, signal_type, label) FROM {generated}) AS p FROM pairs_seen s),
counted AS (SELECT DISTINCT signal_type, sub_topic AS label FROM fx_taxonomy t JOIN fx_signals s ON t.main_topic = s.main_topic),
counts AS (SELECT c.signal_type, c.label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn
           FROM counted c LEFT JOIN judged j ON j.signal_type = c.signal_type AND j.label = c.label GROUP BY c.signal_type, c.label),
full_counts AS (SELECT signal_type, label, tp, fp, fn, (SELECT count(*) FROM {texts}) - tp - fp - fn AS tn FROM counts),
ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS r FROM full_counts),
scores AS (SELECT signal_type, label, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
                  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1_score FROM ratios)
"""


SCORED = f"{ALLOWED}, {LABEL_SIGNAL.strip()}, {_counts('gold', 'allowed', 'fx_text')}"


def counts(spark, sf) -> DataFrame:
    return sc.confusion_counts(
        gold(spark, sf), allowed(spark, sf), view(spark, sf, "fx_text"), taxonomy(spark, sf), signals(spark, sf)
    )


def rounded(scores: DataFrame) -> DataFrame:
    names = ["precision", "recall", "f1_score"]
    return scores.select("signal_type", "label", *sc.COUNTS, *[F.round(c, 6).alias(c) for c in names])


@query("confusion_counts", f"WITH {SCORED} SELECT * FROM full_counts")
def confusion_counts(spark, sf):
    return counts(spark, sf)


@query("quality_scores", f"WITH {SCORED} SELECT * FROM scores")
def quality_scores(spark, sf):
    return rounded(sc.quality_scores(counts(spark, sf)))


@query("scores_merge", f"""
WITH {SCORED}
SELECT signal_type, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn
FROM (SELECT * FROM full_counts UNION ALL SELECT 'onderwerp', p_name, count(*), 0, 0, 0 FROM part GROUP BY p_name UNION ALL SELECT * FROM full_counts) x
GROUP BY signal_type, label
""")
def scores_merge(spark, sf):
    folder = run_folder(spark, "scores")
    batch = counts(spark, sf)
    zero = F.lit(0).cast("long")
    stored = view(spark, sf, "part").groupBy(F.lit("onderwerp").alias("signal_type"), F.col("p_name").alias("label")).agg(
        F.count("*").alias("tp")
    ).withColumns({"fp": zero, "fn": zero, "tn": zero})
    sinks.write_scores(sc.scores_merge(stored, batch), folder, 1)
    sinks.write_scores(sc.scores_merge(sinks.read_scores(spark, folder, 1), batch), folder, 2)
    return sinks.read_scores(spark, folder, 2)


@query("write_report", f"WITH {SCORED} SELECT * FROM scores")
def write_report(spark, sf):
    folder = run_folder(spark, "report")
    results = view(spark, sf, "fx_text").withColumnRenamed("doc_id", "source_id")
    sinks.write_report(results, sc.quality_scores(counts(spark, sf)), folder)
    return rounded(sinks.read_report_scores(spark, folder))


VALID = """
valid AS (SELECT DISTINCT sub_topic AS label FROM fx_taxonomy WHERE main_topic IN (SELECT main_topic FROM fx_signals) UNION SELECT 'No subtopic found'),
invalid AS (SELECT * FROM fx_gold WHERE label NOT IN (SELECT label FROM valid)),
invalid_counts AS (SELECT label, count(*) AS occurrences, min(doc_id * 10 + pos) AS seen FROM invalid GROUP BY label)
"""


def invalid_counts(spark, sf) -> DataFrame:
    return sc.invalid_label_counts(view(spark, sf, "fx_gold"), taxonomy(spark, sf), signals(spark, sf))


@query("invalid_label_counts", f"WITH {VALID} SELECT label, occurrences, CAST(seen // 10 AS BIGINT) AS first_doc, CAST(seen % 10 AS BIGINT) AS first_pos FROM invalid_counts")
def invalid_label_counts(spark, sf):
    return invalid_counts(spark, sf).select(
        "label", "occurrences", F.col("first_seen.doc_id").alias("first_doc"), F.col("first_seen.pos").alias("first_pos")
    )


@query("invalid_labels_ranked", f"WITH {VALID} SELECT label, occurrences FROM invalid_counts ORDER BY occurrences DESC, seen")
def invalid_labels_ranked(spark, sf):
    return sc.invalid_labels_ranked(invalid_counts(spark, sf)).select("label", "occurrences")


@query("invalid_label_summary", f"""
WITH {VALID}
SELECT count(DISTINCT label) AS invalid_labels, count(*) AS occurrences, count(DISTINCT doc_id) AS affected_rows,
       (SELECT count(*) FROM fx_text) AS total_rows, round(count(*) * 100.0 / (SELECT count(*) FROM fx_text), 6) AS occurrence_percent,
       round(count(DISTINCT doc_id) * 100.0 / (SELECT count(*) FROM fx_text), 6) AS affected_percent
FROM invalid
""")
def invalid_label_summary(spark, sf):
    return sc.invalid_label_summary(
        view(spark, sf, "fx_gold"), view(spark, sf, "fx_text"), taxonomy(spark, sf), signals(spark, sf)
    )


LISTED = "array<struct<signal_type:string,label:string>>"


def arriving(spark, sf, folder) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """All texts with their gold and proposed labels, and a run over the files that came into a folder since the last."""
    listed = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("signal_type", "label")))
    rows = [
        df.select("doc_id", F.lit(kind).alias("kind"), signal, label) for kind, df, signal, label in (
            ("gold", gold(spark, sf), "signal_type", "label"), ("proposed", allowed(spark, sf), "signal_type", "label"),
            ("text", view(spark, sf, "fx_text"), F.lit(None).cast("string").alias("signal_type"), F.lit(None).cast("string").alias("label")))
    ]
    texts = reduce(DataFrame.unionByName, rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").groupBy("doc_id").agg(
        listed("gold").alias("gold"), listed("proposed").alias("proposed"), F.max((F.col("kind") == "text").cast("int")).alias("given"),
    ).filter("given = 1").drop("given")
    side = lambda batch, name: batch.select("doc_id", F.inline(name))
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)  # two batches of what one job writes

    def run() -> DataFrame:
        stream = inc.text_files(
            spark, f"{folder}/in", f"doc_id long, version int, gold {LISTED}, proposed {LISTED}", files_per_batch=files)
        return inc.evaluate_incremental(
            stream, lambda batch: (side(batch, "gold"), side(batch, "proposed")), taxonomy(spark, sf), signals(spark, sf),
            f"{folder}/out", F.col("version"))

    return texts, run


def write_files(rows: DataFrame, folder: str, version: int) -> None:
    """Files by the shuffle partitions, which the texts are dealt to by id."""
    rows.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{folder}/in")


@query("evaluate_incremental", f"WITH {SCORED} SELECT * FROM scores")
def evaluate_incremental(spark, sf):
    """Texts arrive in several files, with their gold and proposed labels."""
    folder = run_folder(spark, "stream")
    texts, run = arriving(spark, sf, folder)
    write_files(texts, folder, 1)
    return rounded(run())


@query("evaluate_corrected", f"WITH {SCORED} SELECT * FROM scores")
def evaluate_corrected(spark, sf):
    """Texts come again, in other files and after a restart: the last version of each counts, once.

    First come those with gold labels, which stand as proposals there; then, in the
    run after that, all texts as they are, with an old version once more among them.
    """
    folder = run_folder(spark, "stream")
    texts, run = arriving(spark, sf, folder)
    # Joined and grouped once, and dealt to the files as before.
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = stage(texts, f"{folder}/texts").repartition(files, "doc_id")
    drafts = texts.filter("size(gold) > 0").withColumn("proposed", F.col("gold"))
    write_files(drafts, folder, 1)
    run()
    write_files(texts, folder, 2)
    write_files(drafts.withColumn("gold", F.lit(None).cast(LISTED)), folder, 0)
    return rounded(run())


# --- evaluation of stored documents -----------------------------------------

ABOUT = f"""
{READING}, docs AS (SELECT doc_id, regexp_extract(response, '(\\{{.*\\}})', 1, 's') AS j FROM fx_jsonld),
items AS (SELECT doc_id, CASE WHEN json_type(j, '$.about') = 'ARRAY' THEN json_extract(j, '$.about[*]') WHEN json_extract(j, '$.about') IS NOT NULL THEN [json_extract(j, '$.about')] END AS l
          FROM docs WHERE j <> '' AND json_valid(j)),
terms AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, json_extract_string(unnest(l), '$.name') AS label,
                 json_extract_string(unnest(l), '$.inDefinedTermSet.name') AS main_topic FROM items WHERE l IS NOT NULL),
bad AS (SELECT DISTINCT doc_id FROM terms WHERE main_topic IS NULL OR label IS NULL),
readable AS (SELECT doc_id FROM items WHERE l IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM bad)),
read_rows AS (SELECT t.doc_id, pos, label, t.main_topic, r.signal_type FROM terms t JOIN reading r ON t.main_topic = r.main_topic WHERE doc_id IN (SELECT doc_id FROM readable))
"""


def documents(spark, sf) -> DataFrame:
    """Dealt out before they are parsed: the given files have one row group each."""
    dealt = spread(view(spark, sf, "fx_jsonld"), spark.sparkContext.defaultParallelism, "doc_id")
    return jl.extract_documents(dealt).filter("json_ld IS NOT NULL").select("doc_id", "json_ld")


@query("read_terms", f"WITH {ABOUT} SELECT doc_id, pos, label, main_topic, signal_type FROM read_rows")
def read_terms(spark, sf):
    return jl.read_terms(documents(spark, sf), signals(spark, sf))


@query("rejected_documents", f"""
WITH {ABOUT}
SELECT doc_id, CASE WHEN l IS NULL THEN 'no about' ELSE 'term without a term set' END AS reject_reason
FROM items WHERE doc_id NOT IN (SELECT doc_id FROM readable)
""")
def rejected_documents(spark, sf):
    return jl.rejected_documents(documents(spark, sf))


@query("evaluate", f"""
WITH {ABOUT.strip()}, {LABEL_SIGNAL.split(', main')[0].split('gold AS')[0].strip().rstrip(',')},
gold_lists AS (SELECT doc_id, CASE WHEN gold_labels = '[]' THEN ['No subtopic found'] ELSE from_json(replace(gold_labels, chr(39), '"'), '["VARCHAR"]') END AS l
               FROM fx_dataset WHERE doc_id IN (SELECT doc_id FROM readable)),
gold AS (SELECT doc_id, signal_type, g.label FROM (SELECT doc_id, unnest(l) AS label FROM gold_lists) g JOIN label_signal s ON s.label = g.label),
{_counts('gold', 'read_rows', 'gold_lists')}
SELECT * FROM scores
""")
def evaluate(spark, sf):
    done = ev.evaluate(view(spark, sf, "fx_dataset"), documents(spark, sf), taxonomy(spark, sf), signals(spark, sf))
    return rounded(done.scores)


@query("evaluate_rejects", f"""
WITH {ABOUT}
SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN 'no document' WHEN i.l IS NULL THEN 'no about' ELSE 'term without a term set' END AS reject_reason
FROM fx_dataset d LEFT JOIN items i ON i.doc_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM readable)
""")
def evaluate_rejects(spark, sf):
    return ev.evaluate(view(spark, sf, "fx_dataset"), documents(spark, sf), taxonomy(spark, sf), signals(spark, sf)).rejects


@query("evaluate_results", f"""
WITH {ABOUT}
SELECT d.doc_id AS source_id, text, CASE WHEN gold_labels = '[]' THEN 'No subtopic found' ELSE replace(replace(replace(replace(gold_labels, '[', ''), ']', ''), chr(39), ''), ', ', '|') END AS gold,
       coalesce(g.generated, '') AS generated
FROM fx_dataset d LEFT JOIN (SELECT doc_id, string_agg(label, '|' ORDER BY signal_type, pos) AS generated FROM read_rows GROUP BY doc_id) g ON g.doc_id = d.doc_id
WHERE d.doc_id IN (SELECT doc_id FROM readable)
""")
def evaluate_results(spark, sf):
    done = ev.evaluate(view(spark, sf, "fx_dataset"), documents(spark, sf), taxonomy(spark, sf), signals(spark, sf))
    return done.results.select(
        "source_id", "text", F.array_join("gold_labels", "|").alias("gold"), F.array_join("generated_labels", "|").alias("generated")
    )
