"""Queries on sources, parsing, prompts and model calls, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgraph.functions import fixed, templates, text
from textgraph.operators import extraction as ex, lookup as lk, model_calls as mc, prompts
from textgraph.plans import schema_mapping as sm
from textgraph.session import run_folder, stage
from textgraph.sources import sinks, tables
from workload.fixtures import view

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


SPACE = fixed.SPACE
SECTIONS = f"""
SELECT doc_id,
       trim(regexp_extract(response, '<summary>\\n(.*?)\\n</summary>', 1, 's'), '{SPACE}') AS summary,
       regexp_extract(response, '<entiteiten>\\n(.*?)\\n</entiteiten>', 1, 's') AS entity_section,
       regexp_extract(response, '<relaties>\\n(.*?)\\n</relaties>', 1, 's') AS relation_section
FROM fx_response
"""


def _pipe(section: str) -> str:
    """Rows of a section in DuckDB, numbered in their order."""
    return f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, a, b, c FROM (
  SELECT doc_id, i, trim(f[1], '{SPACE}') AS a, trim(f[2], '{SPACE}') AS b, trim(f[3], '{SPACE}') AS c FROM (
    SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line, string_split(unnest(l), ' | ') AS f
    FROM (SELECT doc_id, string_split(trim({section}, '{SPACE}'), chr(10)) AS l FROM sections) s
  ) u WHERE trim(line, '{SPACE}') <> '' AND len(f) >= 3
) k"""


PARSED = f"""sections AS ({SECTIONS}), ent AS ({_pipe('entity_section')}), rel AS ({_pipe('relation_section')}),
ok AS (SELECT s.doc_id, summary FROM sections s WHERE summary <> ''
       AND doc_id IN (SELECT doc_id FROM ent) AND doc_id IN (SELECT doc_id FROM rel)),
entity AS (SELECT ent.doc_id, pos, a AS name, b AS class_name, c AS description FROM ent JOIN ok ON ent.doc_id = ok.doc_id),
relation AS (SELECT rel.doc_id, pos, a AS subject, b AS predicate, c AS object FROM rel JOIN ok ON rel.doc_id = ok.doc_id),
first_entity AS (SELECT * FROM entity QUALIFY row_number() OVER (PARTITION BY doc_id, class_name ORDER BY pos) = 1)
"""


def parsed(spark, sf) -> DataFrame:
    return ex.extraction(view(spark, sf, "fx_response")).drop("response")


def staged(spark, sf) -> DataFrame:
    """Parsed answers as a stage table, for queries that read them repeatedly."""
    return stage(parsed(spark, sf), run_folder(spark, "parsed"))


# --- sources and sinks ------------------------------------------------------

@query("read_labelled", "SELECT doc_id, text, source AS gold_labels FROM documents")
def read_labelled(spark, sf):
    return tables.read_labelled(spark, f"{sf}/documents.parquet", "text", "source", keep=["doc_id"])


CSV_RANGE = 1 << 18


@query("read_labelled_csv", "SELECT doc_id, text, source AS gold_labels FROM documents")
def read_labelled_csv(spark, sf):
    """CSV with line breaks, quotes and separators in its cells, each file in several ranges."""
    path = f"{run_folder(spark, 'csv')}/documents"
    rows = view(spark, sf, "documents").select("doc_id", "text", "source")
    rows.write.options(header="true", escape='"', quoteAll="true").csv(path)
    read = tables.read_labelled(spark, path, "text", "source", "csv", keep=["doc_id"], range_bytes=CSV_RANGE)
    return read.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("resume_slice", """
SELECT o_orderkey AS id, o_orderpriority AS text FROM orders
WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer) ORDER BY o_orderkey LIMIT 100
""")
def resume_slice(spark, sf):
    source = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return tables.resume_slice(source, view(spark, sf, "customer").select(F.col("c_custkey").alias("source_id")), 100)


@query("class_store_scan", """
SELECT class_id, class_label, comments, CAST(len(embedding) AS INTEGER) AS dims,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squares
FROM fx_class
""")
def class_store_scan(spark, sf):
    store = tables.class_store(view(spark, sf, "fx_class"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return store.select(
        "class_id", "class_label", "comments", F.size("embedding").alias("dims"), F.round(squares, 6).alias("squares")
    )


LOGGED = """
SELECT source_id, call_name, system_prompt, human_prompt, response AS assistant_response, 'w1' AS worker_id, 'local' AS model_name
FROM fx_calls WHERE response <> ''
"""


def _log_rows(spark, sf) -> DataFrame:
    return mc.call_log_rows(view(spark, sf, "fx_calls"), F.lit("w1"), F.lit("local"))


@query("call_log_rows", LOGGED)
def call_log_rows(spark, sf):
    return _log_rows(spark, sf).drop("created_at")


@query("append_call_log", LOGGED)
def append_call_log(spark, sf):
    folder = run_folder(spark, "log")
    sinks.append_call_log(_log_rows(spark, sf), folder)
    return spark.read.parquet(folder).select(*[c for c in sinks.LOG_COLUMNS if c != "created_at"])


@query("append_results", """
SELECT doc_id AS source_id, text, string_agg(label, '|' ORDER BY g.pos) AS gold FROM fx_text JOIN fx_gold g USING (doc_id) GROUP BY doc_id, text
""")
def append_results(spark, sf):
    folder = run_folder(spark, "results")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "label")))
    lists = view(spark, sf, "fx_gold").groupBy("doc_id").agg(F.transform(ordered, lambda g: g["label"]).alias("gold_labels"))
    rows = view(spark, sf, "fx_text").join(lists, "doc_id").withColumnRenamed("doc_id", "source_id")
    sinks.append_results(rows.withColumn("generated_labels", F.array().cast("array<string>")), folder)
    return spark.read.parquet(folder).select("source_id", "text", F.array_join("gold_labels", "|").alias("gold"))


@query("results_sorted", "SELECT doc_id, text FROM fx_text ORDER BY doc_id")
def results_sorted(spark, sf):
    from textgraph.operators.scoring import results_sorted as run

    return run(view(spark, sf, "fx_text"), "doc_id")


# --- parsing ----------------------------------------------------------------

@query("section_extract", SECTIONS)
def section_extract(spark, sf):
    return ex.sections(view(spark, sf, "fx_response"), partitions=spark.sparkContext.defaultParallelism).drop("response")


@query("pipe_rows", f"""
WITH sections AS ({SECTIONS}), ent AS ({_pipe('entity_section')}), rel AS ({_pipe('relation_section')})
SELECT doc_id, 'entity' AS kind, pos, a AS first_field, b AS second_field, c AS third_field FROM ent
UNION ALL SELECT doc_id, 'relation' AS kind, pos, a AS first_field, b AS second_field, c AS third_field FROM rel
""")
def pipe_rows(spark, sf):
    names = ["first_field", "second_field", "third_field"]
    found = ex.sections(view(spark, sf, "fx_response"))
    rows = F.array(
        F.struct(F.lit("entity").alias("kind"), text.rows_of_three(F.col("entity_section"), names).alias("rows")),
        F.struct(F.lit("relation").alias("kind"), text.rows_of_three(F.col("relation_section"), names).alias("rows")),
    )
    return found.select("doc_id", F.inline(rows)).select("doc_id", "kind", F.inline("rows"))


@query("extraction_struct", f"""
WITH {PARSED}
SELECT s.doc_id, coalesce(ok.summary, '') AS summary, ok.doc_id IS NULL AS failed,
       coalesce(e.lines, '') AS entities, coalesce(r.lines, '') AS relations
FROM sections s LEFT JOIN ok ON s.doc_id = ok.doc_id
LEFT JOIN (SELECT doc_id, string_agg(name || '|' || class_name || '|' || description, chr(10) ORDER BY pos) AS lines FROM entity GROUP BY doc_id) e ON e.doc_id = s.doc_id
LEFT JOIN (SELECT doc_id, string_agg(subject || '|' || predicate || '|' || object, chr(10) ORDER BY pos) AS lines FROM relation GROUP BY doc_id) r ON r.doc_id = s.doc_id
""")
def extraction_struct(spark, sf):
    lines = lambda c, names: F.array_join(F.transform(c, lambda e: F.concat_ws("|", *[e[n] for n in names])), "\n")
    return parsed(spark, sf).select(
        "doc_id", "summary", F.col("extraction_failed").alias("failed"),
        lines("entities", ex.ENTITY_FIELDS).alias("entities"), lines("relations", ex.RELATION_FIELDS).alias("relations"),
    )


@query("first_per_class", f"WITH {PARSED} SELECT doc_id, class_name, pos, name, description FROM first_entity")
def first_per_class(spark, sf):
    return ex.first_per_class(parsed(spark, sf))


PER_CLASS = """
SELECT doc_id, class_name, min(pos) AS pos, string_agg(name, '|' ORDER BY pos) AS names FROM entity GROUP BY doc_id, class_name
"""


@query("entities_per_class", f"WITH {PARSED} {PER_CLASS}")
def entities_per_class(spark, sf):
    return ex.entities_per_class(parsed(spark, sf)).withColumn("names", F.array_join("names", "|"))


@query("json_object_extract", """
SELECT doc_id, nullif(regexp_extract(response, '(\\{.*\\})', 1, 's'), '') AS json_ld,
       CASE WHEN NOT regexp_matches(response, '\\{.*\\}', 's') THEN 'no JSON object in the answer' END AS reject_reason
FROM fx_jsonld
""")
def json_object_extract(spark, sf):
    from textgraph.operators.jsonld import extract_documents

    return extract_documents(view(spark, sf, "fx_jsonld")).drop("response")


@query("label_literal_parse", """
SELECT item_id, CAST(i AS INTEGER) AS place, label FROM (
  SELECT item_id, unnest(l) AS label, generate_subscripts(l, 1) AS i FROM (
    SELECT c_custkey AS item_id, CASE WHEN c_acctbal < 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['No subtopic found']
           WHEN c_mktsegment = 'FURNITURE' THEN [c_mktsegment, NULL, 'caf' || chr(233), n_name]
           ELSE [c_mktsegment, n_name] END AS l
    FROM customer JOIN nation ON c_nationkey = n_nationkey) x) y
""")
def label_literal_parse(spark, sf):
    from textgraph.operators.scoring import gold_list

    cells = view(spark, sf, "fx_label_cells")
    return cells.select("item_id", F.posexplode(gold_list(F.col("literal"))).alias("place", "label")).withColumn(
        "place", F.col("place") + 1
    )


@query("label_cell_parse", """
SELECT item_id, CAST(coalesce(len(l), 0) AS INTEGER) AS n, coalesce(array_to_string(l, '|'), '') AS labels
FROM (SELECT item_id, string_split(cell, '; ') AS l FROM fx_label_cells) x
""")
def label_cell_parse(spark, sf):
    cells = view(spark, sf, "fx_label_cells").withColumn("l", text.label_cell(F.col("cell")))
    return cells.select("item_id", F.size("l").alias("n"), F.array_join("l", "|").alias("labels"))


# --- prompts ----------------------------------------------------------------

@query("embed_text", f"""
WITH {PARSED} SELECT DISTINCT trim('Class: ' || class_name || chr(10) || 'Description: ' || description, '{SPACE}') AS embed_text FROM first_entity
""")
def embed_text(spark, sf):
    return sm.class_mentions(parsed(spark, sf)).select("embed_text").distinct()


def _template(template: str, **fields: str) -> str:
    """A template as a DuckDB expression, filled by nested replaces."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in fields.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


@query("prompt_extract", f"SELECT doc_id, {_template(templates.EXTRACT_HUMAN, INPUT_TEXT='text')} AS human_prompt FROM documents")
def prompt_extract(spark, sf):
    return prompts.extract_prompt(view(spark, sf, "documents")).select("doc_id", "human_prompt")


RANKED = """
pairs AS (
  SELECT mention_id, m.class_name, m.description, class_id, class_label, comments,
         list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM fx_mention m CROSS JOIN fx_class c),
ranked AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY round(score, 12) DESC, class_id) AS INTEGER) AS rank FROM pairs) r
  WHERE rank <= 5)
"""


def topk(spark, sf) -> DataFrame:
    return lk.semantic_topk(view(spark, sf, "fx_mention"), view(spark, sf, "fx_class"))


@query("semantic_topk", f"WITH {RANKED} SELECT mention_id, rank, class_id, class_label, round(score, 6) AS score FROM ranked")
def semantic_topk(spark, sf):
    rows = lk.candidate_rows(topk(spark, sf), ["mention_id"])
    return rows.select("mention_id", "rank", "class_id", "class_label", F.round("score", 6).alias("score"))


@query("candidate_list", f"""
WITH {RANKED}
SELECT mention_id, string_agg(CAST(rank AS VARCHAR) || '. ' || class_label || ': ' || coalesce(nullif(comments, ''), 'No description available'), chr(10) ORDER BY rank) AS candidates
FROM ranked GROUP BY mention_id
""")
def candidate_list(spark, sf):
    return topk(spark, sf).select("mention_id", prompts.candidate_lines(F.col("candidates")).alias("candidates"))


@query("choice_check", f"""
WITH {RANKED}
SELECT h.mention_id, selected_number, selected_class AS chosen, class_label AS expected, selected_number BETWEEN 1 AND 5 AS valid,
       selected_number BETWEEN 1 AND 5 AND selected_class IS DISTINCT FROM class_label AS mismatch
FROM fx_choice h LEFT JOIN ranked r ON r.mention_id = h.mention_id AND r.rank = h.selected_number
""")
def choice_check(spark, sf):
    return lk.choice_check(topk(spark, sf), view(spark, sf, "fx_choice"), ["mention_id"])


DEFINED = """
defined AS (SELECT label, min(class_id) AS class_id, min_by(definition, class_id) AS definition FROM fx_store_definition GROUP BY label)
"""


@query("definition_lookup", f"""
WITH {DEFINED}
SELECT mention_id, selected_class AS schema_label, definition, definition IS NULL AS missing
FROM fx_choice LEFT JOIN defined ON label = selected_class
""")
def definition_lookup(spark, sf):
    mapping = view(spark, sf, "fx_choice").select("mention_id", F.col("selected_class").alias("schema_label"))
    return lk.definition_lookup(mapping, view(spark, sf, "fx_store_definition")).drop("class_id")


# Vectors of the entity classes: a class carries the number of its vector.
VECTORS = f"""
mention AS (SELECT *, trim('Class: ' || class_name || chr(10) || 'Description: ' || description, '{SPACE}') AS embed_text FROM first_entity),
vector AS (SELECT DISTINCT embed_text, embedding FROM mention JOIN embeddings ON class_name = 'Class' || CAST(vec_id AS VARCHAR)),
best AS (SELECT embed_text, class_label FROM (
  SELECT embed_text, class_label, row_number() OVER (PARTITION BY embed_text ORDER BY round(
           list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) DESC, class_id) AS rank
  FROM vector v CROSS JOIN fx_class c) x WHERE rank = 1),
{DEFINED.strip()},
mapping AS (SELECT doc_id, class_name, pos, class_label AS schema_label, definition FROM mention
            JOIN best ON mention.embed_text = best.embed_text JOIN defined ON label = class_label)
"""


def vectors(spark, sf, mentions: DataFrame) -> DataFrame:
    stored = view(spark, sf, "embeddings").select(F.concat(F.lit("Class"), "vec_id").alias("class_name"), "embedding")
    return mentions.select("class_name", "embed_text").distinct().join(stored, "class_name").select("embed_text", "embedding")


def mapped(spark, sf, answers: DataFrame) -> DataFrame:
    return sm.schema_mapping(
        answers, view(spark, sf, "fx_class"), vectors(spark, sf, sm.class_mentions(answers)),
        view(spark, sf, "fx_store_definition"),
    )


@query("schema_mapping", f"WITH {PARSED.strip()}, {VECTORS} SELECT doc_id, class_name, pos, schema_label, definition FROM mapping")
def schema_mapping(spark, sf):
    return mapped(spark, sf, staged(spark, sf)).select("doc_id", "class_name", "pos", "schema_label", "definition")


@query("entities_with_schema", f"""
WITH {PARSED.strip()}, {VECTORS}
SELECT p.* FROM ({PER_CLASS}) p WHERE (doc_id, class_name) IN (SELECT (doc_id, class_name) FROM mapping)
""")
def entities_with_schema(spark, sf):
    answers = staged(spark, sf)
    found = ex.entities_with_schema(answers, mapped(spark, sf, answers))
    return found.withColumn("names", F.array_join("names", "|"))


@query("relations_text", f"""
WITH {PARSED}
SELECT s.doc_id, coalesce(t.lines, 'Geen expliciete relaties gevonden') AS relations
FROM sections s LEFT JOIN (SELECT doc_id, string_agg('- ' || subject || ' → ' || predicate || ' → ' || object, chr(10) ORDER BY pos) AS lines FROM relation GROUP BY doc_id) t ON t.doc_id = s.doc_id
""")
def relations_text(spark, sf):
    return parsed(spark, sf).select("doc_id", prompts.relations_text(F.col("relations")).alias("relations"))


BLOCKS = f"""
{PARSED.strip()}, {VECTORS.strip()}, per_class AS ({PER_CLASS.replace("'|' ORDER", "chr(10) || '- ' ORDER")}),
blocks AS (SELECT m.doc_id, string_agg('**Schema: ' || schema_label || '**' || chr(10) || 'Entiteiten die dit schema gebruiken:' || chr(10) || '- ' || names
       || chr(10) || chr(10) || '```yaml' || chr(10) || definition || chr(10) || '```', chr(10) || chr(10) ORDER BY m.pos) AS schema_blocks
FROM mapping m JOIN per_class p ON p.doc_id = m.doc_id AND p.class_name = m.class_name GROUP BY m.doc_id)
"""


def blocks(spark, sf, answers: DataFrame) -> DataFrame:
    mapping = mapped(spark, sf, answers)
    defined = view(spark, sf, "fx_store_definition").withColumnRenamed("definition", "compact")
    defined = lk.one_definition_per_label(defined).withColumn("raw", F.col("compact"))
    return prompts.schema_blocks(
        mapping.select("doc_id", "class_name", "schema_label", "pos"), ex.entities_per_class(answers), defined
    )


@query("schema_blocks", f"WITH {BLOCKS} SELECT doc_id, schema_blocks FROM blocks")
def schema_blocks(spark, sf):
    return blocks(spark, sf, staged(spark, sf))


RERUN = _template(templates.RERUN, PREVIOUS_JSON_LD="'{\"previous\": ' || CAST(d.doc_id AS VARCHAR) || '}'", VALIDATION_OUTPUT="lang")


@query("prompt_transform", f"""
WITH {BLOCKS}
SELECT d.doc_id, trim({_template(templates.TRANSFORM_HUMAN, SCHEMA_DEFINITIONS="coalesce(schema_blocks, '')",
    EXTRACTED_RELATIONS="t.lines", RERUN=f"CASE WHEN lang = 'en' THEN '' ELSE {RERUN} END", INPUT_TEXT='text')}, '{SPACE}') AS human_prompt
FROM documents d JOIN (SELECT doc_id, string_agg('- ' || subject || ' → ' || predicate || ' → ' || object, chr(10) ORDER BY pos) AS lines FROM relation GROUP BY doc_id) t ON t.doc_id = d.doc_id
LEFT JOIN blocks b ON b.doc_id = d.doc_id
""")
def prompt_transform(spark, sf):
    answers = staged(spark, sf)
    usable = answers.filter("NOT extraction_failed").select("doc_id", "relations")
    docs = view(spark, sf, "documents").join(usable, "doc_id").join(blocks(spark, sf, answers), "doc_id", "left")
    docs = docs.withColumns({
        "runs": F.when(F.col("lang") == "en", 0).otherwise(1),
        "previous_json_ld": F.concat(F.lit('{"previous": '), "doc_id", F.lit("}")),
        "previous_output": F.col("lang"),
    })
    return prompts.transform_prompt(docs).select("doc_id", "human_prompt")


# --- model calls: local functions stand in for a model ----------------------

def counting_model():
    """Answers with the length of the prompt."""
    return lambda system, human: f"{len(human)} characters"


def failing_model():
    """Fails by the length of the prompt, as a limit or as a bad request; other
    prompts get a choice whose number may be out of range."""
    def call(system, human):
        if len(human) > 300:
            raise RuntimeError("429 rate limit")
        if len(human) > 200:
            raise ValueError("bad request")
        return '{"reasoning": "r", "selected_class": "Person", "selected_number": ' + str(1 + len(human) % 7) + "}"

    return call


def vowel_embedder():
    return lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]


def shipped(factory):
    """The made function as a closure, so that it travels by value and the
    executors need no module of this repository."""
    made = factory()
    return lambda: made


@query("model_map", """
SELECT doc_id, CAST(length(text) AS VARCHAR) || ' characters' AS response, CAST(NULL AS VARCHAR) AS error, 1 AS attempts FROM documents
""")
def model_map(spark, sf):
    asked = view(spark, sf, "documents").select("doc_id", F.lit("s").alias("system_prompt"), F.col("text").alias("human_prompt"))
    return mc.model_map(asked, shipped(counting_model), threads=4).select("doc_id", "response", "error", "attempts")


CHOICES = """
choice AS (SELECT conv_id, turn, length(text) AS n, CAST(1 + length(text) % 7 AS INTEGER) AS number FROM conversations),
chosen AS (SELECT *, n <= 200 AND number <= 5 AS ok FROM choice)
"""


def choices(spark, sf, tries: int) -> DataFrame:
    asked = view(spark, sf, "conversations").select(
        "conv_id", "turn", F.lit("s").alias("system_prompt"), F.col("text").alias("human_prompt")
    )
    return mc.structured_choice(mc.model_map(asked, shipped(failing_model), tries=tries, wait=0.0))


@query("structured_map", f"""
WITH {CHOICES}
SELECT conv_id, turn, CASE WHEN ok THEN 'Person' END AS selected_class, CASE WHEN ok THEN number ELSE 0 END AS selected_number,
       CASE WHEN n > 200 THEN 'no response' WHEN NOT ok THEN 'answer does not fit its type' END AS reject_reason FROM chosen
""")
def structured_map(spark, sf):
    number = F.coalesce("answer.selected_number", F.lit(0)).alias("selected_number")
    return choices(spark, sf, 1).select("conv_id", "turn", "answer.selected_class", number, "reject_reason")


@query("retry_fallback", f"""
WITH {CHOICES}
SELECT conv_id, turn, CASE WHEN ok THEN 'Person' ELSE 'Thing' END AS schema_label, NOT ok AS fell_back, CASE WHEN n > 300 THEN 3 ELSE 1 END AS attempts FROM chosen
""")
def retry_fallback(spark, sf):
    keys = ["conv_id", "turn"]
    answers = stage(choices(spark, sf, 3), run_folder(spark, "choices"))
    one = F.struct(F.lit(1).alias("rank"), F.lit("Thing").alias("class_label"))
    candidates = answers.select(*keys, "attempts", F.array_repeat(one, 5).alias("candidates"))
    resolved = mc.choice_or_first(candidates, answers.filter("answer IS NOT NULL"), keys)
    return resolved.select(*keys, "schema_label", "fell_back", "attempts")


@query("embed_map", "SELECT DISTINCT text AS embed_text, " + " || ',' || ".join(
    f"CAST(length(text) - length(replace(text, '{c}', '')) AS VARCHAR) || '.0'" for c in "aeiou"
) + " AS vector FROM documents")
def embed_map(spark, sf):
    texts = view(spark, sf, "documents").select(F.col("text").alias("embed_text"))
    made = mc.embed_map(texts, shipped(vowel_embedder))
    return made.select("embed_text", F.array_join(F.col("embedding").cast("array<string>"), ",").alias("vector"))
