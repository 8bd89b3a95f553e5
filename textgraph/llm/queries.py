"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgraph.llm import alignment, centroids, chat, decontaminate, language, licences, minhash, mixing, packing, pii, secret_scan, suffix_dedup, topk
from textgraph.llm.common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


@query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.drop("spans")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(documents.filter(~language.held_out(F.col("doc_id"))))
    found = language.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda ids: ids % 100 == 0)


ORACLES["op6_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf_dir, "conversations", *columns).unionByName(chat.hard_case(spark))
    return chat.digests(chat.format_turns(turns))


ORACLES["op7_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, '### ') OR contains(text, '</turn>') THEN
    replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') ELSE text END AS body FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role
                                 ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:') END
                       || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op10_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM per
), running AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed
), judged AS (
  SELECT *, rest * w >= cap * weight_left AS capped FROM running
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE w *
    ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target
  FROM judged
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def _lloyd_sql(rounds: int = centroids.ROUNDS) -> str:
    """Rounds as chained common table expressions; a centroid is a list."""
    steps = ["""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, embedding
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(n - 1 AS INTEGER) AS c, e FROM (
    SELECT e, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, embedding) AS n FROM v) WHERE n <= 8
)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min_by(c, d * 8 + c) AS c, min(d) AS d FROM (
    SELECT v.r, c{n}.c, CAST(list_sum(list_transform(list_zip(v.e, c{n}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{n})
  GROUP BY r
)""")
        if n < rounds:
            steps.append(f"""s{n} AS MATERIALIZED (
  SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (
    SELECT a{n}.c, unnest(range(1, 65)) AS i, unnest(v.e) AS x FROM a{n} JOIN v USING (r)) GROUP BY c, i
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(m.e, c{n}.e) AS e FROM c{n} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{n} GROUP BY c) m USING (c)
)""")
    chain = ",\n".join(steps)
    return f"""WITH {chain}
SELECT v.vec_id, a{rounds}.c AS cluster, a{rounds}.d AS distance,
       CAST(sum(a{rounds}.d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(a{rounds}.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)
"""


ORACLES["op11_centroid_clustering"] = _lloyd_sql()


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.Alignment(documents, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).scores().drop("groups")


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
