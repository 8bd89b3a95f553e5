"""Inputs of the registered queries, derived from the given tables.

One SQL text per view, read by Spark and by DuckDB alike; ``ITEM(list, n)`` is
the only place where the two differ. Every view covers its tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# Two-level taxonomy; one topic has both signal types, one has none.
VIEWS["fx_taxonomy"] = """
SELECT r_name AS main_topic, n_name AS sub_topic, CAST(n_nationkey AS BIGINT) AS pos
FROM nation JOIN region ON n_regionkey = r_regionkey
"""
VIEWS["fx_signals"] = """
SELECT 'onderwerp' AS signal_type, r_name AS main_topic, 1 AS priority FROM region WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')
UNION ALL
SELECT 'beleving' AS signal_type, r_name AS main_topic, 2 AS priority FROM region WHERE r_name IN ('ASIA', 'EUROPE')
"""
# A taxonomy that grows with the parts and lists sub topics many times.
VIEWS["fx_part_taxonomy"] = """
SELECT p_brand AS main_topic, p_name AS sub_topic, p_partkey AS pos FROM part
"""
VIEWS["fx_part_signals"] = """
SELECT DISTINCT CASE WHEN p_brand < 'Brand#17' THEN 'onderwerp' ELSE 'beleving' END AS signal_type, p_brand AS main_topic,
       CASE WHEN p_brand < 'Brand#17' THEN 1 ELSE 2 END AS priority
FROM part WHERE p_brand < 'Brand#5'
"""

# Texts are orders. Gold labels: the nation of the customer, and for pending
# orders a market segment, which is outside the taxonomy.
VIEWS["fx_text"] = """
SELECT o_orderkey AS doc_id, o_orderpriority || ' ' || o_orderstatus AS text FROM orders
"""
VIEWS["fx_gold"] = """
SELECT o_orderkey AS doc_id, n_name AS label, CAST(0 AS BIGINT) AS pos
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT o_orderkey AS doc_id, c_mktsegment AS label, CAST(1 AS BIGINT) AS pos
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
"""
# Proposed labels: nations of the suppliers, under either signal type, and
# made-up ones.
VIEWS["fx_proposed"] = """
SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'A' THEN 'beleving' ELSE 'onderwerp' END AS signal_type,
       n_name AS label, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT l_orderkey AS doc_id, 'onderwerp' AS signal_type, l_returnflag || l_linestatus AS label,
       CAST(l_linenumber AS BIGINT) * 1000000000000 + 500000000000 + l_partkey * 100000 + l_suppkey AS pos
FROM lineitem WHERE l_returnflag = 'R'
"""
# Gold lists as text, in both encodings.
VIEWS["fx_label_cells"] = """
SELECT c_custkey AS item_id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN n_name
            ELSE c_mktsegment || '; ' || n_name END AS cell,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '[]' WHEN c_mktsegment = 'MACHINERY' THEN 'not a list'
            WHEN c_mktsegment = 'FURNITURE' THEN '[' || chr(39) || c_mktsegment || chr(39) || ', None, "caf' || chr(92) || 'xe9", ' || chr(39) || n_name || chr(39) || ']'
            WHEN c_mktsegment = 'AUTOMOBILE' THEN '[' || chr(39) || c_mktsegment || chr(39) || ', "' || n_name || '",]'
            ELSE '[' || chr(39) || c_mktsegment || chr(39) || ', ' || chr(39) || n_name || chr(39) || ']' END
       || CASE WHEN c_acctbal < 0 THEN ' junk' ELSE '' END AS literal
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
VIEWS["fx_dataset"] = """
SELECT o_orderkey AS doc_id, o_orderpriority || ' ' || o_orderstatus AS text,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN '[]'
            WHEN o_orderstatus = 'P' THEN '[' || chr(39) || n_name || chr(39) || ', ' || chr(39) || c_mktsegment || chr(39) || ']'
            ELSE '[' || chr(39) || n_name || chr(39) || ']' END AS gold_labels
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# Extraction answers around whole document texts: every line of a text is an
# entity. Two sources lack relations; some last rows are short or long.
VIEWS["fx_response"] = """
SELECT doc_id,
       'intro' || chr(10) || '<summary>' || chr(10) || text || chr(10) || '</summary>' || chr(10)
       || '<entiteiten>' || chr(10)
       || replace(text, chr(10), ' | ' || cls || ' | line of ' || source || chr(10)) || ' | ' || cls || ' | line of ' || source || chr(10)
       || lang || ' | ' || lang_cls || ' | language' || chr(10)
       || source || ' | ' || cls || CASE source WHEN 'src5' THEN ' | ' WHEN 'src6' THEN ' | source | extra' WHEN 'src8' THEN '' ELSE ' | source' END
       || chr(10) || '</entiteiten>' || chr(10)
       || CASE WHEN source IN ('src3', 'src7') THEN '' ELSE '<relaties>' || chr(10)
       || source || ' | publishes | ' || lang || chr(10) || lang || ' | used in | ' || source || chr(10) || '</relaties>' || chr(10) END AS response
FROM (SELECT doc_id, text, lang, source, 'Class' || substr(CAST(n_chars AS STRING), 1, 2) AS cls,
             'Class' || CASE lang WHEN 'en' THEN '101' WHEN 'fr' THEN '102' WHEN 'de' THEN '103' ELSE '104' END AS lang_cls
      FROM documents) d
"""

# The class store: the first vector of each label and orthant of its first
# three dimensions. Mentions are all vectors.
VIEWS["fx_class"] = """
SELECT min(vec_id) AS class_id, 'Type' || CAST(label AS STRING) || '_' || CAST(orthant AS STRING) AS class_label,
       CASE WHEN orthant = 0 THEN NULL WHEN orthant = 1 THEN '' ELSE 'cluster ' || CAST(label AS STRING) END AS comments,
       min_by(embedding, vec_id) AS embedding
FROM (SELECT vec_id, label, embedding,
             CASE WHEN ITEM(embedding, 1) > 0 THEN 1 ELSE 0 END + CASE WHEN ITEM(embedding, 2) > 0 THEN 2 ELSE 0 END
             + CASE WHEN ITEM(embedding, 3) > 0 THEN 4 ELSE 0 END AS orthant
      FROM embeddings) e
GROUP BY label, orthant
"""
VIEWS["fx_mention"] = """
SELECT vec_id AS mention_id, 'm' || CAST(vec_id AS STRING) AS class_name, 'cluster ' || CAST(label AS STRING) AS description, embedding
FROM embeddings
"""
VIEWS["fx_choice"] = """
SELECT vec_id AS mention_id, label + 1 AS selected_number, 'Type' || CAST(label AS STRING) || '_0' AS selected_class FROM embeddings
"""
# Definitions of the class store; some classes have none, some have two.
VIEWS["fx_store_definition"] = """
SELECT class_id, class_label AS label, 'label: ' || class_label || chr(10) || 'subClassOf: Thing' AS definition
FROM fx_class WHERE comments IS NOT NULL
UNION ALL
SELECT class_id + 1000000 AS class_id, class_label AS label, 'second' AS definition FROM fx_class WHERE comments <> ''
"""

# A vocabulary for the documents made of orders.
VIEWS["fx_schema_class"] = """
SELECT * FROM (VALUES
  (1, 'Thing', CAST(NULL AS STRING)), (2, 'Person', 'Thing'), (3, 'Place', 'Thing'), (4, 'Country', 'Place'),
  (5, 'Order', 'Thing'), (6, 'DefinedTerm', 'Thing'), (7, 'DefinedTermSet', 'Thing')
) AS t(class_id, label, parent)
"""
VIEWS["fx_schema_property"] = """
SELECT * FROM (VALUES
  (1, 'Thing', 'name', 'Text'), (2, 'Thing', 'identifier', 'Text'), (3, 'Thing', 'about', 'Thing'),
  (4, 'Person', 'nationality', 'Country'), (5, 'Person', 'netWorth', 'Number'),
  (6, 'Place', 'containedInPlace', 'Place'), (7, 'Order', 'customer', 'Person'), (8, 'Order', 'orderStatus', 'Text'),
  (9, 'DefinedTerm', 'inDefinedTermSet', 'DefinedTermSet')
) AS t(pos, class_label, property, range)
"""
# One document per order inside an answer; what is wrong depends on priority
# and status: an unknown property, a property of another class, an unknown
# type, a wrong range, no object at all.
VIEWS["fx_jsonld"] = """
SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'no object here ' || c_name ELSE
  'Here: {"@context":"https://schema.org","@type":"' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN 'Bestelling' ELSE 'Order' END
  || '","identifier":"o' || CAST(o_orderkey AS STRING) || '","orderStatus":"' || o_orderstatus || '"'
  || CASE o_orderpriority
       WHEN '1-URGENT' THEN ',"about":[{"@type":"DefinedTerm","name":"' || n_name || '","inDefinedTermSet":{"@type":"DefinedTermSet","name":"' || r_name || '"}}]'
       WHEN '2-HIGH' THEN ',"about":{"@type":"Thing","name":"x"}'
       WHEN '3-MEDIUM' THEN ',"about":[{"@type":"Thing","name":"x"}]'
       WHEN '5-LOW' THEN ',"about":[{"@type":"DefinedTerm","name":"' || first_nation || '","inDefinedTermSet":{"@type":"DefinedTermSet","name":"' || r_name || '"}}]'
       ELSE '' END
  || ',"customer":{"@type":"' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'Country' ELSE 'Person' END
  || '","@id":"#c' || CAST(c_custkey AS STRING) || '","name":"' || c_name || '"'
  || CASE o_orderpriority WHEN '2-HIGH' THEN ',"shoeSize":42' WHEN '3-MEDIUM' THEN ',"orderStatus":"O"' ELSE '' END
  || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN '' ELSE
     ',"netWorth":' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING)
  || ',"nationality":{"@type":"Country","@id":"#n' || CAST(n_nationkey AS STRING) || '","name":"' || n_name
  || '","containedInPlace":{"@type":"Place","name":"' || r_name || '"}}' END || '}} end.' END AS response
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT n_regionkey AS first_region, min(n_name) AS first_nation FROM nation GROUP BY n_regionkey) f ON r_regionkey = first_region
"""
# Answers per customer and round. The first good one comes in round 0, 1 or 4,
# or never, by market segment; one segment answers without an object in the end.
VIEWS["fx_good_from"] = """
SELECT c_custkey AS doc_id, c_name, c_mktsegment,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 4 ELSE 9 END AS good_from
FROM customer
"""
VIEWS["fx_rounds"] = "UNION ALL".join(
    f"""
SELECT doc_id, {number} AS round, good_from,
  CASE WHEN c_mktsegment = 'MACHINERY' AND {number} = 2 THEN 'sorry' ELSE
  '{{"@context":"https://schema.org","@type":"Person","name":"' || c_name || '"'
  || CASE WHEN {number} < good_from THEN ',"shoeSize":{number}' ELSE '' END || '}}' END AS response
FROM fx_good_from
"""
    for number in range(5)
)

# A vocabulary out of parts: a class per brand and type, a property per part.
VIEWS["fx_voc_class"] = """
SELECT min(p_partkey) AS class_id, replace(p_brand, '#', '') || '_' || p_type AS label, p_type AS parent, CAST(1 AS BIGINT) AS pos
FROM part GROUP BY p_brand, p_type
UNION ALL
SELECT min(p_partkey) AS class_id, replace(p_brand, '#', '') || '_' || p_type AS label, 'Product' AS parent, CAST(2 AS BIGINT) AS pos
FROM part WHERE p_brand < 'Brand#2' GROUP BY p_brand, p_type
"""
VIEWS["fx_voc_comment"] = """
SELECT replace(p_brand, '#', '') || '_' || p_type AS label, 'Goods of ' || p_brand || '.' AS comment, CAST(1 AS BIGINT) AS pos
FROM part WHERE p_type <> 'SMALL' GROUP BY p_brand, p_type
UNION ALL
SELECT replace(p_brand, '#', '') || '_' || p_type AS label, 'Type ' || lower(p_type) || '.' AS comment, CAST(2 AS BIGINT) AS pos
FROM part WHERE p_type IN ('LARGE', 'ECONOMY') GROUP BY p_brand, p_type
"""
VIEWS["fx_voc_property"] = """
SELECT replace(p_brand, '#', '') || '_' || p_type AS label,
       CASE p_name WHEN 'small ring' THEN 'name' WHEN 'red widget' THEN 'identifier' ELSE replace(p_name, ' ', '_') END AS property,
       CASE WHEN p_size <= 25 THEN 'Text' WHEN p_size <= 40 THEN 'Number' WHEN p_size <= 45 THEN 'URL' ELSE NULL END AS range,
       CASE WHEN p_size BETWEEN 10 AND 14 THEN 'Size ' || CAST(p_size AS STRING) || '.' WHEN p_size BETWEEN 30 AND 34 THEN 'Large.' ELSE NULL END AS comment,
       p_partkey AS pos
FROM part
"""

VIEWS["fx_triples"] = """
SELECT 'ex:o' || CAST(o_orderkey AS STRING) AS subject, 'Order' AS node_type, 'status' AS predicate, o_orderstatus AS object,
       TRUE AS is_literal, CAST(NULL AS STRING) AS literal_type, CAST(1 AS BIGINT) AS pos FROM orders
UNION ALL
SELECT 'ex:o' || CAST(o_orderkey AS STRING), 'Order', 'total', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), TRUE, 'xsd:integer', CAST(2 AS BIGINT) FROM orders
UNION ALL
SELECT 'ex:o' || CAST(o_orderkey AS STRING), 'Order', 'ex:customer', 'ex:c' || CAST(o_custkey AS STRING), FALSE, CAST(NULL AS STRING), CAST(3 AS BIGINT) FROM orders
UNION ALL
SELECT 'ex:c' || CAST(c_custkey AS STRING), 'Customer', 'name', c_name, TRUE, CAST(NULL AS STRING), CAST(1 AS BIGINT) FROM customer
UNION ALL
SELECT 'ex:c' || CAST(c_custkey AS STRING), 'Customer', 'balance', CAST(c_acctbal AS STRING), TRUE, 'xsd:decimal', CAST(2 AS BIGINT) FROM customer WHERE c_acctbal > 0
UNION ALL
SELECT 'ex:c' || CAST(c_custkey AS STRING), 'Customer', 'inNation', 'ex:n' || CAST(c_nationkey AS STRING), FALSE, CAST(NULL AS STRING), CAST(3 AS BIGINT) FROM customer
UNION ALL
SELECT 'ex:n' || CAST(n_nationkey AS STRING), 'Nation', 'name', n_name, TRUE, CAST(NULL AS STRING), CAST(1 AS BIGINT) FROM nation
"""

# Model calls: an assistant's turn answers the user's turn before it.
VIEWS["fx_calls"] = """
SELECT a.conv_id AS source_id,
       CASE a.turn WHEN 1 THEN 'n1_entity_extraction' WHEN 2 THEN 'n2_schema_selection_Person' WHEN 3 THEN 'n2_schema_selection_Order'
                   WHEN 4 THEN 'n3_transform_to_kg_run_0' WHEN 5 THEN 'n3_transform_to_kg_run_1' ELSE 'n5_add_labels' END AS call_name,
       a.turn AS turn, 'You answer.' AS system_prompt, u.text AS human_prompt, a.text AS response
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE a.role = 'assistant'
"""


def needed(sql: str) -> list[str]:
    """Views a text reads, each behind those it reads itself."""
    out: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bfx_\w+\b", sql)):
        if name in VIEWS:
            out += [n for n in needed(VIEWS[name]) + [name] if n not in out]
    return out


_MADE: dict[tuple, DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _MADE:
        if name in TABLES:
            _MADE[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = VIEWS[name]
            for read in set(re.findall(r"\b\w+\b", sql)) & {*TABLES, *VIEWS}:
                view(spark, sf_dir, read).createOrReplaceTempView(read)
            _MADE[key] = spark.sql(re.sub(r"ITEM\((\w+), (\d)\)", r"element_at(\1, \2)", sql))
    return _MADE[key]


def for_duckdb(body: str) -> str:
    """A statement with the views it needs in front."""
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(body)]
    body = body.strip()
    if ctes:
        head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
        rest = re.sub(r"^WITH (RECURSIVE )?", "", body, flags=re.I)
        joiner = ", " if re.match(r"WITH ", body, flags=re.I) else " "
        body = head + ", ".join(ctes) + joiner + rest
    return re.sub(r"ITEM\((\w+), (\d)\)", r"\1[\2]", body)
