"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import code_docs, conversations, keyword_pages, leakage, mixing, neighbours, splitting
from tessera.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "chunks"), keep_short=False)
    return pieces.where("piece = 0").select("id", "boundary")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "chunks"))
    return pieces.select("id", "piece", F.length("text").alias("chars"), "overlap_chars", "source_path", "start_line", "end_line", "cut", "boundary")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "chunks"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.all_neighbours(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.drop_reasons(table(spark, d, "claude_stream"))


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "claude_stream"))


def p3_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The conversations without their contigs, which SQL does not know."""
    return p3_conversations(spark, d).drop("contig")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.members_telling(table(spark, d, "module_members"), table(spark, d, "chunks")).select("id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.code_pairs(table(spark, d, "module_members"), table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages.score_pages(table(spark, d, "documents"), table(spark, d, "eval_items")).where("spam").select("doc_id")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages.score_pages(table(spark, d, "documents"), table(spark, d, "eval_items"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_neighbours, p3_found, p3_conversations, p3_ordered, p6_found, p6_pairs, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_pages)
}

_TALK = """
lines AS (
  SELECT lower(trim(session_id, E' \\t\\n\\r')) AS session_id, uuid, line_id, ts, seq,
    CASE WHEN lower(trim(type)) IN ('user', 'assistant') THEN lower(trim(type))
         WHEN nullif(trim(type), '') IS NULL THEN CASE lower(trim(message.role, E' \\t\\n\\r')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'model' THEN 'assistant' END END AS who,
    coalesce(message.content, []) AS content
  FROM claude_stream WHERE session_id IS NOT NULL AND trim(session_id, E' \\t\\n\\r') <> ''),
one AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY session_id, coalesce(uuid, CAST(line_id AS VARCHAR)) ORDER BY line_id) = 1),
m AS (
  SELECT session_id, line_id, ts, seq, who, list_filter(list_transform(list_filter(content, lambda b: b.type = 'text'), lambda b: coalesce(b.text, '')), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]')) AS said,
    who IS NOT NULL AND len(said) > 0 AS speaks
  FROM one),
talk AS (
  SELECT session_id, who, row_number() OVER w AS n, lead(who) OVER w AS next FROM m WHERE speaks
  WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS LAST, seq NULLS LAST, line_id)),
blocks AS (SELECT session_id, unnest(content) AS b FROM lines),
ids AS (
  SELECT session_id, trim(b.id) AS id, 1 AS used FROM blocks WHERE b.type = 'tool_use' AND trim(b.id) <> ''
  UNION ALL SELECT session_id, trim(b.tool_use_id), 0 FROM blocks WHERE b.type = 'tool_result' AND trim(b.tool_use_id) <> ''),
dropped AS (
  SELECT session_id FROM m GROUP BY session_id HAVING NOT bool_or(speaks)
  UNION SELECT session_id FROM talk WHERE (n = 1 AND who = 'assistant') OR (who = 'user' AND next IS DISTINCT FROM 'assistant')
  UNION SELECT session_id FROM (SELECT session_id, id FROM ids GROUP BY ALL HAVING count(DISTINCT used) = 1))
"""

SQL = {
    "p3_ordered": f"""WITH {_TALK} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS LAST, seq NULLS LAST, line_id) - 1 AS position, who AS speaker, array_to_string(said, E'\\n') AS text, ts
FROM m WHERE who IS NOT NULL AND session_id NOT IN (SELECT session_id FROM dropped)""",
    # CR LF becomes two marks of its own, so that the length stays and no line end is halved
    "p1_found": r"""
WITH t AS (SELECT id, replace(text, E'\r\n', E'\x01\n') AS x FROM chunks WHERE length(text) > 2000),
s AS (SELECT id, x, regexp_replace(x, '^([ \t]*(\x01\n|\n|\r))+', '') AS y FROM t),
m AS (
  SELECT id,
    list_max(list_transform(regexp_split_to_array(y, '(\x01\n|\n|\r)([ \t]*(\x01\n|\n|\r|$))+'), lambda b: CASE WHEN regexp_full_match(b, '[ \t]*') THEN 0 ELSE length(b) END)) AS block,
    list_max(list_transform(regexp_split_to_array(x, '\x01\n|\n|\r'), lambda b: length(b))) AS line
  FROM s)
SELECT id, CASE WHEN block <= 2000 THEN 'blank' WHEN line <= 2000 THEN 'line' ELSE 'inline' END AS boundary FROM m""",
    "p2_found": """
WITH raw AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM chunks WHERE len(embedding) = 96),
ok AS (SELECT id, v FROM raw WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (
  SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM ok a JOIN ok b ON a.id <> b.id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM c)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 5 AND s >= 0.78""",
    "p3_found": """
WITH lines AS (
  SELECT lower(trim(session_id, E' \\t\\n\\r')) AS session_id, uuid, line_id, ts, seq,
    CASE WHEN lower(trim(type)) IN ('user', 'assistant') THEN lower(trim(type))
         WHEN nullif(trim(type), '') IS NULL THEN CASE lower(trim(message.role, E' \\t\\n\\r')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'model' THEN 'assistant' END END AS who,
    coalesce(message.content, []) AS content
  FROM claude_stream WHERE session_id IS NOT NULL AND trim(session_id, E' \\t\\n\\r') <> ''),
one AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY session_id, coalesce(uuid, CAST(line_id AS VARCHAR)) ORDER BY line_id) = 1),
m AS (
  SELECT session_id, line_id, ts, seq, who,
    who IS NOT NULL AND len(list_filter(content, lambda b: b.type = 'text' AND regexp_matches(coalesce(b.text, ''), '[\\p{L}\\p{N}]'))) > 0 AS speaks
  FROM one),
talk AS (
  SELECT session_id, who, row_number() OVER w AS n, lead(who) OVER w AS next FROM m WHERE speaks
  WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS LAST, seq NULLS LAST, line_id)),
blocks AS (SELECT session_id, unnest(content) AS b FROM lines),
ids AS (
  SELECT session_id, trim(b.id) AS id, 1 AS used FROM blocks WHERE b.type = 'tool_use' AND trim(b.id) <> ''
  UNION ALL SELECT session_id, trim(b.tool_use_id), 0 FROM blocks WHERE b.type = 'tool_result' AND trim(b.tool_use_id) <> '')
SELECT session_id, 'empty' AS reason FROM m GROUP BY session_id HAVING NOT bool_or(speaks)
UNION SELECT session_id, 'no_prompt' FROM talk WHERE n = 1 AND who = 'assistant'
UNION SELECT session_id, 'no_reply' FROM talk WHERE who = 'user' AND next IS DISTINCT FROM 'assistant'
UNION SELECT DISTINCT session_id, 'lost_tool' FROM (SELECT session_id, id FROM ids GROUP BY ALL HAVING count(DISTINCT used) = 1)""",
}
