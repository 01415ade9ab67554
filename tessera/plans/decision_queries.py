"""Queries of decision mining, merging and upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decisions as dec
from tessera.session import blank_to_null, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

NOW = "2026-06-01 00:00:00"


def query(sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_PLAIN = "regexp_replace(coalesce(text, ''), E'\\r\\n?', E'\\n', 'g')"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_HITS = "CAST(len(list_filter(['migrate', 'switch to', 'replace', 'adopt', 'deprecate', 'rewrite', 'introduce', 'remove', 'extract', 'split', 'convert', 'transition', 'revert'], lambda k: contains(lower({0}), k))) AS INTEGER)"
_LINES = "CAST(len(list_filter(string_split({0}, E'\\n'), lambda x: regexp_matches(x, '\\S'))) AS INTEGER)"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the', 'for', 'to', 'of', 'in', 'on', 'and', 'or', 'with', 'is', 'be'], w))"

_PROSE = f"""
parts AS (SELECT doc_id AS id, list_filter(list_transform(string_split({_PLAIN}, E'\\n\\n'), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS b FROM documents),
para AS (SELECT id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS paragraph, unnest(b) AS body FROM parts),
prose AS (
  SELECT id, paragraph, substring(coalesce(list_filter(list_transform(string_split(body, E'\\n'), lambda x: {_TRIM.format("regexp_replace(" + _TRIM.format('x') + ", '^#+', '')")}), lambda x: x <> '')[1], body), 1, 80) AS title, body,
    {_HITS.format('body')} AS keywords, {_LINES.format('body')} AS body_lines
  FROM para WHERE keywords >= 2 OR (keywords = 1 AND body_lines >= 3))
"""

_CHANGES = f"""
cl AS (SELECT doc_id AS id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split({_PLAIN}, E'\\n') AS l FROM documents WHERE text IS NOT NULL AND NOT contains(left(text, 8192), chr(0)))),
ch AS (SELECT *, nullif(regexp_extract(line, '^#{{1,3}}\\s+(\\S.*?)\\s*$', 1), '') AS head FROM cl),
ce AS (SELECT *, count(head) OVER (PARTITION BY id ORDER BY n) AS entry FROM ch),
cg AS (SELECT id, entry, max(head) AS head, {_TRIM.format("coalesce(string_agg(line, E'\\n' ORDER BY n) FILTER (head IS NULL), '')")} AS body FROM ce WHERE entry > 0 GROUP BY 1, 2),
changes AS (SELECT id, CAST(entry AS INTEGER) AS entry, substring(head, 1, 80) AS title, body FROM cg WHERE {_HITS.format("(head || E'\\n' || body)")} >= 2 OR ({_HITS.format("(head || E'\\n' || body)")} = 1 AND {_LINES.format('body')} >= 3))
"""

_RECORDS = f"""
rb AS (SELECT doc_id AS id, {_PLAIN} AS body FROM documents WHERE text IS NOT NULL),
rh AS (SELECT id, regexp_extract(body, '(?m)^#[ \\t]+(\\S.*?)\\s*$', 1) AS head, lower(regexp_extract(body, '(?im)^status:[ \\t]*(\\S.*?)\\s*$', 1)) AS s, nullif(regexp_extract(body, '(?im)^date:[ \\t]*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS day FROM rb),
records AS (
  SELECT id, {_TRIM.format("regexp_replace(head, '^\\d+\\.\\s*', '')")} AS title,
    CASE s WHEN 'accepted' THEN 'active' WHEN 'superseded' THEN 'superseded' WHEN 'deprecated' THEN 'deprecated' WHEN 'rejected' THEN 'rejected' ELSE 'proposed' END AS status,
    1.0::DOUBLE AS confidence, TRY_CAST(day AS DATE) AS dated
  FROM rh WHERE head <> '')
"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"WITH {_PROSE} SELECT * FROM prose")
def keyword_gate(spark, d):  # noqa: ANN001, ANN201
    return dec.keyword_gate(_docs(spark, d))


@query(f"WITH {_CHANGES} SELECT * FROM changes")
def changelog_entries(spark, d):  # noqa: ANN001, ANN201
    return dec.changelog_decisions(_docs(spark, d))


@query(f"WITH {_RECORDS} SELECT * FROM records")
def decision_records(spark, d):  # noqa: ANN001, ANN201
    return dec.decision_records(_docs(spark, d))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a commit log: the first line is the subject, the rest the body."""
    t = F.regexp_replace("text", "\r\n?", "\n")
    return _docs(spark, d).where("text is not null").select(F.col("doc_id").cast("string").alias("sha"), F.col("fetched_at").alias("at"), F.regexp_extract(t, r"^([^\n]*)", 1).alias("subject"), F.regexp_replace(t, r"^[^\n]*\n?", "").alias("body"))


@query(f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, fetched_at AS "at", regexp_extract({_PLAIN}, '^([^\\n]*)', 1) AS subject, regexp_replace({_PLAIN}, '^[^\\n]*\\n?', '') AS rest FROM documents WHERE text IS NOT NULL)
SELECT id, substring(subject, 1, 80) AS title, {_TRIM.format("(subject || E'\\n' || rest)")} AS body, "at" FROM l
WHERE {_HITS.format("(subject || E'\\n' || rest)")} >= 2 OR ({_HITS.format("(subject || E'\\n' || rest)")} = 1 AND {_LINES.format('rest')} >= 3)""")
def commit_decisions(spark, d):  # noqa: ANN001, ANN201
    return dec.commit_decisions(_log(spark, d))


@query("""WITH l AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id AS id, string_split(replace(regexp_replace(text, E'\\r\\n?', E'\\n', 'g'), 'Status: ', '# DECISION: '), E'\\n') AS l FROM documents WHERE text IS NOT NULL AND NOT contains(left(text, 8192), chr(0)))),
w AS (SELECT *, string_agg(line, E'\\n') OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS evidence FROM l)
SELECT id, CAST(n AS INTEGER) AS line_no, regexp_extract(line, '#\\s*(WHY|DECISION|TRADEOFF|RATIONALE|REJECTED|WORKAROUND):\\s*(.+)', 1) AS marker, substring(trim(regexp_extract(line, '#\\s*(WHY|DECISION|TRADEOFF|RATIONALE|REJECTED|WORKAROUND):\\s*(.+)', 2)), 1, 80) AS title,
CASE WHEN marker = 'REJECTED' THEN 'rejected' ELSE 'active' END AS status, evidence FROM w WHERE regexp_matches(line, '#\\s*(WHY|DECISION|TRADEOFF|RATIONALE|REJECTED|WORKAROUND):\\s*(.+)')""")
def decision_markers(spark, d):  # noqa: ANN001, ANN201
    """The tables hold no marker, so status sentences are read as markers."""
    t = F.replace(F.regexp_replace("text", "\r\n?", "\n"), F.lit("Status: "), F.lit("# DECISION: "))
    return dec.inline_markers(_docs(spark, d).where("text is not null").select("doc_id", t.alias("text")), "doc_id").withColumnRenamed("doc_id", "id")


def _mined(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return dec.mined(adr=dec.decision_records(docs), changelog=dec.changelog_decisions(docs), prose=dec.keyword_gate(docs))


_MINED = f"""{_RECORDS}, {_CHANGES}, {_PROSE},
mined AS (
  SELECT 'adr_files' AS source, CAST(id AS VARCHAR) AS id, 0 AS place, title, status, 1.0::DOUBLE AS confidence, title AS body FROM records
  UNION ALL SELECT 'changelog', CAST(id AS VARCHAR), entry, title, 'proposed', 0.7::DOUBLE, body FROM changes
  UNION ALL SELECT 'docs_prose', CAST(id AS VARCHAR), paragraph, title, 'proposed', 0.6::DOUBLE, body FROM prose)
"""


@query(f"WITH {_MINED} SELECT source, id, place, title, status, confidence FROM mined")
def decisions_mined(spark, d):  # noqa: ANN001, ANN201
    return _mined(spark, d).drop("body")


@query(f"""WITH {_MINED}, k AS (SELECT array_to_string({_WORDS.format('title')}, '-') AS decision_key, title, body FROM mined)
SELECT decision_key, struct_extract(min(struct_pack(title := title, body := body)), 'title') AS title, struct_extract(min(struct_pack(title := title, body := body)), 'body') AS text, 'decision_record' AS kind FROM k WHERE decision_key <> '' GROUP BY 1""")
def decision_chunks(spark, d):  # noqa: ANN001, ANN201
    return dec.decision_chunks(_mined(spark, d))


_NAMES = """
tok AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '\\b[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+\\b')) AS name FROM documents),
known AS (SELECT DISTINCT unnest(list_transform(range(1, len(n) + 1), lambda i: array_to_string(n[1:i], '.'))) AS name FROM (SELECT string_split(trim(node_id, E' \\t\\n\\r'), '.') AS n FROM tree_nodes UNION ALL SELECT string_split(lower(title), '.') FROM chunks WHERE title IS NOT NULL)),
names AS (SELECT id, name FROM tok WHERE name IN (SELECT name FROM known))
"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "tree_nodes").select(blank_to_null("node_id").alias("node_id")).union(table(spark, d, "chunks").select(F.lower("title")))
    return dec.mentioned_names(_docs(spark, d), known, "doc_id", "text")


@query(f"WITH {_NAMES} SELECT * FROM names")
def decision_names(spark, d):  # noqa: ANN001, ANN201
    return _names(spark, d)


@query(f"""WITH {_NAMES}, {_RECORDS}, k AS (SELECT id, array_to_string({_WORDS.format('title')}, '-') AS key FROM records)
SELECT DISTINCT 'decision:' || key AS from_node_id, name AS to_node_id, 'governs' AS kind FROM k JOIN names USING (id) WHERE key <> ''""")
def governs_mined(spark, d):  # noqa: ANN001, ANN201
    return dec.governs_edges(dec.decision_records(_docs(spark, d)), _names(spark, d))


@query()
def decisions_merged(spark, d):  # noqa: ANN001, ANN201
    raws = _mined(spark, d).withColumn("at", F.concat_ws("/", "source", F.lpad("id", 19, "0"), F.lpad(F.col("place").cast("string"), 10, "0")))
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "package")
    raws = raws.join(docs, "id").where("package is not null")
    g = dec.greedy_groups(raws, "package", "at")
    keyed = raws.join(g.select("package", "at", "group"), ["package", "at"])
    return dec.merged_decisions(keyed)


_TARGETS = """SELECT t AS target, CASE WHEN contains(t, '/') OR regexp_matches(lower(t), '\\.(py|pyi|md|rst|txt|toml|yaml|yml|cfg)$') THEN 'path' WHEN contains(t, '.') THEN 'qname' ELSE 'both' END AS class,
string_split(CASE WHEN contains(t, '/') OR regexp_matches(lower(t), '\\.(py|pyi|md|rst|txt|toml|yaml|yml|cfg)$') THEN trim(regexp_replace(regexp_replace(t, '(?i)\\.(py|pyi|md|rst|txt|toml|yaml|yml|cfg)$', ''), '[/\\\\]', '.', 'g'), '.') ELSE t END, '.') AS p
FROM (SELECT DISTINCT trim(to_name, E' \\t\\n\\r') AS t FROM node_references UNION SELECT DISTINCT source_path FROM chunks) WHERE t <> ''"""


@query(f"SELECT target, class, list_transform(range(1, len(p)), lambda i: array_to_string(p[1:len(p) - i], '.')) AS parents FROM ({_TARGETS})")
def decision_targets(spark, d):  # noqa: ANN001, ANN201
    names = table(spark, d, "node_references").select(blank_to_null("to_name").alias("target")).union(table(spark, d, "chunks").select("source_path")).where("target is not null and target != ''").distinct()
    return names.select("target", dec.target_class(F.col("target")).alias("class"), dec.target_parents(F.col("target")).alias("parents"))


@query(f"""WITH k AS (SELECT id, array_to_string({_WORDS.format('title')}, '-') AS title_key FROM chunks)
SELECT title_key, min(id) AS first_id, count(*) AS members, round(least(1.0, 0.7::DOUBLE + 0.05::DOUBLE * (count(*) - 1)), 6) AS confidence FROM k WHERE title_key <> '' GROUP BY 1""")
def title_groups(spark, d):  # noqa: ANN001, ANN201
    return dec.title_groups(table(spark, d, "chunks"))


@query(f"""WITH t AS (SELECT name, {_WORDS.format('summary')} AS w FROM packages), s AS (SELECT list_sort(list_distinct(w)) AS w, min(name) AS rep FROM t WHERE len(w) > 0 GROUP BY 1)
SELECT x.rep AS a, y.rep AS b, round(CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / len(list_distinct(list_concat(x.w, y.w))), 6) AS overlap FROM s x JOIN s y ON x.rep < y.rep WHERE overlap >= 0.5""")
def title_jaccard(spark, d):  # noqa: ANN001, ANN201
    return dec.similar_titles(table(spark, d, "packages"), 0.5, "name", "summary")


@query(f"""SELECT package, round(least(1.0, 0.7::DOUBLE * count(*) FILTER (late) / count(*) + 0.3::DOUBLE * least(1.0, max(age) / 365.0::DOUBLE)), 6) AS staleness FROM (
SELECT package, indexed_at > captured_at + INTERVAL 1 DAY AS late, epoch(TIMESTAMP '{NOW}' - captured_at) / 86400.0 AS age FROM chunks WHERE captured_at IS NOT NULL AND indexed_at IS NOT NULL) GROUP BY package""")
def staleness(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks").where("captured_at is not null and indexed_at is not null").select("package", F.col("captured_at").cast("timestamp").alias("c"), F.col("indexed_at").cast("timestamp").alias("i"))
    age = (F.to_timestamp(F.lit(NOW)).cast("double") - F.col("c").cast("double")) / 86400
    g = c.groupBy("package").agg(F.sum(F.when(F.col("i") > F.col("c") + F.expr("interval 1 day"), 1).otherwise(0)).alias("late"), F.count("*").alias("n"), F.max(age).alias("age"))
    return g.select("package", dec.staleness(F.col("late"), F.col("n"), F.col("age")).alias("staleness"))


@query(f"""WITH c AS (SELECT name AS id, list_distinct({_WORDS.format('summary')}) AS c FROM packages WHERE summary IS NOT NULL), s AS (SELECT package AS id, list_distinct({_WORDS.format('text')}) AS s FROM chunks),
j AS (SELECT c.id, CASE WHEN len(c) > 0 THEN CAST(len(list_intersect(c, coalesce(s, []))) AS DOUBLE) / len(c) ELSE 0.0 END AS o FROM c LEFT JOIN s USING (id))
SELECT id, round(max(o), 6) AS overlap, round(max(o), 6) >= 0.6 AS verified FROM j GROUP BY id""")
def grounding_overlap(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "packages").where("summary is not null").select(F.col("name").alias("id"), F.col("summary").alias("claim"))
    return dec.grounding(c, table(spark, d, "chunks").select(F.col("package").alias("id"), F.col("text").alias("span")))


@query()
def merge_titles_greedy(spark, d):  # noqa: ANN001, ANN201
    return dec.greedy_groups(table(spark, d, "chunks").where("title is not null and package is not null"), "package", "id")
