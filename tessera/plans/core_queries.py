"""Queries of the retrieval, graph, extraction, evaluation and streaming operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, decisions, evaluation, files, filters, fusion, graph, incremental, lexical, retrieval
from tessera.session import blank_to_null, shared_folder, table
from tessera.streaming import events as stream

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


# lexical

_BM25 = """
docs AS (SELECT id, package, regexp_extract_all(lower(concat_ws(E'\\n', title, text)), '[a-z0-9]+') AS toks FROM chunks),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avgdl FROM docs),
q AS (SELECT DISTINCT name AS qid, unnest(regexp_extract_all(lower(coalesce(summary, '')), '[a-z0-9]+')) AS term FROM packages),
post AS (SELECT id, package, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, package, len(toks) AS dl, unnest(toks) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT p.term, p.id, p.package, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS part FROM post p JOIN df USING (term) CROSS JOIN stats)
"""


def _hits(where: str) -> str:
    return f"SELECT qid, id, round(sum(part), 6) AS score FROM q JOIN w USING (term) WHERE {where} GROUP BY qid, id"


def _top(hits: str, k: int) -> str:
    return f"SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({hits}) QUALIFY rank <= {k}"


def _bm25(spark: SparkSession, d: str, k: int = 10, where=None) -> DataFrame:  # noqa: ANN001
    return retrieval.bm25(table(spark, d, "chunks"), table(spark, d, "packages"), "id", F.concat_ws("\n", "title", "text"), "name", "summary", k, where)


@query(f"WITH {_BM25} {_top(_hits('true'), 10)}")
def bm25_topk(spark, d):  # noqa: ANN001, ANN201
    return _bm25(spark, d)


def _text() -> Column:
    return F.concat_ws("\n", "title", "text")


@query(SQL["bm25_topk"])
def bm25_stored(spark, d):  # noqa: ANN001, ANN201
    """The same over an index that was written to the shared folder and read again."""
    path = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    lexical.build_index(table(spark, d, "chunks"), "id", _text()).write(path)
    return lexical.search(lexical.LexicalIndex.read(spark, path), table(spark, d, "packages"), "name", "summary")


@query(f"""WITH {_BM25}, e AS (SELECT qid, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d FROM (SELECT name AS qid, regexp_extract_all(lower(coalesce(summary, '')), '[a-z0-9]+') AS w FROM packages) WHERE len(w) >= 4),
t AS (SELECT DISTINCT qid, unnest([a, b, c]) AS term FROM e), h AS (SELECT t.qid, w.id, sum(part) AS score FROM t JOIN w USING (term) GROUP BY 1, 2),
ok AS (SELECT h.qid, h.id, round(h.score, 6) AS score FROM h JOIN e USING (qid) JOIN docs USING (id) WHERE (list_contains(toks, a) AND list_contains(toks, b)) OR (list_contains(toks, c) AND NOT list_contains(toks, d)))
{_top('SELECT * FROM ok', 10)}""")
def bm25_match(spark, d):  # noqa: ANN001, ANN201
    w = F.regexp_extract_all(F.lower(F.coalesce("summary", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    q = table(spark, d, "packages").select(F.col("name").alias("qid"), w.alias("w")).where("size(w) >= 4")
    q = q.select("qid", F.concat_ws(" ", F.get("w", F.lit(0)), F.lit("AND"), F.get("w", F.lit(1)), F.lit("OR"), F.get("w", F.lit(2)), F.lit("NOT"), F.get("w", F.lit(3))).alias("terms"))
    index = lexical.build_index(table(spark, d, "chunks"), "id", _text(), None, q.select(F.explode(tx.tokens("terms")).alias("term")))
    return lexical.match(index, q, "qid", "terms")


@query()
def bm25_stemmed(spark, d):  # noqa: ANN001, ANN201
    index = lexical.build_index(table(spark, d, "chunks"), "id", _text(), stemmed=True)
    return lexical.match(index, table(spark, d, "packages"), "name", "summary")


_DEPS = "package <> '__project__'"


@query(f"WITH {_BM25} {_top(_hits(_DEPS), 10)}")
def bm25_filtered_scope(spark, d):  # noqa: ANN001, ANN201
    return _bm25(spark, d, where=filters.scope_column({"dependencies_only"}))


@query("SELECT id, title, package FROM chunks WHERE kind IN ('function', 'method') AND origin = 'dependency_def' AND contains(lower(title), 'merge')")
def filter_multifield(spark, d):  # noqa: ANN001, ANN201
    tree = filters.parse({"kind": {"in": ["function", "method"]}, "origin": "dependency_def", "title": {"like": "MERGE"}})
    filters.check(tree, {"kind", "origin", "title"})
    return table(spark, d, "chunks").where(filters.column(tree)).select("id", "title", "package")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND (p_brand = 'Brand#12' OR NOT contains(lower(p_type), 'steel'))")
def filter_any_not(spark, d):  # noqa: ANN001, ANN201
    tree = filters.And((filters.Like("p_name", "A"), filters.Or((filters.Eq("p_brand", "Brand#12"), filters.Not(filters.Like("p_type", "steel"))))))
    return table(spark, d, "part").where(filters.column(tree)).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), '50%') OR contains(lower(text), '_lock')")
def filter_like_literal(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(filters.column(filters.Or((filters.Like("text", "50%"), filters.Like("text", "_LOCK"))))).select("doc_id")


@query("""WITH q AS (SELECT DISTINCT node_id AS qid, lower(split_part(node_id, '.', -1)) AS needle FROM shared_symbols),
m AS (SELECT id, concat_ws(chr(0), lower(name), lower(docstring)) AS hay FROM module_members)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY id) AS INTEGER) AS rank FROM q JOIN m ON contains(hay, needle) QUALIFY rank <= 50""")
def member_like_search(spark, d):  # noqa: ANN001, ANN201
    q = table(spark, d, "shared_symbols").select("node_id", F.substring_index("node_id", ".", -1).alias("needle_")).distinct()
    return retrieval.like_search(table(spark, d, "module_members"), q, "node_id", "needle_")


# files

_LINES = "lines AS (SELECT doc_id AS id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents WHERE text IS NOT NULL AND NOT contains(left(text, 8192), chr(0))))"
_RX = "(TODO|WARN|return) [a-z]+_[a-z]+"


@query(f"WITH {_LINES} SELECT * FROM lines WHERE regexp_matches(line, '{_RX}')")
def grep_lines(spark, d):  # noqa: ANN001, ANN201
    return files.grep(table(spark, d, "documents"), "doc_id", _RX)


@query(f"WITH {_LINES} SELECT id, count(*) AS matches FROM lines WHERE regexp_matches(line, '{_RX}') GROUP BY id")
def grep_count_per_file(spark, d):  # noqa: ANN001, ANN201
    return files.grep_counts(table(spark, d, "documents"), "doc_id", _RX)


@query(f"""WITH {_LINES}, h AS (SELECT id, greatest(line_no - 2, 1) AS a, line_no + 3 AS b FROM lines WHERE regexp_matches(line, '{_RX}')),
f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a, b) AS island FROM f)
SELECT id, min(a) AS first_line, max(b) AS last_line, count(*) AS hits FROM g GROUP BY id, island""")
def grep_context_windows(spark, d):  # noqa: ANN001, ANN201
    return files.context_windows(files.grep(table(spark, d, "documents"), "doc_id", _RX), 2, 3)


@query("SELECT doc_id, source_path FROM documents WHERE regexp_matches(source_path, '^(?:[^/]+/)*docs/[^/]*_[^/]{4}[^/]*\\.md$')")
def glob_match(spark, d):  # noqa: ANN001, ANN201
    return files.glob_match(table(spark, d, "documents"), "source_path", "**/docs/*_????*.md").select("doc_id", "source_path")


@query("SELECT doc_id, source_path FROM documents WHERE NOT coalesce(list_contains(string_split(source_path, '/'), 'notes') OR source_path = 'project/docs' OR starts_with(source_path, 'project/docs/'), false)")
def exclude_paths(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(~files.excluded(F.col("source_path"), ["notes"], ["project/docs/"])).select("doc_id", "source_path")


@query(f"WITH {_LINES} SELECT * FROM lines WHERE line_no BETWEEN 3 AND 7")
def read_window(spark, d):  # noqa: ANN001, ANN201
    return files.read_window(table(spark, d, "documents"), "doc_id", 3, 5)


# dense

_VEC = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT id AS qid, label AS ql, e AS qe FROM v WHERE id % 50 = 0)"


def _vectors(spark, d):  # noqa: ANN001, ANN202
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding", F.col("label").alias("ql"))


@query(f"WITH {_VEC} {_top('SELECT qid, id, round(list_dot_product(qe, e), 6) AS score FROM v, q', 10)}")
def dense_topk(spark, d):  # noqa: ANN001, ANN201
    return retrieval.dense(*_vectors(spark, d))


@query(f"WITH {_VEC} {_top('SELECT qid, id, round(list_dot_product(qe, e), 6) AS score FROM v, q WHERE label < 5', 10)}")
def dense_topk_allowlist(spark, d):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, d)
    return retrieval.dense(v, q, 10, v.where("label < 5"))


_USABLE = "u AS (SELECT id, package, CASE WHEN len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 96 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM chunks)"


@query(f"""WITH {_USABLE}, s AS (SELECT q.id AS qid, u.id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY u.id) AS INTEGER) AS rank, CASE WHEN u.e IS NOT NULL THEN round(list_dot_product(q.e, u.e), 6) END AS dense FROM u q JOIN u USING (package) WHERE q.id % 50 = 0 AND q.e IS NOT NULL)
SELECT qid, id, dense, CAST(row_number() OVER (PARTITION BY qid ORDER BY dense IS NULL, dense DESC, rank, id) AS INTEGER) AS new_rank FROM s QUALIFY new_rank <= 100""")
def dense_rescore_keep_unscored(spark, d):  # noqa: ANN001, ANN201
    """The chunks of a chunk's package as candidates; those without a usable vector stay unscored."""
    from pyspark.sql.window import Window as W

    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = table(spark, d, "chunks").select("id", "package", F.when((F.size("embedding") == 96) & ~bad, F.col("embedding")).alias("embedding"))
    q = v.where("id % 50 = 0 and embedding is not null").select(F.col("id").alias("qid"), "package", "embedding")
    c = v.select("id", "package").join(q.select("qid", "package"), "package").select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("id")).alias("rank"))
    return retrieval.dense_rescore(c, v, q)


_MAT = "m AS (SELECT id // 4 AS id, list(e ORDER BY id) AS x FROM v GROUP BY 1)"


@query(f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), {_MAT},
p AS (SELECT a.id AS qid, b.id AS id, round(list_sum(list_transform(a.x, lambda s: list_max(list_transform(b.x, lambda t: list_dot_product(s, t))))), 6) AS score FROM m a, m b WHERE a.id % 50 = 0)
{_top('SELECT * FROM p', 10)}""")
def maxsim_rescore(spark, d):  # noqa: ANN001, ANN201
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("id"), F.struct("vec_id", "embedding").alias("x"))
    m = v.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda s: s["embedding"]).alias("matrix"))
    q = m.where("id % 50 = 0").select(F.col("id").alias("qid"), "matrix")
    c = m.select("id").crossJoin(F.broadcast(q.select("qid")))
    return retrieval.late_interaction(c, m, q, 10)


@query(f"WITH {_VEC} {_top('SELECT qid, id, round(list_dot_product(qe, e), 6) AS score FROM v, q WHERE id <> qid AND label = ql', 5)}")
def similar_edges_knn(spark, d):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, d)
    return retrieval.similar_edges(v, q, 5, same=("label", "ql"))


# fusion


def _two_branches(spark: SparkSession, d: str) -> list[DataFrame]:
    """All chunks and those of dependencies, from one index."""
    q = table(spark, d, "packages").select("name", "summary")
    index = lexical.build_index(table(spark, d, "chunks"), "id", _text(), {"ok": filters.scope_column({"dependencies_only"})}, q.select(F.explode(tx.tokens("summary")).alias("term")))
    return [lexical.search(index, q, "name", "summary", 20), lexical.search(index, q, "name", "summary", 20, F.col("ok"))]


_BR = f"""WITH {_BM25}, a AS ({_top(_hits('true'), 20)}), b AS ({_top(_hits(_DEPS), 20)})"""


@query(f"""{_BR}, u AS (SELECT qid, id, rank, 0 AS branch FROM a UNION ALL SELECT qid, id, rank, 1 FROM b),
s AS (SELECT qid, id, round(sum(1.0 / (60 + rank - 1)), 9) AS score, min(branch * 1000 + rank) AS seen FROM u GROUP BY qid, id)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS INTEGER) AS rank FROM s""")
def rrf_fusion(spark, d):  # noqa: ANN001, ANN201
    return fusion.rrf(_two_branches(spark, d))


@query(f"""{_BR}, u AS (SELECT qid, id, score, 0 AS branch, 0.3 AS w FROM a UNION ALL SELECT qid, id, score, 1, 0.7 FROM b),
n AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM u WINDOW p AS (PARTITION BY qid, branch)),
s AS (SELECT qid, id, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END * CAST(w AS DOUBLE)), 9) AS score FROM n GROUP BY qid, id)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s""")
def weighted_fusion(spark, d):  # noqa: ANN001, ANN201
    return fusion.weighted(_two_branches(spark, d), [0.3, 0.7])


@query("""WITH x AS (SELECT coalesce(origin, '') AS qid, qualified_name, id, package = '__project__' AS is_root, indexed_at, CAST(relevance AS DOUBLE) AS score FROM chunks WHERE relevance IS NOT NULL AND qualified_name IS NOT NULL),
o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY qid, qualified_name ORDER BY is_root DESC, indexed_at DESC NULLS LAST, score DESC, id) = 1)
SELECT qid, qualified_name, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM o QUALIFY rank <= 20""")
def merge_ranked_multi_source(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks").where("relevance is not null and qualified_name is not null")
    x = c.select(F.coalesce("origin", F.lit("")).alias("qid"), "qualified_name", "id", (F.col("package") == "__project__").alias("is_root"), "indexed_at", F.col("relevance").alias("score"))
    return fusion.merge_ranked(x, ["qualified_name"], 20).select("qid", "qualified_name", "id", "score", "rank")


_MMR = f"r AS ({_top('SELECT qid, id, round(list_dot_product(qe, e), 6) AS score FROM v, q', 30)})"


@query(f"""WITH {_VEC}, {_MMR}, a AS (SELECT r.*, label AS community, round(CASE WHEN row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, rank) = 1 THEN score ELSE score - 0.5 END, 9) AS adjusted FROM r JOIN v USING (id))
SELECT qid, id, score, rank, community, adjusted, CAST(row_number() OVER (PARTITION BY qid ORDER BY adjusted DESC, rank) AS INTEGER) AS new_rank FROM a""")
def community_mmr(spark, d):  # noqa: ANN001, ANN201
    v, q = _vectors(spark, d)
    return fusion.diversify(retrieval.dense(v, q, 30).join(v.select("id", F.col("label").alias("community")), "id"))


# graph

_E = """
e AS (
  SELECT package, src, name, kind, dst, ref_id FROM (
    SELECT ref_id, received_at, nullif(trim(from_package, E' \\t\\n\\r'), '') AS package, nullif(trim(from_node_id, E' \\t\\n\\r'), '') AS src,
      nullif(trim(to_name, E' \\t\\n\\r'), '') AS name, nullif(trim(to_node_id, E' \\t\\n\\r'), '') AS dst, lower(nullif(trim(kind, E' \\t\\n\\r'), '')) AS kind FROM node_references)
  QUALIFY row_number() OVER (PARTITION BY package, src, name, kind ORDER BY received_at DESC NULLS LAST, ref_id DESC NULLS LAST, dst DESC NULLS LAST) = 1)
"""
_TG = "tg AS (SELECT DISTINCT node_id AS target FROM shared_symbols)"


def _edges(spark, d):  # noqa: ANN001, ANN202
    return graph.edges_of(table(spark, d, "node_references"))


def _targets(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "shared_symbols").select(F.col("node_id").alias("target")).distinct()


def _nodes(spark, d):  # noqa: ANN001, ANN202
    t = table(spark, d, "tree_nodes")
    return t.select(blank_to_null("node_id").alias("node"), "package", "project", "kind", "module").where("node is not null").distinct()


@query(f"WITH {_E}, {_TG} SELECT DISTINCT target, src AS node, kind FROM e JOIN tg ON dst = target WHERE src IS NOT NULL")
def graph_callers(spark, d):  # noqa: ANN001, ANN201
    return graph.neighbours(_edges(spark, d), _targets(spark, d))


def _closure(a: str, b: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_E}, {_TG}, l AS (SELECT DISTINCT {a} AS at, {b} AS too FROM e WHERE dst IS NOT NULL AND kind <> 'similar'),
r AS (SELECT target, target AS node, 0 AS hop FROM tg UNION SELECT r.target, l.too, r.hop + 1 FROM r JOIN l ON l.at = r.node WHERE r.hop < {depth})
SELECT target, node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY target, node HAVING min(hop) > 0"""


@query(_closure("dst", "src", 3))
def graph_reverse_closure(spark, d):  # noqa: ANN001, ANN201
    return graph.closure(_edges(spark, d), _targets(spark, d), 3)


@query(f"""WITH RECURSIVE {_E}, tg AS (SELECT DISTINCT src AS target FROM e WHERE kind = 'inherits'), l AS (SELECT DISTINCT src AS at, dst AS too FROM e WHERE dst IS NOT NULL AND kind <> 'similar'),
r AS (SELECT target, target AS node, 0 AS hop FROM tg UNION SELECT r.target, l.too, r.hop + 1 FROM r JOIN l ON l.at = r.node WHERE r.hop < 2)
SELECT target, node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY target, node HAVING min(hop) > 0""")
def graph_forward_closure(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d)
    return graph.closure(e, e.where("kind = 'inherits'").select(F.col("src").alias("target")).distinct(), 2, "out")


@query(f"""WITH {_E}, seeds AS (SELECT 0 AS qid, src AS node, max(1.0 / (1 + ref_id % 7)) AS score FROM e WHERE kind = 'inherits' GROUP BY src),
l AS (SELECT src, dst, CASE kind WHEN 'calls' THEN 1.0 ELSE 0.8 END AS w FROM (SELECT DISTINCT src, dst, kind FROM e WHERE dst IS NOT NULL AND kind IN ('calls', 'inherits')) QUALIFY row_number() OVER (PARTITION BY src ORDER BY kind, dst) <= 25),
h1 AS (SELECT qid, dst AS node, max(score * 0.9 * w) AS score FROM seeds JOIN l ON src = node GROUP BY ALL),
f1 AS (SELECT * FROM h1 WHERE node NOT IN (SELECT node FROM seeds)),
h2 AS (SELECT qid, dst AS node, max(score * 0.9 * w) AS score FROM f1 JOIN l ON src = node GROUP BY ALL),
u AS (SELECT *, 0 AS hop FROM seeds UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)
SELECT qid, node, round(CAST(max(score) AS DOUBLE), 9) AS score, min(hop) AS hop FROM u GROUP BY qid, node""")
def graph_expand(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d)
    seeds = e.where("kind = 'inherits'").groupBy(F.col("src").alias("node")).agg(F.max(F.lit(1.0) / (1 + F.col("ref_id") % 7)).alias("score")).select(F.lit(0).alias("qid"), "node", "score")
    return graph.expand(seeds, e, 2, 0.9, 25, {"calls": 1.0, "inherits": 0.8})


@query(f"""WITH {_E}, own AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS node, package FROM tree_nodes WHERE package IS NOT NULL),
i AS (SELECT own.package, count(*) AS n FROM e JOIN own ON dst = node GROUP BY 1), o AS (SELECT package, count(*) AS n FROM e WHERE NOT src LIKE 'decision:%' GROUP BY 1)
SELECT coalesce(i.package, o.package) AS package, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM i FULL JOIN o ON i.package = o.package""")
def graph_degree(spark, d):  # noqa: ANN001, ANN201
    return graph.degree_by_package(_edges(spark, d), _nodes(spark, d).where("package is not null").select("node", "package").distinct())


@query(f"""WITH {_E} SELECT package, split_part(name, '.', 1) AS target, count(*) AS imports FROM e WHERE kind = 'imports' AND split_part(name, '.', 1) <> replace(package, '-', '_') GROUP BY ALL""")
def graph_import_profile(spark, d):  # noqa: ANN001, ANN201
    return graph.import_profile(_edges(spark, d))


_PR = f"""{_E}, l AS (SELECT DISTINCT src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL), o AS (SELECT src, count(*) AS deg FROM l GROUP BY src),
nd AS (SELECT src AS node FROM l UNION SELECT dst FROM l), c AS (SELECT count(*) AS n FROM nd),
r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM nd, c)"""


def _pr_round(i: int) -> str:
    return f""", r{i + 1} AS (SELECT nd.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM o)) / n) AS r
FROM nd CROSS JOIN c LEFT JOIN (SELECT l.dst AS node, sum(x.r / o.deg) AS got FROM r{i} x JOIN l ON l.src = x.node JOIN o ON o.src = x.node GROUP BY 1) g ON g.node = nd.node)"""


@query("WITH " + _PR + "".join(map(_pr_round, range(5))) + " SELECT node, round(r, 9) AS pagerank FROM r5")
def graph_pagerank(spark, d):  # noqa: ANN001, ANN201
    return graph.pagerank(_edges(spark, d), rounds=5).select("node", F.round("pagerank", 9).alias("pagerank"))


def _converged(e):  # noqa: ANN001, ANN202
    return graph.pagerank(e, rounds=200, tolerance=1e-10)


@query()
def graph_pagerank_converged(spark, d):  # noqa: ANN001, ANN201
    return _converged(_edges(spark, d)).select("node", F.round("pagerank", 9).alias("pagerank"))


@query()
def graph_communities(spark, d):  # noqa: ANN001, ANN201
    return graph.communities(_edges(spark, d))


@query(f"""WITH {_E}, s AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS node, min(package) AS community FROM tree_nodes WHERE package IS NOT NULL GROUP BY 1)
SELECT a.community, count(*) FILTER (a.community = b.community) AS intra, count(*) FILTER (a.community <> b.community) AS cross,
  round(CAST(count(*) FILTER (a.community = b.community) AS DOUBLE) / count(*), 9) AS cohesion FROM e JOIN s a ON a.node = src JOIN s b ON b.node = dst GROUP BY a.community""")
def graph_cohesion(spark, d):  # noqa: ANN001, ANN201
    s = _nodes(spark, d).where("package is not null").groupBy("node").agg(F.min("package").alias("community"))
    return graph.cohesion(_edges(spark, d), s)


@query(f"""WITH {_E}, o AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1) SELECT node, out_degree FROM o WHERE node NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL) AND out_degree > (SELECT quantile_cont(out_degree, 0.5) FROM o)""")
def graph_roots_median(spark, d):  # noqa: ANN001, ANN201
    return graph.roots_over_median(_edges(spark, d))


@query(f"WITH {_E} SELECT DISTINCT regexp_replace(src, '^decision:', '') AS decision, dst AS node FROM e WHERE kind = 'governs' AND dst IS NOT NULL")
def graph_governed(spark, d):  # noqa: ANN001, ANN201
    return graph.governed(_edges(spark, d))


@query(f"""WITH {_E}, m AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS node FROM tree_nodes WHERE kind = 'module') SELECT m.node, count(*) AS in_degree FROM m JOIN e ON e.dst = m.node WHERE m.node NOT IN (SELECT dst FROM e WHERE kind = 'governs' AND dst IS NOT NULL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def graph_ungoverned(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d)
    return graph.ungoverned(_nodes(spark, d).where("kind = 'module'"), e, graph.fan_in(e))


@query(f"""WITH {_E}, t AS (SELECT DISTINCT coalesce(dst, name) AS target FROM e WHERE kind = 'inherits' AND coalesce(dst, name) IS NOT NULL)
SELECT src AS target, 'base' AS relation, coalesce(dst, name) AS node FROM e WHERE kind = 'inherits' AND src IN (SELECT target FROM t) AND coalesce(dst, name) IS NOT NULL
UNION SELECT coalesce(dst, name), 'subclass', src FROM e WHERE kind = 'inherits' AND coalesce(dst, name) IS NOT NULL AND src IS NOT NULL""")
def graph_inherits(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d)
    t = e.where("kind = 'inherits'").select(F.coalesce("dst", "name").alias("target")).where("target is not null").distinct()
    return graph.inheritance(e, t)


@query(f"""WITH RECURSIVE {_E}, {_TG}, l AS (SELECT DISTINCT dst AS at, src AS too FROM e WHERE dst IS NOT NULL AND kind <> 'similar'),
r AS (SELECT target, target AS node, 0 AS hop FROM tg UNION SELECT r.target, l.too, r.hop + 1 FROM r JOIN l ON l.at = r.node WHERE r.hop < 3),
m AS (SELECT target, node, min(hop) AS hop FROM r GROUP BY 1, 2 HAVING min(hop) > 0), fi AS (SELECT dst AS node, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY 1)
SELECT target, m.node, CAST(hop AS INTEGER) AS hop, CAST(row_number() OVER (PARTITION BY target ORDER BY hop, coalesce(n, 0) DESC, m.node) AS INTEGER) AS rank FROM m LEFT JOIN fi ON fi.node = m.node QUALIFY rank <= 50""")
def impact_ranked(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d)
    return graph.impact(e, _targets(spark, d), graph.fan_in(e).withColumn("pagerank", F.lit(0.0)))


@query()
def impact_by_pagerank(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d)
    # equal scores differ in the last bits by the order of their sums
    p = _converged(e).select("node", F.round("pagerank", 14).alias("pagerank"))
    return graph.impact(e, _targets(spark, d), p.join(graph.fan_in(e), "node", "left"))


@query(f"""WITH {_E}, n AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS node FROM tree_nodes) SELECT ref_id, coalesce(dst, n.node) AS dst FROM e LEFT JOIN n ON n.node = e.name""")
def resolve_exact(spark, d):  # noqa: ANN001, ANN201
    return graph.resolve_exact(_edges(spark, d), _nodes(spark, d)).select("ref_id", "dst")


@query(f"""WITH {_E}, n AS (SELECT DISTINCT package, trim(node_id, E' \\t\\n\\r') AS node FROM tree_nodes),
h AS (SELECT o.package, o.name, min(n.node) AS hit FROM (SELECT DISTINCT package, name FROM e WHERE dst IS NULL AND name IS NOT NULL) o
  JOIN n ON n.package = o.package AND split_part(n.node, '.', -1) = split_part(o.name, '.', -1) AND (n.node = o.name OR ends_with(n.node, '.' || o.name)) GROUP BY 1, 2 HAVING count(*) = 1)
SELECT ref_id, coalesce(dst, hit) AS dst, CASE WHEN dst IS NOT NULL THEN 'given' WHEN hit IS NOT NULL THEN 'suffix' ELSE 'none' END AS how FROM e LEFT JOIN h ON h.package = e.package AND h.name = e.name""")
def resolve_suffix_unique(spark, d):  # noqa: ANN001, ANN201
    return graph.resolve_suffix(_edges(spark, d), _nodes(spark, d)).select("ref_id", "dst", "how")


@query(f"""WITH {_E}, p AS (SELECT name AS package, project FROM packages WHERE project IS NOT NULL), s AS (SELECT DISTINCT project AS to_project, trim(node_id, E' \\t\\n\\r') AS node FROM tree_nodes)
SELECT ref_id, p.project, s.node, min(to_project) AS to_project FROM e JOIN p ON p.package = e.package JOIN s ON s.node = e.name WHERE dst IS NULL AND p.project <> to_project GROUP BY 1, 2, 3 HAVING count(DISTINCT to_project) = 1""")
def link_projects(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "packages").where("project is not null").select(F.col("name").alias("package"), "project")
    return graph.link_projects(_edges(spark, d).join(p, "package"), _nodes(spark, d))


@query("""WITH n AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS node FROM tree_nodes), p AS (SELECT node, string_split(node, '.') AS p FROM n)
SELECT node, CASE WHEN len(p) >= 3 AND regexp_matches(p[-2], '^_*[A-Z]') THEN array_to_string(p[:-3], '.') ELSE array_to_string(p[:-2], '.') END AS module,
  CASE WHEN len(p) >= 3 AND regexp_matches(p[-2], '^_*[A-Z]') THEN p[-2] END AS class FROM p""")
def split_symbols(spark, d):  # noqa: ANN001, ANN201
    module, cls = graph.split_symbol()
    return _nodes(spark, d).select("node").distinct().select("node", module.alias("module"), cls.alias("class"))


@query(f"""WITH {_E}, v AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS p FROM tree_nodes WHERE kind = 'module'), l AS (SELECT DISTINCT src, dst, kind FROM e WHERE dst IS NOT NULL),
u AS (SELECT n, arg_max(p, length(p)) AS up FROM (SELECT src AS n FROM l UNION SELECT dst FROM l) JOIN v ON n = p OR starts_with(n, p || '.') GROUP BY n)
SELECT DISTINCT a.up AS src, b.up AS dst, kind FROM l JOIN u a ON a.n = src JOIN u b ON b.n = dst WHERE a.up <> b.up""")
def lift_to_modules(spark, d):  # noqa: ANN001, ANN201
    return graph.lift(_edges(spark, d), _nodes(spark, d).where("kind = 'module'"))


@query()
def package_tree(spark, d):  # noqa: ANN001, ANN201
    return graph.package_tree(table(spark, d, "tree_nodes"))


@query(f"""WITH {_E}, c AS (SELECT DISTINCT trim(from_node_id, E' \\t\\n\\r') AS src, trim(to_name, E' \\t\\n\\r') AS name, lower(trim(kind, E' \\t\\n\\r')) AS kind, trim(to_node_id, E' \\t\\n\\r') AS dst FROM cross_references),
m AS (SELECT src, name, kind, min(dst) AS c FROM c GROUP BY 1, 2, 3)
SELECT DISTINCT * FROM (SELECT e.src, e.name, e.kind, coalesce(e.dst, m.c) AS dst FROM e LEFT JOIN m ON m.src = e.src AND m.name = e.name AND m.kind = e.kind
UNION ALL SELECT src, name, kind, dst FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.kind = c.kind AND e.dst = c.dst) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.kind = c.kind AND e.name = c.name))""")
def merge_cross_edges(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "cross_references").select(blank_to_null("from_node_id").alias("src"), blank_to_null("to_name").alias("name"), F.lower(blank_to_null("kind")).alias("kind"), blank_to_null("to_node_id").alias("dst")).distinct()
    return graph.merge_cross(_edges(spark, d), x)


@query(f"""WITH {_E}, fi AS (SELECT dst AS node, count(*) AS m FROM e WHERE dst IS NOT NULL GROUP BY 1),
c AS (SELECT coalesce(origin, '') AS qid, id, qualified_name AS node, CAST(relevance AS DOUBLE) AS score FROM chunks WHERE relevance IS NOT NULL),
j AS (SELECT c.*, ln(1 + coalesce(m, 0)) AS m FROM c LEFT JOIN fi ON fi.node = c.node)
SELECT node, qid, id, round(CASE WHEN max(m) OVER (PARTITION BY qid) > 0 THEN score * (1 + 0.5 * m / max(m) OVER (PARTITION BY qid)) ELSE score END, 6) AS score FROM j""")
def centrality_boost(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks").where("relevance is not null").select(F.coalesce("origin", F.lit("")).alias("qid"), "id", F.col("qualified_name").alias("node"), F.col("relevance").alias("score"))
    return fusion.centrality_boost(c, graph.fan_in(_edges(spark, d)), "in_degree", digits=6)


# budgets


@query(f"""WITH {_BM25}, r AS ({_top(_hits('true'), 8)}),
p AS (SELECT qid, rank, '## ' || coalesce(c.title, '') || E'\\n' || coalesce(c.text, '') || E'\\n' AS piece FROM r JOIN chunks c USING (id)),
b AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
k AS (SELECT qid, rank, CASE WHEN before + length(piece) <= 2000 THEN piece WHEN before < 2000 AND 2000 - before > 100 THEN substring(piece, 1, CAST(2000 - before AS BIGINT)) END AS piece FROM b)
SELECT qid, string_agg(piece, '' ORDER BY rank) AS text, CAST(count(piece) AS INTEGER) AS pieces FROM k WHERE piece IS NOT NULL GROUP BY qid""")
def token_budget_pack(spark, d):  # noqa: ANN001, ANN201
    r = retrieval.hydrate(_bm25(spark, d, 8), table(spark, d, "chunks"), "id", ["title", "text"])
    return fusion.token_budget(r, 500)


@query("""WITH s AS (SELECT coalesce(project, '') AS project, package, sum(length(coalesce(text, ''))) AS chars FROM chunks JOIN (SELECT name, project FROM packages) p ON p.name = package GROUP BY ALL),
w AS (SELECT *, count(*) OVER p AS n, sum(chars) OVER p AS t FROM s WINDOW p AS (PARTITION BY project))
SELECT project, package, CAST(chars AS BIGINT) AS chars, CAST(CASE WHEN n * 204 > 2048 THEN floor(2048 / n) WHEN t > 0 THEN 204 + floor((2048 - n * 204) * chars / t) ELSE 204 + floor((2048 - n * 204) / n) END AS BIGINT) AS budget FROM w""")
def budget_split(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "packages").select(F.col("name").alias("package"), F.coalesce("project", F.lit("")).alias("project"))
    s = table(spark, d, "chunks").join(p, "package").groupBy("project", "package").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))
    return fusion.split_budget(s, 2048, "project", "chars")


@query()
def context_pack(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks").where("text is not null and qualified_name is not null").groupBy("qualified_name").agg(F.max(F.length("text")).alias("chars"))
    n = graph.closure(_edges(spark, d), _targets(spark, d), 2).join(c, F.col("node") == F.col("qualified_name"))
    return fusion.pack_context(n.select(F.col("target").alias("qid"), F.col("node").alias("id"), (-F.col("hop")).cast("double").alias("score"), "hop", "chars"), 8192)


@query("""WITH t AS (SELECT DISTINCT trim(node_id, E' \\t\\n\\r') AS node, trim(parent_id, E' \\t\\n\\r') AS parent, min(kind) AS kind FROM tree_nodes WHERE kind IN ('method', 'class') GROUP BY 1, 2),
hits AS (SELECT 0 AS qid, qualified_name AS node, CAST(max(relevance) AS DOUBLE) AS score FROM chunks WHERE relevance IS NOT NULL AND qualified_name IS NOT NULL GROUP BY 2),
kids AS (SELECT parent, count(DISTINCT node) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1),
need AS (SELECT k.parent, children, CASE t.kind WHEN 'class' THEN 0.3 ELSE 0.5 END AS need FROM kids k LEFT JOIN (SELECT DISTINCT node, kind FROM t) t ON t.node = k.parent),
j AS (SELECT h.*, n.parent, need, children, count(*) OVER (PARTITION BY n.parent) AS hit FROM hits h LEFT JOIN (SELECT node, parent FROM t) u ON u.node = h.node LEFT JOIN need n ON n.parent = u.parent),
r AS (SELECT *, parent IS NOT NULL AND hit >= 2 AND hit >= need * children AS roll FROM j)
SELECT qid, CASE WHEN roll THEN parent ELSE node END AS node, max(score) AS score, CAST(max(CASE WHEN roll THEN 1 ELSE 0 END) AS INTEGER) AS rolled FROM r GROUP BY 1, 2""")
def parent_rollup(spark, d):  # noqa: ANN001, ANN201
    t = table(spark, d, "tree_nodes").where("kind in ('method', 'class')").groupBy(blank_to_null("node_id").alias("node"), blank_to_null("parent_id").alias("parent")).agg(F.min("kind").alias("kind"))
    h = table(spark, d, "chunks").where("relevance is not null and qualified_name is not null").select(F.lit(0).alias("qid"), F.col("qualified_name").alias("node"), F.col("relevance").alias("score"))
    return fusion.parent_rollup(h, t, levels=1)


@query()
def parent_rollup_tree(spark, d):  # noqa: ANN001, ANN201
    t = table(spark, d, "tree_nodes").select(blank_to_null("node_id").alias("node"), blank_to_null("parent_id").alias("parent"), F.lower(blank_to_null("kind")).alias("kind"))
    h = table(spark, d, "chunks").where("relevance is not null and qualified_name is not null").select(F.lit(0).alias("qid"), F.col("qualified_name").alias("node"), F.col("relevance").alias("score"))
    return fusion.rollup_tree(h, t)


# extraction

_BODY = "regexp_replace(text, E'\\r\\n?', E'\\n', 'g')"


@query()
def markdown_sections(spark, d):  # noqa: ANN001, ANN201
    return chunking.markdown_sections(table(spark, d, "documents"))


@query(f"SELECT doc_id AS id, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS no, regexp_extract(unnest(b), '```([^\\n]*)\\n', 1) AS language, regexp_extract(unnest(b), '(?s)```[^\\n]*\\n(.*)\\n```$', 1) AS code FROM (SELECT doc_id, regexp_extract_all({_BODY}, '(?s)(?:^|\\n)```[^\\n]*\\n.*?\\n```') AS b FROM documents WHERE text IS NOT NULL)")
def code_fences(spark, d):  # noqa: ANN001, ANN201
    return chunking.code_fences(table(spark, d, "documents"))


@query()
def rst_sections(spark, d):  # noqa: ANN001, ANN201
    """The tables hold no underlined titles, so headings of level 1 are underlined."""
    docs = table(spark, d, "documents").withColumn("text", F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(?m)^# (.+)$", "$1\n" + "=" * 200))
    return chunking.rst_sections(docs)


@query()
def header_sections(spark, d):  # noqa: ANN001, ANN201
    return chunking.header_sections(table(spark, d, "chunks").where("kind = 'text_section'"))


@query()
def json_keys(spark, d):  # noqa: ANN001, ANN201
    return chunking.json_keys(table(spark, d, "chunks").where("text is not null"))


@query(f"""WITH l AS (SELECT doc_id, string_split({_BODY}, E'\\n') AS l FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, l, unnest(range(0, CAST(ceil(len(l) / 80.0) AS BIGINT))) AS w FROM l)
SELECT doc_id AS id, CAST(w AS INTEGER) AS "window", 'lines ' || (w * 80 + 1) || '-' || least(w * 80 + 80, len(l)) AS title, array_to_string(l[w * 80 + 1 : w * 80 + 80], E'\\n') AS text FROM w""")
def chunk_windows(spark, d):  # noqa: ANN001, ANN201
    return chunking.line_windows(table(spark, d, "documents"))


@query("SELECT id, name, count(*) AS times FROM (SELECT doc_id AS id, unnest(regexp_extract_all(coalesce(text, ''), '`([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+)`', 1)) AS name FROM documents) GROUP BY ALL")
def mentions_extract(spark, d):  # noqa: ANN001, ANN201
    return chunking.mentions(table(spark, d, "documents"))


@query()
def python_symbols(spark, d):  # noqa: ANN001, ANN201
    return chunking.python_symbols(table(spark, d, "chunks").where(F.lower(blank_to_null("kind")).isin("function", "method", "class")))


# incremental

_HASH = "sha256(" + " || ".join(f"CAST(strlen(coalesce({c}, '')) AS VARCHAR) || chr(0) || coalesce({c}, '')" for c in ("package", "module", "title", "text")) + ")"


@query(f"SELECT id, {_HASH} AS hash FROM chunks")
def content_hash(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "chunks").select("id", tx.content_hash("package", "module", "title", "text").alias("hash"))


_OLD_NEW = "old AS (SELECT id, package, content_hash FROM chunks WHERE id % 10 <> 3), new AS (SELECT id, package, content_hash FROM chunks WHERE id % 10 <> 7)"


def _two(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "chunks").select("id", "package", "content_hash")
    return c.where("id % 10 != 3"), c.where("id % 10 != 7")


@query(f"""WITH {_OLD_NEW}, a AS (SELECT *, row_number() OVER (PARTITION BY package, content_hash ORDER BY id) AS n FROM old), b AS (SELECT *, row_number() OVER (PARTITION BY package, content_hash ORDER BY id) AS n FROM new)
SELECT coalesce(a.package, b.package) AS package, coalesce(a.content_hash, b.content_hash) AS hash, CASE WHEN b.id IS NULL THEN 'delete' WHEN a.id IS NULL THEN 'insert' ELSE 'keep' END AS action, a.id AS existing_id, b.id AS incoming_id
FROM a FULL JOIN b ON a.package = b.package AND a.content_hash = b.content_hash AND a.n = b.n""")
def diff_merge_multiset(spark, d):  # noqa: ANN001, ANN201
    return incremental.diff_merge(*_two(spark, d), "package")


@query(f"""WITH {_OLD_NEW}, a AS (SELECT package, list(content_hash ORDER BY content_hash) AS h FROM old GROUP BY 1), b AS (SELECT package, list(content_hash ORDER BY content_hash) AS h FROM new GROUP BY 1)
SELECT coalesce(a.package, b.package) AS package, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'gone' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.package = b.package WHERE a.h IS DISTINCT FROM b.h""")
def changed_groups(spark, d):  # noqa: ANN001, ANN201
    return incremental.changed_groups(*_two(spark, d), "package")


@query(f"""WITH a AS (SELECT name, row_number() OVER (ORDER BY name) AS id, version AS ev, TIMESTAMP '2026-01-01' AS updated_at FROM packages WHERE length(name) % 5 <> 0),
b AS (SELECT name, CASE WHEN length(name) % 3 = 0 THEN version || 'x' ELSE version END AS ev FROM packages WHERE length(name) % 7 <> 0)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.name IS NULL THEN 'delete' WHEN a.ev IS NOT DISTINCT FROM b.ev THEN 'keep' ELSE 'update' END AS action, CAST(a.id AS INTEGER) AS id,
CASE WHEN a.id IS NULL OR (b.name IS NOT NULL AND a.ev IS DISTINCT FROM b.ev) THEN TIMESTAMP '{NOW}' ELSE a.updated_at END AS updated_at FROM a FULL JOIN b ON a.name = b.name""")
def reconcile_records(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql.window import Window as W

    p = table(spark, d, "packages")
    old = p.where("length(name) % 5 != 0").select("name", F.row_number().over(W.partitionBy().orderBy("name")).alias("id"), F.col("version").alias("ev"), F.to_timestamp(F.lit("2026-01-01")).alias("updated_at"))
    new = p.where("length(name) % 7 != 0").select("name", F.when(F.length("name") % 3 == 0, F.concat("version", F.lit("x"))).otherwise(F.col("version")).alias("ev"))
    return incremental.reconcile(old, new, "name", "ev", NOW)


@query(f"WITH {_USABLE} SELECT id FROM chunks WHERE embedded AND id NOT IN (SELECT id FROM u WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0)")
def missing_vectors(spark, d):  # noqa: ANN001, ANN201
    """Chunks that count as embedded but whose vector is missing or not usable."""
    c = table(spark, d, "chunks")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return incremental.missing_vectors(c, c.where((F.size("embedding") == 96) & ~bad & F.exists("embedding", lambda x: x != 0)))


# decisions

@query("SELECT kind, origin, count(*) AS n FROM chunks GROUP BY ALL")
def census_by_kind(spark, d):  # noqa: ANN001, ANN201
    return decisions.census(table(spark, d, "chunks"), "kind", "origin")


@query(f"SELECT package, count(*) AS n FROM chunks WHERE captured_at <= TIMESTAMP '{NOW}' AND captured_at > TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND package IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def activity_top(spark, d):  # noqa: ANN001, ANN201
    return decisions.activity(table(spark, d, "chunks"), "captured_at", "package", NOW)


@query(f"""WITH a AS (SELECT package, epoch(TIMESTAMP '{NOW}' - captured_at) / 86400.0 AS age FROM chunks),
g AS (SELECT package, count(*) FILTER (age >= 0 AND age < 30) AS recent, count(*) FILTER (age >= 30 AND age < 60) AS before FROM a GROUP BY 1)
SELECT *, round(CASE WHEN before > 0 THEN CAST(recent AS DOUBLE) / before ELSE 1.0 END, 6) AS trend FROM g""")
def activity_trend(spark, d):  # noqa: ANN001, ANN201
    return decisions.trend(table(spark, d, "chunks"), "captured_at", NOW, "package")


@query("SELECT package, round(CAST(count(*) FILTER (coalesce(regexp_matches(docstring, '\\S'), false)) AS DOUBLE) / greatest(1, count(*)), 6) AS coverage, count(*) AS members FROM module_members GROUP BY package")
def overview_doc_coverage(spark, d):  # noqa: ANN001, ANN201
    has = F.when(F.col("docstring").rlike(r"\S"), 1.0).otherwise(0.0)
    return table(spark, d, "module_members").groupBy("package").agg(F.round(F.avg(has), 6).alias("coverage"), F.count("*").alias("members"))


@query("SELECT dep AS dependency, count(*) AS packages FROM (SELECT name, unnest(dependencies) AS dep FROM packages) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def overview_dependencies(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "packages").select(F.explode("dependencies").alias("dependency"))
    return p.groupBy("dependency").agg(F.count("*").alias("packages")).orderBy(F.desc("packages"), "dependency").limit(10)


# evaluation

_GOLD = "gold AS (SELECT name AS qid, id FROM packages JOIN chunks ON package = name)"


@query(f"""WITH {_BM25}, r AS ({_top(_hits('true'), 10)}), {_GOLD}, n AS (SELECT qid, count(DISTINCT id) AS n FROM gold GROUP BY 1),
h AS (SELECT qid, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM r JOIN gold USING (qid, id) GROUP BY 1)
SELECT qid, CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(least(1.0, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg,
CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS p1 FROM n LEFT JOIN h USING (qid)""")
def eval_recall_mrr_ndcg(spark, d):  # noqa: ANN001, ANN201
    gold = table(spark, d, "packages").select(F.col("name").alias("qid")).join(table(spark, d, "chunks").select(F.col("package").alias("qid"), "id"), "qid")
    return evaluation.ranking_metrics(_bm25(spark, d), gold)


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):  # noqa: ANN001, ANN201
    return evaluation.latency(table(spark, d, "events"), "value", "event_type")


@query("""WITH r AS (SELECT suite, item_id AS id, row_number() OVER (PARTITION BY suite ORDER BY md5(item_id || ':0'), item_id) AS n, round_even(count(*) OVER (PARTITION BY suite) * 0.3, 0) AS dev FROM eval_items)
SELECT suite, id, CASE WHEN n <= dev THEN 'dev' ELSE 'test' END AS part FROM r""")
def stratified_split(spark, d):  # noqa: ANN001, ANN201
    return evaluation.stratified_split(table(spark, d, "eval_items"), "suite", "item_id", 0.3)


@query("SELECT user_id, props AS item, arg_min(event_type, (ts, event_id)) AS tool FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def first_touch(spark, d):  # noqa: ANN001, ANN201
    return evaluation.first_touch(table(spark, d, "events").withColumnRenamed("props", "item"), "user_id", "item", "event_type", ["ts", "event_id"])


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value > 20) AS useful, round(CAST(count(*) FILTER (value > 20) AS DOUBLE) / count(*), 6) AS yield FROM events GROUP BY 1")
def tool_yield(spark, d):  # noqa: ANN001, ANN201
    return evaluation.tool_yield(table(spark, d, "events"), "event_type", F.col("value") > 20)


@query("WITH o AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) SELECT round((SELECT sum(v) FROM o), 2) AS once, (SELECT count(*) FROM o) AS messages, round((SELECT sum(value) FROM events), 2) AS reported")
def usage_dedup(spark, d):  # noqa: ANN001, ANN201
    return evaluation.usage(table(spark, d, "events").withColumn("m", F.struct("user_id", "event_type")), "m", "value")


@query("SELECT b.name AS tool, count(*) AS calls, count(DISTINCT lower(trim(session_id))) AS sessions FROM (SELECT session_id, unnest(message.content) AS b FROM claude_stream) WHERE b.type = 'tool_use' GROUP BY 1")
def calls_by_tool(spark, d):  # noqa: ANN001, ANN201
    b = table(spark, d, "claude_stream").select("session_id", F.explode("message.content").alias("b")).where("b.type = 'tool_use'")
    return b.groupBy(F.col("b.name").alias("tool")).agg(F.count("*").alias("calls"), F.count_distinct(F.lower(F.trim("session_id"))).alias("sessions"))


@query("SELECT user_id, count(*) AS calls, round(epoch(max(ts) - min(ts)), 3) AS seconds FROM events WHERE ts IS NOT NULL GROUP BY 1")
def wall_clock(spark, d):  # noqa: ANN001, ANN201
    return evaluation.spans(table(spark, d, "events"), "user_id", "ts")


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 15 THEN 'crash' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'empty' WHEN max(value) > 60 THEN 'budget' WHEN count(*) FILTER (event_type = 'signup') > 10 THEN 'resolved' ELSE 'unclassified' END AS label FROM events GROUP BY 1""")
def taxonomy_first_match(spark, d):  # noqa: ANN001, ANN201
    n = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(k)
    g = table(spark, d, "events").groupBy("user_id").agg(n("error"), n("purchase"), n("signup"), F.max("value").alias("top"))
    rules = [("crash", F.col("error") > 15), ("empty", F.col("purchase") == 0), ("budget", F.col("top") > 60), ("resolved", F.col("signup") > 10)]
    return g.select("user_id", evaluation.first_match(rules, "unclassified").alias("label"))


@query("""WITH g AS (SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) / count(*) AS a, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) / count(*) FILTER (event_type = 'purchase') END AS b FROM events GROUP BY 1)
SELECT user_id, round((0.7::DOUBLE * a + coalesce(0.3::DOUBLE * b, 0)) / (0.7::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END), 6) AS score FROM g""")
def shaped_score(spark, d):  # noqa: ANN001, ANN201
    n = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(k)
    g = table(spark, d, "events").groupBy("user_id").agg(n("view"), n("purchase"), n("signup"), F.count("*").alias("n"))
    return g.select("user_id", evaluation.shaped_score({"a": (F.col("view") / F.col("n"), 0.7), "b": (F.when(F.col("purchase") > 0, F.col("signup") / F.col("purchase")), 0.3)}).alias("score"))


@query("""WITH a AS (SELECT user_id, bool_or(value > 70) AS a, bool_or(event_type = 'error' AND value < 1) AS b FROM events GROUP BY 1) SELECT a, b, count(*) AS n FROM a GROUP BY 1, 2""")
def paired_outcomes(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    a = e.groupBy("user_id").agg(F.max(F.col("value") > 70).alias("ok"))
    b = e.groupBy("user_id").agg(F.max((F.col("event_type") == "error") & (F.col("value") < 1)).alias("ok"))
    return evaluation.paired(a, b, "user_id", "ok")


@query()
def bootstrap_mean(spark, d):  # noqa: ANN001, ANN201
    return evaluation.bootstrap_mean(table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v")), "v", "user_id", 200)


@query("""WITH v AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'click')
SELECT coalesce(v.user_id, c.user_id) AS user_id, CAST(coalesce(v.n, c.n) AS INTEGER) AS n, v.ts AS left_at, c.ts AS right_at FROM v FULL JOIN c ON v.user_id = c.user_id AND v.n = c.n""")
def stream_correlation(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    return evaluation.correlate(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "ts")


_SESS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM g GROUP BY user_id, s"""


@query(_SESS)
def event_sessions(spark, d):  # noqa: ANN001, ANN201
    return evaluation.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours")


# streaming


def _stream(spark, d):  # noqa: ANN001, ANN202
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark) -> str:  # noqa: ANN001
    from tessera.streaming import place

    return place.folder(spark)


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, max(ts) OVER () AS newest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM g GROUP BY user_id, s, newest HAVING max(ts) + INTERVAL 6 HOUR <= newest - INTERVAL 1 HOUR""")
def stream_session_debounce(spark, d):  # noqa: ANN001, ANN201
    at = _place(spark)
    return stream.drain(stream.debounce(_stream(spark, d), "user_id", "ts", "6 hours", "1 hour"), f"{at}/out", f"{at}/log")


@query("SELECT DISTINCT user_id, props FROM events")
def stream_dedup(spark, d):  # noqa: ANN001, ANN201
    at = _place(spark)
    s = stream.dedupe(_stream(spark, d).select("user_id", "props", "ts"), ["user_id", "props"], "ts", "60 days")
    return stream.drain(s.select("user_id", "props"), f"{at}/out", f"{at}/log")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark, d):  # noqa: ANN001, ANN201
    at = _place(spark)
    return stream.drain(stream.windowed(_stream(spark, d), "ts", "1 hour", "1 hour", "1 hour", "event_type"), f"{at}/out", f"{at}/log")


