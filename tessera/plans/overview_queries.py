"""Queries of lookups, cards, decision records, picks, trees and trajectory metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import capture, decisions, filters, graph, overview, retrieval
from tessera.plans.core_queries import _BM25, _E, _TG, _bm25, _edges, _hits, _nodes, _targets, _top
from tessera.session import blank_to_null, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_T = "trim({0}, E' \\t\\n\\r')"


def query(sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"""WITH t AS (SELECT DISTINCT {_T.format('to_name')} AS target FROM node_references WHERE to_name IS NOT NULL AND {_T.format('to_name')} <> ''), k AS (SELECT DISTINCT {_T.format('module')} AS m FROM tree_nodes WHERE module IS NOT NULL),
h AS (SELECT target, arg_max(m, length(m)) AS m FROM t JOIN k ON target = m OR starts_with(target, m || '.') GROUP BY 1)
SELECT t.target, m AS module, CASE WHEN length(t.target) > length(m) THEN substring(t.target, length(m) + 2) END AS symbol FROM t LEFT JOIN h ON h.target = t.target""")
def lookup_prefix(spark, d):  # noqa: ANN001, ANN201
    t = table(spark, d, "node_references").select(blank_to_null("to_name").alias("target")).where("target is not null").distinct()
    return overview.lookup(t, table(spark, d, "tree_nodes").select(blank_to_null("module").alias("node")))


@query(f"""WITH {_E}, m AS (SELECT DISTINCT {_T.format('node_id')} AS node FROM tree_nodes WHERE kind = 'module'), fi AS (SELECT dst AS node, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY 1)
SELECT m.node, coalesce(n, 0) AS in_degree FROM m LEFT JOIN fi ON fi.node = m.node ORDER BY 2 DESC, 1 LIMIT 20""")
def overview_modules(spark, d):  # noqa: ANN001, ANN201
    return overview.module_map(_nodes(spark, d), graph.fan_in(_edges(spark, d)))


@query(f"""WITH {_E}, o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), r AS (SELECT node FROM o WHERE node NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL) AND n > (SELECT quantile_cont(n, 0.5) FROM o)),
u AS (SELECT DISTINCT {_T.format('node_id')} AS node, '1 script' AS k FROM shared_symbols WHERE kind = 'function' UNION ALL SELECT DISTINCT {_T.format('node_id')}, '2 main' FROM tree_nodes WHERE node_id LIKE '%.__main__' UNION ALL SELECT node, '3 root' FROM r)
SELECT node, substring(min(k), 3) AS kind FROM u WHERE NOT regexp_matches(node, '(^|[._])tests?([._]|$)') GROUP BY 1""")
def overview_entry_points(spark, d):  # noqa: ANN001, ANN201
    s = table(spark, d, "shared_symbols").where("kind = 'function'").select(F.col("node_id").alias("node"))
    return overview.entry_points(s, _nodes(spark, d), graph.roots_over_median(_edges(spark, d)))


@query("""SELECT id, CASE WHEN package = 'larchmill' THEN 'none' WHEN regexp_matches(package, '^larch.*$') THEN 'doc_pages' WHEN regexp_matches(package, '^.*port$') THEN 'none' ELSE 'full' END AS tier FROM chunks WHERE package IS NOT NULL""")
def embed_policy(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "chunks").where("package is not null").select("id", overview.embed_tier(F.col("package"), {"larchmill": "none", "larch*": "doc_pages", "*port": "none"}).alias("tier"))


@query(f"""WITH {_E}, g AS (SELECT DISTINCT regexp_replace(src, '^decision:', '') AS decision, dst AS node FROM e WHERE kind = 'governs' AND dst IS NOT NULL),
t AS (SELECT DISTINCT {_T.format('node_id')} AS target FROM tree_nodes WHERE kind = 'method'), n AS (SELECT node, count(DISTINCT decision) AS k FROM g GROUP BY 1)
SELECT target, arg_max(node, length(node)) AS found, arg_max(k, length(node)) AS decisions FROM t JOIN n ON target = node OR starts_with(target, node || '.') GROUP BY 1""")
def decision_cards(spark, d):  # noqa: ANN001, ANN201
    t = _nodes(spark, d).where("kind = 'method'").select(F.col("node").alias("target")).distinct()
    return overview.decision_cards(graph.governed(_edges(spark, d)), t)


@query(f"""WITH {_BM25}, r AS ({_top(_hits('true'), 10)}), p AS (SELECT qid, id, (id * 31) % 17 AS pos FROM r WHERE id % 3 = 0),
j AS (SELECT r.qid, r.id, r.rank, pos FROM r LEFT JOIN p ON p.qid = r.qid AND p.id = r.id), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos NULLS LAST, rank, id) AS k, count(*) OVER (PARTITION BY qid) AS c FROM j)
SELECT qid, id, CAST(k AS INTEGER) AS new_rank, round(1 - (k - 1)::DOUBLE / c, 9) AS score FROM n""")
def picked_rerank(spark, d):  # noqa: ANN001, ANN201
    r = _bm25(spark, d)
    return overview.apply_picks(r, r.where("id % 3 = 0").select("qid", "id", F.expr("(id * 31) % 17").alias("pos")))


_TREE = f"t AS (SELECT DISTINCT {_T.format('node_id')} AS node, CASE WHEN kind <> 'module' THEN {_T.format('parent_id')} END AS parent FROM tree_nodes)"


def _tree(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "tree_nodes").select(blank_to_null("node_id").alias("node"), F.when(F.col("kind") != "module", blank_to_null("parent_id")).alias("parent")).where("node is not null").distinct()


@query(f"""WITH RECURSIVE {_E}, {_TREE}, k AS (SELECT DISTINCT dst AS node FROM e WHERE kind = 'inherits' AND dst IS NOT NULL UNION SELECT t.parent FROM k JOIN t ON t.node = k.node WHERE t.parent IS NOT NULL)
SELECT node, parent FROM t WHERE node IN (SELECT node FROM k)""")
def prune_tree(spark, d):  # noqa: ANN001, ANN201
    keep = _edges(spark, d).where("kind = 'inherits' and dst is not null").select(F.col("dst").alias("node"))
    return overview.prune_tree(_tree(spark, d), keep)


@query(f"""WITH RECURSIVE {_TREE}, w AS (SELECT node, 0 AS level FROM t WHERE parent IS NULL UNION SELECT t.node, w.level + 1 FROM w JOIN t ON t.parent = w.node), o AS (SELECT node, min(level) AS level FROM w GROUP BY 1)
SELECT node, CAST(level AS INTEGER) AS level, CAST(row_number() OVER (ORDER BY level, node) AS INTEGER) AS "at" FROM o QUALIFY row_number() OVER (ORDER BY level, node) <= 300""")
def node_budget(spark, d):  # noqa: ANN001, ANN201
    return overview.node_budget(_tree(spark, d), 300)


@query("""WITH e AS (SELECT user_id AS "by", props AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), g AS (SELECT DISTINCT user_id AS "by", props AS file FROM events WHERE event_type = 'purchase'),
n AS (SELECT "by", count(*) AS n FROM g GROUP BY 1), r AS (SELECT e."by", count(DISTINCT CASE WHEN g.file IS NOT NULL THEN e.file END) AS hit, count(*) AS reads, count(*) FILTER (g.file IS NULL) AS waste, min(CASE WHEN g.file IS NOT NULL THEN seq END) AS first_hit FROM e LEFT JOIN g ON g."by" = e."by" AND g.file = e.file WHERE e.file IS NOT NULL GROUP BY 1)
SELECT n."by", round(coalesce(hit, 0)::DOUBLE / n.n, 6) AS recall, round(coalesce(waste::DOUBLE / reads, 0), 6) AS wasted, CAST(first_hit AS INTEGER) AS first_hit FROM n LEFT JOIN r ON r."by" = n."by" """)
def trajectory_files(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events").select(F.col("user_id").alias("by"), F.col("props").alias("file"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), "event_type")
    return overview.file_metrics(e, e.where("event_type = 'purchase'"))


@query("""WITH a AS (SELECT DISTINCT source_path AS by, unnest(range(start_line, end_line + 1)) AS n FROM chunks WHERE kind = 'method' AND end_line >= start_line AND source_path IS NOT NULL),
b AS (SELECT DISTINCT source_path AS by, unnest(range(start_line, end_line + 1)) AS n FROM tree_nodes WHERE kind = 'method' AND end_line >= start_line AND source_path IS NOT NULL)
SELECT b.by, round(count(a.n)::DOUBLE / count(*), 6) AS overlap FROM b LEFT JOIN a ON a.by = b.by AND a.n = b.n GROUP BY 1""")
def hunk_overlap(spark, d):  # noqa: ANN001, ANN201
    s = lambda t: table(spark, d, t).where("kind = 'method' and source_path is not null").select(F.col("source_path").alias("by"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    return overview.span_overlap(s("chunks"), s("tree_nodes"))


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT name AS package, project FROM packages WHERE project IS NOT NULL),
l AS (SELECT p.project || ':' || dst AS at, p.project || ':' || src AS too FROM e JOIN p ON p.package = e.package WHERE dst IS NOT NULL AND kind <> 'similar'
  UNION SELECT {_T.format('to_project')} || ':' || {_T.format('to_node_id')}, {_T.format('from_project')} || ':' || {_T.format('from_node_id')} FROM cross_references WHERE lower(trim(kind)) <> 'similar'),
tg AS (SELECT DISTINCT {_T.format('to_project')} || ':' || {_T.format('to_node_id')} AS target FROM cross_references WHERE lower(trim(kind)) = 'inherits'),
r AS (SELECT target, target AS node, 0 AS hop FROM tg UNION SELECT r.target, l.too, r.hop + 1 FROM r JOIN l ON l.at = r.node WHERE r.hop < 2)
SELECT target, node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1, 2 HAVING min(hop) > 0""")
def federated_impact(spark, d):  # noqa: ANN001, ANN201
    p = table(spark, d, "packages").where("project is not null").select(F.col("name").alias("package"), "project")
    x = table(spark, d, "cross_references").select(blank_to_null("from_project").alias("from_project"), blank_to_null("to_project").alias("to_project"), blank_to_null("from_node_id").alias("src"), blank_to_null("to_node_id").alias("dst"), F.lower(blank_to_null("kind")).alias("kind"))
    e = overview.federated_edges(_edges(spark, d).join(p, "package"), x)
    t = x.where("kind = 'inherits'").select(F.concat_ws(":", "to_project", "dst").alias("target")).distinct()
    return graph.closure(e, t, 2)


@query(f"""WITH n AS (SELECT DISTINCT {_T.format('to_name')} AS name FROM cross_references), h AS (SELECT DISTINCT {_T.format('node_id')} AS name, project, 1 AS precedence FROM tree_nodes UNION SELECT DISTINCT {_T.format('node_id')}, project, 2 FROM shared_symbols)
SELECT n.name, project FROM n JOIN h ON h.name = n.name QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY precedence, project) = 1""")
def precedence_link(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "cross_references").select(blank_to_null("to_name").alias("name"))
    h = _nodes(spark, d).select("node", "project", F.lit(1).alias("precedence")).unionByName(table(spark, d, "shared_symbols").select(blank_to_null("node_id").alias("node"), "project", F.lit(2).alias("precedence"))).distinct()
    return overview.precedence_join(n, h)


@query("SELECT count(*) AS n FROM chunks WHERE package = '__project__' AND kind IN ('function', 'class')")
def count_by_filter(spark, d):  # noqa: ANN001, ANN201
    tree = filters.parse({"package": "__project__", "kind": {"in": ["function", "class"]}})
    return table(spark, d, "chunks").where(filters.column(tree)).agg(F.count("*").alias("n"))


@query(f"""WITH {_E}, {_TG} SELECT target, count(DISTINCT src) AS callers FROM tg LEFT JOIN e ON dst = target AND kind <> 'similar' GROUP BY 1""")
def caller_counts(spark, d):  # noqa: ANN001, ANN201
    e = _edges(spark, d).where("kind != 'similar'").select(F.col("dst").alias("target"), "src")
    return _targets(spark, d).join(e, "target", "left").groupBy("target").agg(F.count_distinct("src").alias("callers"))


@query()
def fuzzy_gold(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks")
    r = retrieval.hydrate(_bm25(spark, d), c, "id", ["text"])
    gold = r.where("rank = 1").select("qid", F.substring("text", 20, 100).alias("text"))
    return overview.fuzzy_gold(r, gold)


@query("""WITH m AS (SELECT module, name, coalesce(signature, name) || E'\\n    ' || trim(split_part(trim(docstring, ' '), E'\\n', 1), ' ') AS line FROM module_members WHERE NOT starts_with(name, '_') AND docstring IS NOT NULL AND trim(docstring, ' ') <> ''),
g AS (SELECT module, string_agg(line, E'\\n' ORDER BY name, line) AS body FROM m GROUP BY 1), t AS (SELECT module, max(text) AS text FROM tree_nodes WHERE kind = 'module' GROUP BY 1)
SELECT g.module, substring(concat_ws(E'\\n\\n', nullif(trim(text, ' '), ''), body), 1, 8000) AS page FROM g LEFT JOIN t ON t.module = g.module""")
def dependency_doc_pages(spark, d):  # noqa: ANN001, ANN201
    return capture.doc_pages(table(spark, d, "module_members").select("module", "name", "signature", "docstring"), table(spark, d, "tree_nodes").where("kind = 'module'").select("module", "text"))


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT {_T.format('node_id')} AS node, {_T.format('parent_id')} AS parent, kind, text FROM tree_nodes WHERE node_id IS NOT NULL),
up AS (SELECT node, min(parent) AS above, max(CASE WHEN kind = 'module' THEN node END) AS mod FROM n GROUP BY 1),
w AS (SELECT node, CASE WHEN mod IS NULL THEN above END AS spot, mod AS module FROM up UNION SELECT w.node, CASE WHEN up.mod IS NULL THEN up.above END, up.mod FROM w LEFT JOIN up ON up.node = w.spot WHERE w.spot IS NOT NULL)
SELECT l.node, coalesce(w.module, l.node) AS module, kind, text FROM n l JOIN (SELECT node, module FROM w WHERE spot IS NULL) w ON w.node = l.node WHERE kind NOT IN ('package', 'subpackage') AND text IS NOT NULL AND trim(text, ' ') <> ''""")
def flatten_tree(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "tree_nodes").select(blank_to_null("node_id").alias("node"), blank_to_null("parent_id").alias("parent"), "kind", "text").where("node is not null").distinct()
    return capture.flatten_tree(n)


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM events")
def trace_sequence(spark, d):  # noqa: ANN001, ANN201
    return capture.sequenced(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq")


@query()
def capture_references(spark, d):  # noqa: ANN001, ANN201
    return capture.references(table(spark, d, "chunks").where(F.lower(blank_to_null("kind")).isin("function", "method", "class")))


@query()
def resolve_rules(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks").where(F.lower(blank_to_null("kind")).isin("function", "method", "class"))
    r = capture.references(c).join(c.select("id", "package"), "id")
    return capture.resolve(r, _nodes(spark, d))


@query(f"""WITH {_E}, r AS (SELECT package, count(*) AS refs, count(dst) AS resolved FROM e WHERE kind = 'calls' GROUP BY 1)
SELECT package, refs, resolved, round(resolved::DOUBLE / refs, 6) AS rate FROM r""")
def resolution_rate(spark, d):  # noqa: ANN001, ANN201
    g = _edges(spark, d).where("kind = 'calls'").groupBy("package").agg(F.count("*").alias("refs"), F.count("dst").alias("resolved"))
    return g.withColumn("rate", F.round(F.col("resolved") / F.col("refs"), 6))
