"""Queries over several projects, routed batches and graded runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, filters, workspace
from tessera.plans.core_queries import _E, _edges
from tessera.session import blank_to_null, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_T = "nullif(trim({0}, E' \\t\\n\\r'), '')"


@query(f"WITH {_E} SELECT package, src, name, kind, dst FROM e WHERE kind = 'calls' AND name IN (SELECT split_part({_T.format('node_id')}, '.', -1) FROM shared_symbols)")
def find_by_name(spark, d):  # noqa: ANN001, ANN201
    names = table(spark, d, "shared_symbols").select(F.substring_index(blank_to_null("node_id"), ".", -1).alias("to_name"))
    return workspace.find_by_name(_edges(spark, d), names, "calls").select("package", "src", "name", "kind", "dst")


@query(f"WITH {_E} SELECT package, src, name, kind FROM e WHERE dst IS NULL")
def unresolved_edges(spark, d):  # noqa: ANN001, ANN201
    return workspace.resolved(_edges(spark, d), False).select("package", "src", "name", "kind")


@query(f"WITH {_E} SELECT package, src, name, kind, dst FROM e WHERE dst IS NOT NULL")
def resolved_edges(spark, d):  # noqa: ANN001, ANN201
    return workspace.resolved(_edges(spark, d)).select("package", "src", "name", "kind", "dst")


_STORE = f"""store AS (SELECT DISTINCT {_T.format('from_project')} AS from_project, {_T.format('from_package')} AS from_package, {_T.format('from_node_id')} AS from_node_id,
{_T.format('to_project')} AS to_project, {_T.format('to_node_id')} AS to_node_id, {_T.format('to_name')} AS to_name, lower({_T.format('kind')}) AS kind FROM cross_references)"""


def _store(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cross_references")
    cols = ["from_project", "from_package", "from_node_id", "to_project", "to_node_id", "to_name"]
    return c.select(*(blank_to_null(x).alias(x) for x in cols), F.lower(blank_to_null("kind")).alias("kind")).distinct()


@query(f"""WITH {_STORE} SELECT *, CAST(row_number() OVER (PARTITION BY to_project, to_node_id ORDER BY from_project NULLS FIRST, from_node_id NULLS FIRST, kind NULLS FIRST, to_name NULLS FIRST, from_package NULLS FIRST) AS INTEGER) AS "at"
FROM store WHERE kind IN ('calls', 'imports') AND to_project IS NOT NULL AND to_node_id IS NOT NULL QUALIFY "at" <= 3""")
def cross_edges_into(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    return workspace.edges_into(s, s, ("calls", "imports"), 3)


@query(f"""WITH {_STORE} SELECT *, CAST(row_number() OVER (PARTITION BY from_project, from_node_id ORDER BY to_project NULLS FIRST, to_node_id NULLS FIRST, kind NULLS FIRST, to_name NULLS FIRST, from_package NULLS FIRST) AS INTEGER) AS "at"
FROM store WHERE from_project IS NOT NULL AND from_node_id IS NOT NULL QUALIFY "at" <= 200""")
def cross_edges_from(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    return workspace.edges_from(s, s)


@query(f"""WITH {_STORE}, p AS (SELECT min(from_project) AS project FROM store)
SELECT * FROM store WHERE coalesce(from_project NOT IN (SELECT project FROM p), true) AND coalesce(to_project NOT IN (SELECT project FROM p), true)
UNION SELECT from_project, from_package, from_node_id, to_project, to_node_id, to_name, 'similar' FROM store WHERE from_project IN (SELECT project FROM p)""")
def cross_edges_replaced(spark, d):  # noqa: ANN001, ANN201
    s = _store(spark, d)
    p = s.agg(F.min("from_project").alias("project"))
    return workspace.replace_touching(s, s.join(F.broadcast(p.withColumnRenamed("project", "from_project")), "from_project", "left_semi").withColumn("kind", F.lit("similar")), p)


_B = "SELECT package AS project, max(indexed_at) AS indexed_at, max(content_hash) AS git_head FROM chunks GROUP BY 1"


@query(f"""WITH b AS ({_B}), s AS (SELECT package AS project, max(indexed_at) AS indexed_at, max(content_hash) AS git_head FROM chunks WHERE origin <> 'dependency_def' GROUP BY 1)
SELECT b.project FROM b LEFT JOIN s USING (project) WHERE project IS NOT NULL AND (s.project IS NULL OR b.indexed_at IS DISTINCT FROM s.indexed_at OR coalesce(b.git_head <> '' AND s.git_head <> '' AND b.git_head <> s.git_head, false))""")
def stale_projects(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "chunks").where("package is not null")
    bundle = lambda x: x.groupBy(F.col("package").alias("project")).agg(F.max("indexed_at").alias("indexed_at"), F.max("content_hash").alias("git_head"))
    return workspace.stale(bundle(c), bundle(c.where("origin != 'dependency_def'")))


_SYM = f"sym AS (SELECT DISTINCT project, {_T.format('node_id')} AS node, package FROM tree_nodes WHERE {_T.format('node_id')} IS NOT NULL)"


@query(f"""WITH {_E}, {_SYM}, pk AS (SELECT package, min(project) AS project FROM sym GROUP BY 1), x AS (SELECT e.ref_id, pk.project, src, name, CASE WHEN ref_id % 2 = 0 THEN dst END AS dst, kind FROM e JOIN pk USING (package)),
i AS (SELECT project AS to_project, src AS module, name, dst FROM x WHERE kind = 'imports'),
g AS (SELECT to_project, module, dst AS node FROM i WHERE dst IS NOT NULL UNION SELECT to_project, module, regexp_replace(module, '\\.[^.]*$', '') || '.' || name FROM i WHERE dst IS NULL AND name IS NOT NULL AND contains(module, '.')),
k AS (SELECT g.*, split_part(node, '.', -1) AS leaf FROM g WHERE (to_project, node) IN (SELECT (project, node) FROM sym) AND (to_project, module) IN (SELECT (project, node) FROM sym)),
a AS (SELECT ref_id, project, regexp_replace(name, '\\.[^.]*$', '') AS module, split_part(name, '.', -1) AS leaf FROM x WHERE dst IS NULL AND contains(name, '.')),
h AS (SELECT DISTINCT ref_id, project, to_project, node FROM a JOIN k USING (module, leaf) WHERE project <> to_project)
SELECT ref_id, project, min(to_project) AS to_project, min(node) AS node FROM h GROUP BY 1, 2 HAVING count(*) = 1""")
def reexport_links(spark, d):  # noqa: ANN001, ANN201
    s = table(spark, d, "tree_nodes").select("project", blank_to_null("node_id").alias("node"), "package").where("node is not null").distinct()
    owner = s.groupBy("package").agg(F.min("project").alias("project"))
    # every second target is forgotten, as if it had not been resolved
    e = _edges(spark, d).join(owner, "package").withColumn("dst", F.when(F.col("ref_id") % 2 == 0, F.col("dst")))
    return workspace.reexports(e.select("ref_id", "project", "src", "name", "dst", "kind"), s)


@query(f"""WITH {_E}, {_SYM}, {_STORE}, pk AS (SELECT package, min(project) AS project FROM sym GROUP BY 1),
u AS (SELECT concat_ws('::', project, src) AS src, concat_ws('::', project, dst) AS dst FROM e JOIN pk USING (package) WHERE dst IS NOT NULL UNION ALL SELECT concat_ws('::', from_project, from_node_id), concat_ws('::', to_project, to_node_id) FROM store),
n AS (SELECT src AS node FROM u UNION SELECT dst FROM u) SELECT node, (SELECT count(*) FROM u WHERE u.dst = n.node) AS in_degree FROM n""")
def workspace_in_degree(spark, d):  # noqa: ANN001, ANN201
    s = table(spark, d, "tree_nodes").select("project", "package").groupBy("package").agg(F.min("project").alias("project"))
    return workspace.workspace_scores(_edges(spark, d).join(s, "package"), _store(spark, d), None)


_SV = "s AS (SELECT vec_id AS id, 'p' || CAST(vec_id % 3 AS VARCHAR) AS project, 'n' || CAST(vec_id // 9 AS VARCHAR) AS node, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(f"""WITH {_SV}, n AS (SELECT a.id AS qid, a.project AS from_project, a.node AS from_node_id, b.project AS to_project, b.node AS to_node_id, b.id, round(list_dot_product(a.e, b.e), 6) AS score FROM s a JOIN s b ON a.project <> b.project),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid, to_project ORDER BY score DESC, id) <= 5), m AS (SELECT from_project, from_node_id, to_project, to_node_id, max(score) AS score FROM k WHERE score >= 0.3 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY from_project, from_node_id, to_project ORDER BY score DESC, to_node_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 5""")
def similar_projects(spark, d):  # noqa: ANN001, ANN201
    v = table(spark, d, "embeddings")
    s = v.select(F.col("vec_id").alias("id"), F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string")).alias("project"), F.concat(F.lit("n"), F.floor(F.col("vec_id") / 9).cast("string")).alias("node"), "embedding")
    return workspace.similar_projects(s, least=0.3)


@query("SELECT id, title, kind FROM chunks WHERE coalesce(kind = 'method' AND contains(lower(title), 'a'), false) OR coalesce(title = '_composite_', false)")
def post_filter(spark, d):  # noqa: ANN001, ANN201
    tree = filters.parse({"kind": "method", "title": {"like": "A"}})
    return workspace.post_filter(table(spark, d, "chunks"), filters.column(tree)).select("id", "title", "kind")


@query("""WITH q AS (SELECT name, len(list_filter(regexp_split_to_array(trim(coalesce(summary, ''), ' '), '\\s+'), lambda t: t <> '')) AS n, CASE WHEN origin = 'dependency' THEN 'dependencies_only' WHEN origin = 'project' THEN 'project_only' END AS scope FROM packages)
SELECT name, n >= 4 AS query_has_multiple_terms, coalesce(scope, '') <> 'project_only' AS scope_includes_dependencies, coalesce(scope, '') <> 'dependencies_only' AS scope_includes_project, coalesce(scope, '') = 'project_only' AS scope_is_project_only,
coalesce(scope, '') = 'dependencies_only' AS scope_is_dependencies_only, n >= 8 AS is_long_query FROM q""")
def route_predicates(spark, d):  # noqa: ANN001, ANN201
    scope = F.when(F.col("origin") == "dependency", "dependencies_only").when(F.col("origin") == "project", "project_only")
    q = table(spark, d, "packages").withColumn("scope", scope)
    cols = filters.route_columns("summary", 8, "scope")
    return q.select("name", *(cols[c].alias(c) for c in ("query_has_multiple_terms", "scope_includes_dependencies", "scope_includes_project", "scope_is_project_only", "scope_is_dependencies_only", "is_long_query")))


@query("""WITH m AS (SELECT package AS qid, row_number() OVER (PARTITION BY package ORDER BY id) AS rank, '**[' || coalesce(package, '') || '] ' || coalesce(module, '') || '.' || coalesce(name, '') || coalesce(signature, '') || '** (' || coalesce(kind, '') || E')\\n' || coalesce(docstring, '') || E'\\n' AS piece FROM module_members WHERE package IS NOT NULL),
s AS (SELECT *, sum(length(piece) + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS size FROM m)
SELECT qid, coalesce(string_agg(piece, E'\\n' ORDER BY rank) FILTER (size <= 2000), '') AS text, CAST(count(*) FILTER (size <= 2000) AS INTEGER) AS pieces, count(*) FILTER (size > 2000) AS left_out FROM s GROUP BY qid""")
def member_budget(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql.window import Window as W

    m = table(spark, d, "module_members").where("package is not null").withColumn("qid", F.col("package"))
    return workspace.members_within(m.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("id"))), 500)


_GOLD = """gold AS (SELECT package AS qid, CASE WHEN length(package) % 3 = 0 THEN min(text) END AS body, CASE WHEN length(package) % 3 = 1 THEN [max(doc_id)] END AS keys, CASE WHEN length(package) % 3 = 2 THEN [array_to_string(string_split(min(source_path), '/')[-2:], '/')] END AS files FROM documents WHERE package IS NOT NULL GROUP BY 1),
items AS (SELECT package AS qid, doc_id AS key, text AS body, source_path, CAST(row_number() OVER (PARTITION BY package ORDER BY doc_id) AS INTEGER) AS rank FROM documents WHERE package IS NOT NULL)"""


@query(f"""WITH {_GOLD}, r AS (SELECT i.qid, i.rank, coalesce(CASE WHEN g.body IS NOT NULL THEN i.body = g.body WHEN g.keys IS NOT NULL THEN list_contains(g.keys, i.key) WHEN len(g.files) > 0 THEN len(list_filter(g.files, lambda f: i.source_path = f OR ends_with(i.source_path, '/' || f))) > 0 END, false) AS ok FROM items i JOIN gold g USING (qid))
SELECT qid, min(rank) AS rank FROM r WHERE ok GROUP BY 1""")
def first_relevant(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql.window import Window as W

    docs = table(spark, d, "documents").where("package is not null").select(F.col("package").alias("qid"), F.col("doc_id").alias("key"), F.col("text").alias("body"), "source_path")
    items = docs.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("key")))
    third = F.length("qid") % 3
    tail = F.array_join(F.slice(F.split(F.min("source_path"), "/"), -2, 2), "/")
    g = docs.groupBy("qid").agg(F.min("body").alias("b"), F.max("key").alias("k"), tail.alias("f"))
    gold = g.select("qid", F.when(third == 0, F.col("b")).alias("body"), F.when(third == 1, F.array("k")).alias("keys"), F.when(third == 2, F.array("f")).alias("files"))
    return evaluation.first_relevant(items, gold)


@query("""WITH s AS (SELECT kind, count(*) AS n FROM chunks GROUP BY 1), t AS (SELECT sum(n) AS total FROM s), q AS (SELECT kind, n, (100 * n) // total AS f, (100 * n) % total AS rest FROM s, t),
k AS (SELECT kind, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, kind NULLS FIRST) <= 100 - (SELECT sum(f) FROM q) THEN 1 ELSE 0 END AS take FROM q),
r AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY md5(CAST(id AS VARCHAR) || ':0'), id) AS n FROM chunks) SELECT r.kind, id FROM r JOIN k ON r.kind = k.kind WHERE n <= take""")
def largest_remainder(spark, d):  # noqa: ANN001, ANN201
    return evaluation.largest_remainder(table(spark, d, "chunks"), "kind", "id", 100)


_RUNS = """runs AS (SELECT event_id AS id, event_type AS stratum, user_id % 11 = 0 AS infra_error, value > 50 AS solved, value % 20 > 12 AS other, value / 100.0 AS score, value / 10.0 AS cost, user_id % 7 > 0 AS has_tool, user_id % 5 = 0 AS spoke, false AS error_result, user_id % 13 = 1 AS apply_failed,
user_id % 3 > 0 AS ran_tests, user_id % 4 > 0 AS gold_surfaced, user_id % 9 > 1 AS touches_gold, event_id % 6 AS patch_bytes, (event_id % 5) / 4.0 AS f2p_fraction, event_id % 3 AS p2p_regressions, user_id % 50 AS turns, CASE WHEN event_id % 2 = 0 THEN 40 END AS turn_cap FROM events)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as graded runs: the tables hold none."""
    e, v, u = table(spark, d, "events"), F.col("value"), F.col("user_id")
    i = F.col("event_id")
    return e.select(
        i.alias("id"), F.col("event_type").alias("stratum"), (u % 11 == 0).alias("infra_error"), (v > 50).alias("solved"), (v % 20 > 12).alias("other"), (v / 100).alias("score"), (v / 10).alias("cost"), (u % 7 > 0).alias("has_tool"), (u % 5 == 0).alias("spoke"),
        F.lit(False).alias("error_result"), (u % 13 == 1).alias("apply_failed"), (u % 3 > 0).alias("ran_tests"), (u % 4 > 0).alias("gold_surfaced"), (u % 9 > 1).alias("touches_gold"), (i % 6).alias("patch_bytes"), ((i % 5) / 4).alias("f2p_fraction"),
        (i % 3).alias("p2p_regressions"), (u % 50).alias("turns"), F.when(i % 2 == 0, 40).alias("turn_cap"), F.lit(0).alias("tokens"), F.lit(None).cast("int").alias("token_cap"), F.lit(0).alias("wall"), F.lit(None).cast("int").alias("wall_cap"),
    )


@query(f"WITH {_RUNS} SELECT stratum, round(coalesce(avg(score) FILTER (NOT infra_error), 0.0), 6) AS score, round(sum(cost), 6) AS cost, count(*) FILTER (NOT infra_error) AS graded, count(*) FILTER (infra_error) AS infra_excluded, round(sum(cost), 6) <= 1e5 AS within_budget FROM runs GROUP BY 1")
def run_aggregate(spark, d):  # noqa: ANN001, ANN201
    return evaluation.run_aggregate(_runs(spark, d), "stratum", max_cost=1e5)


@query(f"""WITH {_RUNS} SELECT id, CASE WHEN infra_error THEN 'infra_error' WHEN NOT has_tool AND NOT spoke AND patch_bytes = 0 THEN 'empty_trajectory' WHEN NOT has_tool AND spoke THEN 'crash_before_first_tool' WHEN apply_failed THEN 'patch_apply_failed'
WHEN patch_bytes = 0 AND coalesce(turns >= turn_cap, false) THEN 'budget_exhausted' WHEN solved THEN 'resolved' WHEN NOT ran_tests THEN 'never_ran_tests' WHEN NOT gold_surfaced THEN 'localization_miss' WHEN NOT touches_gold THEN 'found_but_misdiagnosed'
WHEN f2p_fraction < 1.0 THEN 'right_idea_broken_edit' WHEN p2p_regressions > 0 THEN 'regression_introduced' ELSE 'unclassified_failure' END AS label,
round(0.2::DOUBLE * (user_id_share) + 0.1::DOUBLE * (1.0 - waste) + 0.2::DOUBLE * solved::INT + 0.3::DOUBLE * f2p_fraction + 0.1::DOUBLE * (p2p_regressions = 0)::INT + 0.1::DOUBLE * CASE WHEN turn_cap IS NULL THEN 1.0 ELSE 1.0 - least(1.0, turns / turn_cap) END, 6) AS score
FROM (SELECT *, (id % 4) / 4.0 AS user_id_share, (id % 8) / 8.0 AS waste FROM runs)""")
def run_labels(spark, d):  # noqa: ANN001, ANN201
    r = _runs(spark, d).withColumn("is_resolved", F.col("solved")).withColumn("patch_applied", F.col("solved")).withColumn("gold_recall", (F.col("id") % 4) / 4).withColumn("wasted_ratio", (F.col("id") % 8) / 8)
    return r.select("id", evaluation.run_label().alias("label"), evaluation.run_score().alias("score"))


@query(f"WITH {_RUNS} SELECT coalesce(CASE WHEN id % 10 > 0 THEN stratum END, 'unknown') AS stratum, count(*) FILTER (solved AND NOT other) AS only_a, count(*) FILTER (NOT solved AND other) AS only_b, count(*) AS n, round((count(*) FILTER (solved AND NOT other) - count(*) FILTER (NOT solved AND other))::DOUBLE / count(*), 6) AS delta FROM runs GROUP BY 1")
def strata_contrasts(spark, d):  # noqa: ANN001, ANN201
    r = _runs(spark, d)
    return evaluation.strata_contrasts(r.select("id", "solved"), r.select("id", F.col("other").alias("solved")), r.select("id", F.when(F.col("id") % 10 > 0, F.col("stratum")).alias("stratum")))
