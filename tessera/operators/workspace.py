"""Several projects at once: the store of edges between them, links through re-exports, stale projects, union scores, similar symbols.

Cross edges are (from_project, from_package, from_node_id, to_project, to_node_id, to_name, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import graph, retrieval

#: Order of edges in a listing, and edges of a listing.
ORDER, LIMIT = ["from_project", "from_node_id", "to_project", "to_node_id", "kind"], 200
#: Projects of a workspace at most; each query vector is searched once for each.
MAX_PROJECTS = 1000


def find_by_name(edges: DataFrame, names: DataFrame, kind: str | None = None) -> DataFrame:
    """The edges that were written with one of the names (to_name), resolved or not, of one kind or any."""
    hit = edges.join(names.select(F.col("to_name").alias("name")).distinct(), "name", "left_semi")
    return hit if kind is None else hit.where(F.col("kind") == kind)


def resolved(edges: DataFrame, yes: bool = True) -> DataFrame:
    """The edges with a target, or those without."""
    return edges.where(F.col("dst").isNotNull() if yes else F.col("dst").isNull())


def _page(edges: DataFrame, by: list[str], kinds: tuple[str, ...] | None, limit: int) -> DataFrame:
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    w = W.partitionBy(*by).orderBy(*ORDER, "to_name")
    return e.withColumn("at", F.row_number().over(w)).where(F.col("at") <= limit)


def edges_into(store: DataFrame, targets: DataFrame, kinds: tuple[str, ...] | None = None, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` cross edges into each target (to_project, to_node_id)."""
    key = ["to_project", "to_node_id"]
    return _page(store.join(targets.select(*key).distinct(), key, "left_semi"), key, kinds, limit)


def edges_from(store: DataFrame, sources: DataFrame, kinds: tuple[str, ...] | None = None, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` cross edges out of each source (from_project, from_node_id)."""
    key = ["from_project", "from_node_id"]
    return _page(store.join(sources.select(*key).distinct(), key, "left_semi"), key, kinds, limit)


def replace_touching(store: DataFrame, new: DataFrame, projects: DataFrame) -> DataFrame:
    """The store without the edges at either end of one of the projects (project), and with the new ones."""
    p = projects.select("project").distinct()
    kept = store.join(p.withColumnRenamed("project", "from_project"), "from_project", "left_anti").join(p.withColumnRenamed("project", "to_project"), "to_project", "left_anti")
    return kept.select(*store.columns).unionByName(new.select(*store.columns)).distinct()


def stale(bundles: DataFrame, stamps: DataFrame) -> DataFrame:
    """(project): bundles (project, indexed_at, git_head) without stamp, indexed at another time, or at another head where both have one."""
    s = stamps.select("project", F.col("indexed_at").alias("__at"), F.col("git_head").alias("__head"), F.lit(True).alias("__is"))
    j = bundles.join(s, "project", "left")
    head = F.coalesce((F.col("git_head") != "") & (F.col("__head") != "") & (F.col("git_head") != F.col("__head")), F.lit(False))
    return j.where(F.col("__is").isNull() | ~F.col("indexed_at").eqNullSafe(F.col("__at")) | head).select("project").distinct()


def reexports(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, project, to_project, node): unresolved dotted names that another project re-exports, one hop away.

    edges (ref_id, project, src, name, dst, kind), symbols (project, node). The name's module must be a symbol of
    the other project, and an import there must give its last segment: a resolved one its target; an unresolved one
    the target below the module's parent, if the project holds it. A name with several targets links nowhere.
    """
    own = symbols.select("project", "node").distinct()
    leaf = lambda c: F.substring_index(c, ".", -1)
    parent = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    i = edges.where("kind = 'imports'").select(F.col("project").alias("to_project"), F.col("src").alias("module"), "name", "dst")
    direct = i.where("dst is not null").select("to_project", "module", F.col("dst").alias("node"))
    relative = i.where("dst is null and name is not null and instr(module, '.') > 0").select("to_project", "module", F.concat(parent(F.col("module")), F.lit("."), "name").alias("node"))
    given = direct.unionByName(relative).distinct().join(own.withColumnRenamed("project", "to_project"), ["to_project", "node"], "left_semi")
    given = given.join(own.select(F.col("project").alias("to_project"), F.col("node").alias("module")), ["to_project", "module"], "left_semi").withColumn("leaf", leaf(F.col("node")))
    asked = edges.where("dst is null and instr(name, '.') > 0").select("ref_id", "project", parent(F.col("name")).alias("module"), leaf(F.col("name")).alias("leaf"))
    hit = asked.join(given, ["module", "leaf"]).where("project != to_project").select("ref_id", "project", "to_project", "node").distinct()
    return hit.groupBy("ref_id", "project").agg(F.count("*").alias("n"), F.min(F.struct("to_project", "node")).alias("t")).where("n = 1").select("ref_id", "project", "t.to_project", "t.node")


def union_edges(local: DataFrame, cross: DataFrame) -> DataFrame:
    """(src, dst): the resolved edges of all projects and those between them, each node named with its project."""
    name = lambda p, n: F.concat_ws("::", p, n)
    a = local.where("dst is not null").select(name("project", "src").alias("src"), name("project", "dst").alias("dst"))
    return a.unionByName(cross.select(name("from_project", "from_node_id").alias("src"), name("to_project", "to_node_id").alias("dst")))


def workspace_scores(local: DataFrame, cross: DataFrame, tolerance: float | None = 1e-10) -> DataFrame:
    """(node, in_degree, pagerank) over the union of all projects' graphs; without a tolerance no PageRank."""
    e = union_edges(local, cross)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    out = nodes.join(graph.fan_in(e), "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    return out if tolerance is None else out.join(graph.pagerank(e, rounds=200, tolerance=tolerance), "node", "left")


def similar_projects(symbols: DataFrame, k: int = 5, least: float = 0.6, digits: int = 6) -> DataFrame:
    """(from_project, from_node_id, to_project, to_node_id, score, rank): the k most similar symbols of every other project.

    symbols (id, project, node, embedding), several rows for a symbol allowed: each row finds its k nearest rows of a
    project, a pair of symbols keeps its best score of at least ``least``, and a symbol its k best pairs in a project.
    """
    s = symbols.where("project is not null and node is not null and embedding is not null")
    projects = [r[0] for r in s.select("project").distinct().orderBy("project").limit(MAX_PROJECTS + 1).collect()]
    if len(projects) > MAX_PROJECTS:
        raise ValueError(f"more than {MAX_PROJECTS} projects")
    q = s.withColumn("other", F.explode(F.array(*map(F.lit, projects)) if projects else F.array().cast("array<string>"))).where("project != other")
    q = q.select(F.concat_ws("\0", F.col("id").cast("string"), "other").alias("qid"), "embedding", "other", F.col("project").alias("from_project"), F.col("node").alias("from_node_id"))
    near = retrieval.dense(s.select("id", "embedding", "project"), q.select("qid", "embedding", "other"), k, digits=digits, same=("project", "other")).where(F.col("score") >= least)
    pair = near.join(q.drop("embedding"), "qid").join(s.select("id", F.col("node").alias("to_node_id")), "id")
    best = pair.groupBy("from_project", "from_node_id", F.col("other").alias("to_project"), "to_node_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("from_project", "from_node_id", "to_project").orderBy(F.desc("score"), "to_node_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def post_filter(ranked: DataFrame, keep: Column, composite: str = "_composite_", title: str = "title") -> DataFrame:
    """The ranked rows for which a predicate holds, and composite rows in any case; a null predicate does not hold."""
    return ranked.where(F.coalesce(keep, F.lit(False)) | F.coalesce(F.col(title) == composite, F.lit(False)))


def members_within(members: DataFrame, budget: int, by: str = "qid") -> DataFrame:
    """(by, text, pieces, left_out): members (by, rank, package, module, name, kind, signature, docstring) rendered one after the other, up to budget x 4 characters.

    A piece that does not fit ends the text; what is left out is counted.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    piece = F.concat(F.lit("**["), text("package"), F.lit("] "), text("module"), F.lit("."), text("name"), text("signature"), F.lit("** ("), text("kind"), F.lit(")\n"), text("docstring"), F.lit("\n"))
    w = W.partitionBy(by).orderBy("rank")
    p = members.select(by, "rank", piece.alias("piece")).withColumn("size", F.sum(F.length("piece") + F.when(F.col("rank") > 1, 1).otherwise(0)).over(w))
    fits = F.col("size") <= budget * 4
    g = p.groupBy(by).agg(F.sort_array(F.collect_list(F.when(fits, F.struct("rank", "piece")))).alias("x"), F.count_if(~fits).alias("left_out"))
    return g.select(by, F.array_join(F.transform("x", lambda v: v["piece"]), "\n").alias("text"), F.size("x").alias("pieces"), "left_out")
