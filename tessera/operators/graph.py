"""The directed, typed reference graph: closures, expansion, centrality, resolution and linking.

Edges are (src, dst, name, kind, package): dst is null where the reference was not resolved. All loops run
a bounded number of rounds of equi-joins on a frontier and cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import parents
from tessera.session import blank_to_null, cut


def edges_of(refs: DataFrame) -> DataFrame:
    """Clean edges from a reference table: trimmed, kinds in lower case, blanks null, one row for each
    (package, src, name, kind): the last delivery's target wins."""
    e = refs.select("ref_id", blank_to_null("from_package").alias("package"), blank_to_null("from_node_id").alias("src"), blank_to_null("to_name").alias("name"), blank_to_null("to_node_id").alias("dst"), F.lower(blank_to_null("kind")).alias("kind"), "received_at")
    return last_wins(e, ["package", "src", "name", "kind"], ["received_at", "ref_id", "dst"]).drop("received_at")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert on a key: the row that is last in the order is kept."""
    w = W.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def neighbours(edges: DataFrame, targets: DataFrame, direction: str = "in") -> DataFrame:
    """One hop, all kinds: (target, node, kind). in: who points at a target; out: whom it points at."""
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    return edges.where(f"{b} is not null").join(targets.select(F.col("target").alias(a)), a).select(F.col(a).alias("target"), F.col(b).alias("node"), "kind").distinct()


def closure(edges: DataFrame, targets: DataFrame, depth: int, direction: str = "in", without: tuple[str, ...] = ("similar",)) -> DataFrame:
    """(target, node, hop): everything within ``depth`` hops and the least hop; not the target itself.

    A frontier that only holds new nodes, so cycles end and walks are not enumerated.
    """
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges.where(F.col("dst").isNotNull() & ~F.col("kind").isin(*without)).select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()
    seen = targets.select("target", F.col("target").alias("node"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, depth + 1):
        step = front.select("target", F.col("node").alias("at")).join(e, "at").select("target", F.col("to").alias("node")).distinct()
        front = cut(step.join(seen.select("target", "node"), ["target", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def fan_in(edges: DataFrame) -> DataFrame:
    """(node, in_degree) over resolved edges, repeated ones counted."""
    return edges.where("dst is not null").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def degree_by_package(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(package, in_degree, out_degree): in leaves out unresolved edges, out leaves out decision sources."""
    i = edges.where("dst is not null").join(owner.select(F.col("node").alias("dst"), F.col("package").alias("to_package")), "dst").groupBy(F.col("to_package").alias("package")).agg(F.count("*").alias("in_degree"))
    o = edges.where("not src like 'decision:%'").groupBy("package").agg(F.count("*").alias("out_degree"))
    return i.join(o, "package", "full").select("package", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def import_profile(edges: DataFrame) -> DataFrame:
    """(package, target, imports): imports by the first segment of the name, a package's own left out."""
    head = F.substring_index("name", ".", 1)
    own = F.regexp_replace("package", "-", "_")
    return edges.where("kind = 'imports' and name is not null").select("package", head.alias("target"), own.alias("own")).where("target != own").groupBy("package", "target").agg(F.count("*").alias("imports"))


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 1, decay: float = 0.9, per_node: int = 25, kinds: dict[str, float] | None = None) -> DataFrame:
    """Seeds (qid, node, score) with their graph neighbours: score x decay^hop x kind weights, the best path counts.

    A node widens the frontier only where it is first met; a node's first ``per_node`` edges by kind and
    target are followed.
    """
    kinds = kinds or {"calls": 1.0, "inherits": 1.0}
    weight = F.lit(0.0)
    for kind, x in kinds.items():
        weight = F.when(F.col("kind") == kind, x).otherwise(weight)
    e = edges.where(F.col("dst").isNotNull() & F.col("kind").isin(*kinds)).select("src", "dst", "kind").distinct()
    w = W.partitionBy("src").orderBy("kind", "dst")
    e = e.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_node).select(F.col("src").alias("node"), "dst", weight.alias("weight"))
    seen = seeds.groupBy("qid", "node").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(e, "node").groupBy("qid", F.col("dst").alias("node")).agg(F.max(F.col("score") * decay * F.col("weight")).alias("score"))
        fresh = cut(step.withColumn("hop", F.lit(hop)))
        front = fresh.join(seen.select("qid", "node").distinct(), ["qid", "node"], "left_anti")
        seen = seen.unionByName(fresh)
    return seen.groupBy("qid", "node").agg(F.round(F.max("score"), 9).alias("score"), F.min("hop").alias("hop"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, nodes: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(node, pagerank): power iteration over distinct edges, the mass of nodes without edges shared out.

    With a ``tolerance`` it ends as soon as all scores together change by less than that in a round; where ``rounds``
    do not suffice for it, all scores are 0.0. Without one, exactly ``rounds`` rounds are run.
    """
    e = edges.where("dst is not null and src is not null").select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    all_ = (nodes.select("node") if nodes is not None else e.select(F.col("src").alias("node")).union(e.select("dst"))).distinct()
    e = cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")))
    base = cut(all_.join(out.select(F.col("src").alias("node"), "deg"), "node", "left").select("node", F.col("deg").isNull().alias("sink")))
    n = base.count()
    if not n:
        return base.select("node", F.lit(0.0).alias("pagerank"))
    rank = base.select("node", "sink", F.lit(1.0 / n).alias("r"))
    if tolerance is not None:
        return _converged(rank, e, n, alpha, rounds, tolerance)
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("r"))), F.lit(0.0)).alias("lost"))
        got = rank.select(F.col("node").alias("src"), "r").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("got"))
        rank = base.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "sink", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("r"))
        rank = cut(rank)
    return rank.select("node", F.col("r").alias("pagerank"))


def _converged(rank: DataFrame, e: DataFrame, n: int, alpha: float, rounds: int, tolerance: float) -> DataFrame:
    """Rounds of PageRank from (node, sink, r) until the scores stay; the lost mass and the change are one small aggregate a round."""
    lost = rank.agg(F.sum(F.when(F.col("sink"), F.col("r")))).first()[0] or 0.0
    for _ in range(rounds):
        got = rank.select(F.col("node").alias("src"), "r").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("got"))
        new = F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.coalesce("got", F.lit(0.0))
        both = cut(rank.join(got, "node", "left").select("node", "sink", new.alias("r"), F.abs(new - F.col("r")).alias("moved")))
        lost, moved = both.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("r"))), F.lit(0.0)), F.sum("moved")).first()
        rank = both.drop("moved")
        if moved < tolerance:
            return rank.select("node", F.col("r").alias("pagerank"))
    return rank.select("node", F.lit(0.0).alias("pagerank"))


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community) by label propagation on the undirected graph, in rounds, ties to the smaller label.

    In place of a modularity search, which has no distributed form here: each round is one join and two
    aggregates. Nodes take the label of most of their neighbours and of themselves. It ends when no label has
    changed, or all are those of two rounds before (two sides that swap their labels for ever), at the latest after ``rounds``.
    """
    e = edges.where("dst is not null and src is not null and src != dst").select("src", "dst").distinct()
    both = cut(e.union(e.select("dst", "src")).toDF("node", "other").distinct().unionByName(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("other"))))
    label = cut(both.select("node").distinct().withColumn("label", F.col("node")).withColumn("was", F.lit(None).cast("string")))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        new = votes.groupBy("node").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("new"))
        j = cut(label.join(new, "node"))
        moved, swung = j.agg(F.count_if(F.col("new") != F.col("label")), F.count_if(~F.col("new").eqNullSafe(F.col("was")))).first()
        label = j.select("node", F.col("new").alias("label"), F.col("label").alias("was"))
        if not moved or not swung:
            break
    return label.select("node", F.col("label").alias("community"))


def cohesion(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(community, intra, cross, cohesion) over edges whose both ends have a community."""
    c = scores.where("community != '-1'").select("node", "community")
    j = edges.where("dst is not null").join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst")
    g = j.groupBy(F.col("a").alias("community")).agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("intra"), F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).alias("cross"))
    return g.withColumn("cohesion", F.round(F.col("intra") / (F.col("intra") + F.col("cross")), 9))


def impact(edges: DataFrame, targets: DataFrame, scores: DataFrame, depth: int = 3, limit: int = 50) -> DataFrame:
    """Who is affected by a change of a target: nearest first, then by centrality, in-degree and name."""
    c = closure(edges, targets, depth).join(scores, "node", "left").na.fill(0.0, ["pagerank"]).na.fill(0, ["in_degree"])
    w = W.partitionBy("target").orderBy("hop", F.desc("pagerank"), F.desc("in_degree"), "node")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("target", "node", "hop", "rank")


def governed(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(decision, node) over governs edges, the marker before the decision's name taken off."""
    g = edges.where("kind = 'governs' and dst is not null").select(F.regexp_replace("src", "^decision:", "").alias("decision"), F.col("dst").alias("node")).distinct()
    return g if targets is None else g.join(targets.select(F.col("target").alias("node")), "node", "left_semi")


def ungoverned(nodes: DataFrame, edges: DataFrame, scores: DataFrame, metric: str = "in_degree", top: int = 5) -> DataFrame:
    """The most central modules that no decision governs."""
    free = nodes.select("node").distinct().join(governed(edges).select("node"), "node", "left_anti")
    return free.join(scores.select("node", metric), "node").orderBy(F.desc(metric), "node").limit(top)


def inheritance(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, relation, node): bases, also unresolved ones by name, and subclasses by id or exact name."""
    e = edges.where("kind = 'inherits'")
    base = e.join(targets.select(F.col("target").alias("src")), "src").select(F.col("src").alias("target"), F.lit("base").alias("relation"), F.coalesce("dst", "name").alias("node"))
    sub = e.withColumn("target", F.coalesce("dst", "name")).join(targets.select("target"), "target").select("target", F.lit("subclass").alias("relation"), F.col("src").alias("node"))
    return base.unionByName(sub).where("node is not null").distinct()


def roots_over_median(edges: DataFrame) -> DataFrame:
    """(node, out_degree): nodes nobody points at whose out-degree is above the median of all sources."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    mid = out.agg(F.percentile("out_degree", F.lit(0.5)).alias("mid"))
    return out.join(edges.where("dst is not null").select(F.col("dst").alias("node")), "node", "left_anti").crossJoin(F.broadcast(mid)).where("out_degree > mid").select("node", "out_degree")


def resolve_exact(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Unresolved edges get the node whose id is their name."""
    n = names.select(F.col("node").alias("name"), F.col("node").alias("__hit")).distinct()
    return edges.join(n, "name", "left").withColumn("dst", F.coalesce("dst", "__hit")).drop("__hit")


def resolve_suffix(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Unresolved edges get the only node of their package whose id ends with their name, dots respected.

    The join is on the last segment; the rest is compared after it.
    """
    open_ = edges.where("dst is null and name is not null").select("package", "name").distinct().withColumn("tail", F.substring_index("name", ".", -1))
    n = names.select("package", "node").distinct().withColumn("tail", F.substring_index("node", ".", -1))
    hit = open_.join(n, ["package", "tail"]).where((F.col("node") == F.col("name")) | F.endswith("node", F.concat(F.lit("."), F.col("name"))))
    one = hit.groupBy("package", "name").agg(F.count("*").alias("n"), F.min("node").alias("__hit")).where("n = 1").drop("n")
    return edges.join(one, ["package", "name"], "left").withColumn("how", F.when(F.col("dst").isNotNull(), "given").when(F.col("__hit").isNotNull(), "suffix").otherwise("none")).withColumn("dst", F.coalesce("dst", "__hit")).drop("__hit")


def link_projects(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unresolved names that exactly one other project holds: (ref_id, project, to_project, node).

    edges carry ``project``; symbols are (project, node). A name held by several other projects is ambiguous and links nowhere.
    """
    s = symbols.select(F.col("project").alias("to_project"), "node").distinct()
    j = edges.where("dst is null").select("ref_id", "project", F.col("name").alias("node")).join(s, "node").where("project != to_project")
    return j.groupBy("ref_id", "project", "node").agg(F.count_distinct("to_project").alias("n"), F.min("to_project").alias("to_project")).where("n = 1").drop("n")


def split_symbol(name: str = "node") -> tuple:
    """(module, class) of a dotted name: the second-last segment is a class if it starts upper-case and there are three."""
    p = F.split(name, r"\.")
    is_class = (F.size(p) >= 3) & F.element_at(p, -2).rlike("^_*[A-Z]")
    module = F.when(is_class, F.array_join(F.slice(p, 1, F.size(p) - 2), ".")).otherwise(F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "."))
    return module, F.when(is_class, F.element_at(p, -2))


def lift(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between the longest visible dotted prefixes of their ends, without repeats and self-loops."""
    v = visible.select(F.col("node").alias("p")).distinct()

    def up(e: DataFrame, side: str) -> DataFrame:
        names = e.select(side).distinct().withColumn("p", F.explode(parents(side)))
        best = names.join(v, "p").groupBy(side).agg(F.max_by("p", F.length("p")).alias(f"{side}_up"))
        return e.join(best, side)

    e = up(up(edges.where("dst is not null").select("src", "dst", "kind").distinct(), "src"), "dst")
    return e.select(F.col("src_up").alias("src"), F.col("dst_up").alias("dst"), "kind").where("src != dst").distinct()


def merge_cross(local: DataFrame, cross: DataFrame) -> DataFrame:
    """Local edges, unresolved ones completed by the matching cross edge, and cross rows that are new."""
    key = ["src", "name", "kind"]
    c = cross.select(*key, F.col("dst").alias("__c")).groupBy(*key).agg(F.min("__c").alias("__c"))
    done = local.join(c, key, "left").withColumn("dst", F.coalesce("dst", "__c")).drop("__c")
    new = cross.select(*key, "dst").join(local.select("src", "kind", "dst"), ["src", "kind", "dst"], "left_anti").join(local.select(*key).distinct(), key, "left_anti")
    return done.select(*key, "dst").unionByName(new.select(*key, "dst")).distinct()


def package_tree(modules: DataFrame, name: str = "module") -> DataFrame:
    """(node, parent, kind): the trie of module paths; inner nodes with one child are passed over."""
    m = modules.select(F.col(name).alias("m")).where("m is not null and m != ''").distinct()
    pre = m.select("m", F.posexplode(parents("m")).alias("at", "node"))
    edges = pre.select("node", F.when(F.col("at") > 0, F.regexp_replace("node", r"\.[^.]*$", "")).alias("parent")).distinct()
    kids = edges.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    own = m.select(F.col("m").alias("node"), F.lit(True).alias("own"))
    n = edges.join(kids, "node", "left").join(own, "node", "left")
    kept = cut(n.where("own or coalesce(kids, 0) != 1 or parent is null").select("node", F.when(F.col("own"), "module").otherwise("subpackage").alias("kind")))
    above = kept.select("node", "kind", F.explode(F.slice(parents("node"), 1, F.greatest(F.size(parents("node")) - 1, F.lit(0)))).alias("p"))
    par = above.join(kept.select(F.col("node").alias("p")), "p").groupBy("node").agg(F.max_by("p", F.length("p")).alias("parent"))
    return kept.join(par, "node", "left").select("node", "parent", "kind")
