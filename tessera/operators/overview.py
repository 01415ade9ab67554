"""Lookup, cards and maps of a project, decision records from documents, and plans that an LLM's picks would steer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import parents
from tessera.session import cut, partitions


def lookup(targets: DataFrame, known: DataFrame) -> DataFrame:
    """(target, module, symbol): the longest known dotted prefix, bare or as a document name, and what follows it.

    Targets without any known prefix keep a null module.
    """
    pre = targets.select("target", F.explode(parents("target")).alias("p"))
    forms = pre.select("target", "p", F.explode(F.array("p", F.concat("p", F.lit(".md")), F.concat("p", F.lit(".ipynb")))).alias("m"))
    hit = forms.join(known.select(F.col("node").alias("m")).distinct(), "m").groupBy("target").agg(F.max_by(F.struct("p", "m"), F.struct(F.length("p"), -F.length("m"))).alias("b"))
    j = targets.select("target").distinct().join(hit, "target", "left")
    rest = F.when(F.length("target") > F.length("b.p"), F.expr("substring(target, length(b.p) + 2)"))
    return j.select("target", F.col("b.m").alias("module"), rest.alias("symbol"))


def module_map(nodes: DataFrame, scores: DataFrame, by: str = "in_degree", top: int = 20) -> DataFrame:
    """The most central modules, ties by name."""
    return nodes.where("kind = 'module'").select("node").distinct().join(scores, "node", "left").select("node", F.coalesce(by, F.lit(0)).alias(by)).orderBy(F.desc(by), "node").limit(top)


def entry_points(scripts: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, kind): scripts before __main__ modules before graph roots; names marked as tests are left out."""
    a = scripts.select("node", F.lit("1 script").alias("k"))
    b = nodes.where("node like '%.__main__'").select("node", F.lit("2 main").alias("k"))
    c = roots.select("node", F.lit("3 root").alias("k"))
    u = a.unionByName(b).unionByName(c).where(~F.col("node").rlike(r"(^|[._])tests?([._]|$)"))
    return u.groupBy("node").agg(F.substring(F.min("k"), 3, 20).alias("kind"))


def search_text(chunks: DataFrame, kind: Column, title: str = "title", text: str = "text") -> DataFrame:
    """Title and first line of what a search result shows."""
    return chunks.where(kind).select("id", F.col(title).alias("title"), F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, 140).alias("line"))


def embed_tier(package: Column, policy: dict[str, str], default: str = "full") -> Column:
    """The embedding tier of a package: exact names before wildcards, wildcards in order."""
    out = F.lit(default)
    for name, tier in reversed([(n, t) for n, t in policy.items() if "*" in n]):
        out = F.when(package.rlike("^" + name.replace(".", r"\.").replace("*", ".*") + "$"), tier).otherwise(out)
    for name, tier in policy.items():
        if "*" not in name:
            out = F.when(package == name, tier).otherwise(out)
    return out


def decision_cards(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, found, decisions): decisions of a target, or of its nearest parent that has any."""
    up = targets.select("target", F.explode(parents("target")).alias("node"))
    n = decisions.groupBy("node").agg(F.count_distinct("decision").alias("decisions"))
    return up.join(n, "node").groupBy("target").agg(F.max_by(F.struct("node", "decisions"), F.length("node")).alias("b")).select("target", F.col("b.node").alias("found"), F.col("b.decisions").alias("decisions"))


def apply_picks(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Candidates re-ranked by picks (qid, id, pos): picked first in their order, the rest after in stage order, scores 1 - i / n.

    Picks that are no candidates and repeated ones are dropped.
    """
    p = picks.groupBy("qid", "id").agg(F.min("pos").alias("pos"))
    j = candidates.select("qid", "id", "rank").join(p, ["qid", "id"], "left")
    w = W.partitionBy("qid")
    j = j.withColumn("new_rank", F.row_number().over(w.orderBy(F.asc_nulls_last("pos"), "rank", "id")))
    return j.select("qid", "id", "new_rank", F.round(1 - (F.col("new_rank") - 1) / F.count("*").over(w), 9).alias("score"))


def prune_tree(tree: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of (node, parent) whose node is kept or lies above a kept one, however far; a node met again is not walked again."""
    up = tree.select("node", "parent").where("parent is not null").distinct()
    live = cut(keep.select("node").distinct())
    front = live
    while True:
        front = cut(front.join(up, "node").select(F.col("parent").alias("node")).distinct().join(live, "node", "left_anti"))
        if front.isEmpty():
            return tree.join(live, "node", "left_semi")
        live = cut(live.unionByName(front))


def node_budget(tree: DataFrame, budget: int) -> DataFrame:
    """(node, level, at): the first ``budget`` nodes of a breadth-first walk, siblings by name.

    The walk goes down until no node is new or the levels above already hold enough; nodes below a cycle have no level.
    """
    kids = tree.where("parent is not null").select(F.col("node").alias("kid"), F.col("parent").alias("node")).distinct()
    out = cut(tree.where("parent is null").select("node", F.lit(0).alias("level")).distinct())
    level = out
    i = 0
    while out.limit(budget).count() < budget:
        i += 1
        level = cut(level.select("node").join(kids, "node").select(F.col("kid").alias("node"), F.lit(i).alias("level")).distinct().join(out.select("node"), "node", "left_anti"))
        if level.isEmpty():
            break
        out = cut(out.unionByName(level))
    top = out.orderBy("level", "node").limit(budget)
    return top.withColumn("at", F.row_number().over(W.partitionBy().orderBy("level", "node")))


def file_metrics(events: DataFrame, gold: DataFrame) -> DataFrame:
    """(by, recall, wasted, first_hit) of reads (by, file, seq) against gold (by, file)."""
    g = gold.select("by", "file").distinct().withColumn("rel", F.lit(1))
    n = g.groupBy("by").agg(F.count("*").alias("n"))
    r = events.where("file is not null").join(g, ["by", "file"], "left").groupBy("by").agg(
        F.count_distinct(F.when(F.col("rel") == 1, F.col("file"))).alias("hit"), F.count("*").alias("reads"), F.sum(F.when(F.col("rel").isNull(), 1).otherwise(0)).alias("waste"), F.min(F.when(F.col("rel") == 1, F.col("seq"))).alias("first_hit")
    )
    return n.join(r, "by", "left").select("by", F.round(F.coalesce("hit", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(F.col("waste") / F.col("reads"), F.lit(0.0)), 6).alias("wasted"), "first_hit")


def span_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(by, overlap): lines of b's spans that a's spans cover, over all of b's; spans (by, lo, hi) inclusive, merged first."""

    def merged(df: DataFrame) -> DataFrame:
        w = W.partitionBy("by").orderBy("lo", "hi")
        reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
        x = df.where("lo is not null and hi >= lo").withColumn("new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).withColumn("i", F.sum("new").over(w))
        return x.groupBy("by", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("i")

    x, y = merged(a), merged(b)
    total = y.groupBy("by").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("total"))
    both = x.select("by", F.col("lo").alias("l1"), F.col("hi").alias("h1")).join(y, "by").where("l1 <= hi and lo <= h1")
    got = both.groupBy("by").agg(F.sum(F.least("h1", "hi") - F.greatest("l1", "lo") + 1).alias("got"))
    return total.join(got, "by", "left").select("by", F.round(F.coalesce("got", F.lit(0)) / F.col("total"), 6).alias("overlap"))


def federated_edges(local: DataFrame, cross: DataFrame) -> DataFrame:
    """One edge list over project:node keys from local edges (project, src, dst, kind) and cross edges."""
    key = lambda p, n: F.concat_ws(":", p, n)
    a = local.where("dst is not null").select(key("project", "src").alias("src"), key("project", "dst").alias("dst"), "kind")
    b = cross.select(key("from_project", "src").alias("src"), key("to_project", "dst").alias("dst"), "kind")
    return a.unionByName(b).distinct()


def precedence_join(names: DataFrame, holders: DataFrame) -> DataFrame:
    """(name, project, node): each name's holder of highest precedence, ties to the smaller project and node."""
    j = names.select("name").distinct().join(holders.select(F.col("node").alias("name"), "project", "precedence"), "name")
    w = W.partitionBy("name").orderBy("precedence", "project")
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").select("name", "project")


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: the best match of the shorter text with a window of the longer one."""
    from difflib import SequenceMatcher

    s, l = sorted((a, b), key=len)
    if not s:
        return 100.0 if not l else 0.0
    m = SequenceMatcher(None, l, s, autojunk=False)
    best = 0.0
    for i, j, _ in m.get_matching_blocks():
        lo = max(0, i - j)
        best = max(best, SequenceMatcher(None, l[lo : lo + len(s)], s, autojunk=False).ratio())
    return round(100 * best, 6)


def fuzzy_gold(ranked: DataFrame, gold: DataFrame, least: float = 85.0) -> DataFrame:
    """Ranked (qid, id, rank, text) that match some gold text of their query at least so well; rows without id are passed over."""

    @F.pandas_udf("double")
    def ratio(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])

    j = ranked.where("id is not null").join(gold.select("qid", F.col("text").alias("gold")), "qid").repartition(partitions(ranked.sparkSession), "qid", "id")
    return j.withColumn("ratio", ratio("text", "gold")).groupBy("qid", "id", "rank").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= least)
