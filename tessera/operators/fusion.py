"""Fusion, re-ranking, limits and budgets over ranked lists of many queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.retrieval import top_k
from tessera.session import cut


def _union(branches: list[DataFrame], columns: list[str]) -> DataFrame:
    out = None
    for i, b in enumerate(branches):
        b = b.where("id is not null").select(*columns, F.lit(i).alias("branch"))
        out = b if out is None else out.unionByName(b)
    return out


def rrf(branches: list[DataFrame], k: float = 60, base: int = 0, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (qid, id, rank from 1): the sum of 1 / (k + rank), ranks from ``base``.

    Ties keep the order in which an id was first seen, by branch and rank.
    """
    u = _union(branches, ["qid", "id", "rank"])
    u = u.groupBy("qid", "id", "branch").agg(F.min("rank").alias("rank"))
    s = u.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1 + base)), 9).alias("score"), F.min(F.struct("branch", "rank")).alias("seen"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "seen", "id")
    out = s.select("qid", "id", "score", F.row_number().over(w).alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def weighted(branches: list[DataFrame], weights: list[float]) -> DataFrame:
    """Min-max normalised scores of (qid, id, score), weighted and summed.

    A branch whose scores are all equal counts 1 for each; a null score counts 0.
    """
    if len(branches) != len(weights):
        raise ValueError("as many weights as branches are needed")
    if any(w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must not be negative and must sum to 1")
    w = W.partitionBy("qid", "branch")
    u = _union(branches, ["qid", "id", "score"]).withColumn("score", F.coalesce("score", F.lit(0.0)))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    u = u.withColumn("unit", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0))
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("branch") + 1)
    s = u.groupBy("qid", "id").agg(F.round(F.sum(F.col("unit") * weight), 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))


def merge_ranked(df: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Of rows with one key the survivor by is_root, indexed_at and score; then the best by score."""
    w = W.partitionBy("qid", *key).orderBy(F.desc("is_root"), F.desc_nulls_last("indexed_at"), F.desc("score"), "id")
    one = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return top_k(one, limit, "qid", [F.desc("score"), F.asc("id")])


def centrality_boost(ranked: DataFrame, scores: DataFrame, metric: str = "pagerank", alpha: float = 0.5, digits: int = 9) -> DataFrame:
    """score x (1 + alpha x metric / peak); the peak is over a query's candidates, and without one nothing changes."""
    m = F.log1p(F.col("__m")) if metric == "in_degree" else F.col("__m")
    j = ranked.join(scores.select("node", F.col(metric).cast("double").alias("__m")), "node", "left").withColumn("__m", F.coalesce(m, F.lit(0.0)))
    peak = F.max("__m").over(W.partitionBy("qid"))
    boosted = F.when(peak > 0, F.col("score") * (1 + alpha * F.col("__m") / peak)).otherwise(F.col("score"))
    return j.withColumn("score", F.round(boosted, digits)).drop("__m")


def diversify(ranked: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Each community's best member unpenalised, its others at score - penalty; -1 is no community.

    The closed form of the greedy choice: the reordering does not rewrite scores. Adds new_rank.
    """
    first = W.partitionBy("qid", "community").orderBy(F.desc("score"), "rank")
    adj = F.when((F.col("community") == -1) | (F.row_number().over(first) == 1), F.col("score")).otherwise(F.col("score") - penalty)
    w = W.partitionBy("qid").orderBy(F.desc("adjusted"), "rank")
    return ranked.withColumn("adjusted", F.round(adj, 9)).withColumn("new_rank", F.row_number().over(w))


def token_budget(ranked: DataFrame, budget: int, by: str = "qid") -> DataFrame:
    """(by, text, pieces): title and text of ranked rows, concatenated up to budget x 4 characters.

    The piece that overflows is cut if more than 100 characters remain, and nothing follows it.
    """
    most = budget * 4
    piece = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    w = W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    p = ranked.select(by, "rank", piece.alias("piece")).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))
    full = F.col("before") + F.length("piece") <= most
    partial = (F.col("before") < most) & (most - F.col("before") > 100)
    p = p.withColumn("piece", F.when(full, F.col("piece")).when(partial, F.expr(f"substring(piece, 1, {most} - before)"))).where("piece is not null")
    s = p.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("x"))
    return s.select(by, F.array_join(F.transform("x", lambda v: v["piece"]), "").alias("text"), F.size("x").alias("pieces"))


def split_budget(sizes: DataFrame, total: int, by: str, size: str) -> DataFrame:
    """A floor of a tenth for each, the rest in proportion to size; even where the floors do not fit."""
    w = W.partitionBy(by)
    n, s = F.count("*").over(w), F.sum(size).over(w)
    floor = total // 10
    rest = total - n * floor
    even = F.expr(f"cast({total} as bigint)") / n
    share = F.when(n * floor > total, F.floor(even)).when(s > 0, floor + F.floor(rest * F.col(size) / s)).otherwise(floor + F.floor(rest / n))
    return sizes.withColumn("budget", share.cast("long"))


def pack_context(nodes: DataFrame, chars: int, ratio: float = 0.5) -> DataFrame:
    """(qid, id, rank, body): nodes by score and hop; bodies while their number and size fit.

    A body that does not fit is skipped and later ones may still fit, so each query is one ordered walk.
    Only ids and lengths enter it.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "hop", "id"], ascending=[False, True, True], kind="stable")
        most, left, used, body = -(-len(pdf) * ratio // 1), chars, 0, []
        for n in pdf["chars"]:
            ok = used < most and n <= left
            used, left = used + ok, left - n * ok
            body.append(bool(ok))
        return pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "rank": range(1, len(pdf) + 1), "body": body})

    t = dict(nodes.dtypes)
    return nodes.select("qid", "id", "score", "hop", "chars").groupBy("qid").applyInPandas(walk, f"qid {t['qid']}, id {t['id']}, rank int, body boolean")


#: Share of a parent's children that must be hit for the parent to stand for them.
ROLLUP = {"class": 0.3, "module": 0.6, "markdown_heading": 0.5}


def parent_rollup(hits: DataFrame, tree: DataFrame, thresholds: dict[str, float] = ROLLUP, default: float = 0.5, levels: int | None = None) -> DataFrame:
    """Hits (qid, node, score) with children replaced by their parent where enough of them were hit.

    tree: (node, parent, kind). Deepest parents first: with two or more distinct children hit, and at least
    the threshold's share of all its children, the parent takes their place with the best score. One
    level is one join and aggregate; without ``levels`` until no parent takes a place any more.
    """
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count_distinct("node").alias("children"))
    need = F.lit(default)
    for kind, t in thresholds.items():
        need = F.when(F.col("kind") == kind, t).otherwise(need)
    parents = kids.join(tree.select(F.col("node").alias("parent"), "kind").distinct(), "parent", "left").select("parent", "children", need.alias("need"))
    up = tree.where("parent is not null").select("node", "parent").distinct()
    now = hits.groupBy("qid", "node").agg(F.max("score").alias("score")).withColumn("rolled", F.lit(0))
    done = 0
    while levels is None or done < levels:
        j = now.join(up, "node", "left").join(parents, "parent", "left")
        w = W.partitionBy("qid", "parent")
        hit = F.count("*").over(w)
        j = j.withColumn("roll", F.coalesce(F.col("parent").isNotNull() & (hit >= 2) & (hit >= F.col("need") * F.col("children")), F.lit(False)))
        if levels is None:
            j = cut(j)
            if j.where("roll").isEmpty():
                break
        now = j.groupBy("qid", F.when(F.col("roll"), F.col("parent")).otherwise(F.col("node")).alias("node")).agg(F.max("score").alias("score"), F.max(F.when(F.col("roll"), F.col("rolled") + 1).otherwise(F.col("rolled"))).alias("rolled"))
        done += 1
    return now


def rollup_tree(hits: DataFrame, tree: DataFrame, thresholds: dict[str, float] = ROLLUP, default: float = 0.5) -> DataFrame:
    """Hits (qid, node, score, rolled) over the whole tree, however deep, children before their parents.

    As ``parent_rollup``, but parents take their turn from the deepest level to the root, and a claim is final: a
    parent that stands for its children takes its own hit in, and neither counts as a hit further up. A node
    with several parents belongs to the smallest; only nodes of the tree stand for their children; nodes in or below
    a cycle have no level and stay as they are.
    """
    t = tree.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), F.min("kind").alias("kind"))
    need = F.lit(default)
    for kind, x in thresholds.items():
        need = F.when(F.col("kind") == kind, x).otherwise(need)
    t = cut(t.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), need.alias("need")))
    kids = t.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    front = t.join(t.select(F.col("node").alias("parent")), "parent", "left_anti").select("node")
    levels = []
    while not (front := cut(front)).isEmpty():
        levels.append(front)
        front = t.join(front.select(F.col("node").alias("parent")), "parent").select("node")
    now = hits.groupBy("qid", "node").agg(F.max("score").alias("score")).withColumn("rolled", F.lit(0))
    up = t.where("parent is not null").select("node", "parent")
    for level in reversed(levels[:-1]):
        parents = level.join(kids, "node").join(t.select("node", "need"), "node").select(F.col("node").alias("parent"), "children", "need")
        own = now.where("rolled = 0").join(up, "node").join(parents, "parent")
        full = own.groupBy("qid", "parent").agg(F.count("*").alias("hit"), F.max("children").alias("children"), F.max("need").alias("need")).where("hit >= 2 and hit >= need * children").select("qid", "parent")
        claims = up.join(full, "parent").select("qid", "node", "parent").union(full.select("qid", F.col("parent").alias("node"), "parent"))
        j = now.join(claims, ["qid", "node"], "left").withColumn("roll", F.col("parent").isNotNull() & (F.col("rolled") == 0))
        now = cut(j.groupBy("qid", F.when(F.col("roll"), F.col("parent")).otherwise(F.col("node")).alias("node")).agg(F.max("score").alias("score"), F.max(F.when(F.col("roll"), 1).otherwise(F.col("rolled"))).alias("rolled")))
    return now
