"""Retrieval metrics, resampling, and analytics over streams of agent events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, mrr, ndcg, p1) of ranked (qid, id, rank) against gold (qid, id); queries without gold are left out.

    recall: is a relevant one among the first k; ndcg is binary, its ideal min(k, relevant) hits.
    """
    g = gold.select("qid", "id").distinct().withColumn("rel", F.lit(1))
    n = g.groupBy("qid").agg(F.count("*").alias("n"))
    r = ranked.join(g, ["qid", "id"], "left").where("rel = 1").groupBy("qid").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    j = n.join(r, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return j.select(
        "qid",
        F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("p1"),
    )


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """p50, p95 and p99, exact, with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(*by).agg(p.alias("p"), F.count(value).alias("n")).select(*by, "n", *(F.round(F.element_at("p", i + 1), 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))))


def bootstrap_mean(df: DataFrame, value: str, id_col: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(mean, low, high): mean with a 95 % interval by Poisson resampling.

    Each row is drawn a Poisson(1) number of times in each resample, by a hash of id, resample and seed, so
    that a resample is one partial aggregate and no index table is shuffled.
    """
    u = (F.pmod(F.xxhash64(F.col(id_col), F.col("b"), F.lit(seed)), F.lit(1 << 53)) + 0.5) / (1 << 53)
    times, acc = F.lit(0), 0.0
    for i in range(9):
        acc += math.exp(-1) / math.factorial(i)
        times = F.when(u > acc, i + 1).otherwise(times) if i else F.when(u > acc, 1).otherwise(0)
    x = df.where(F.col(value).isNotNull()).select(id_col, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("t", times)
    m = x.groupBy("b").agg((F.sum(F.col("v") * F.col("t")) / F.sum("t")).alias("m"))
    ci = m.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ci).select("mean", F.element_at("p", 1).alias("low"), F.element_at("p", 2).alias("high"))


def mcnemar(only_a: int, only_b: int) -> tuple[float, float]:
    """Exact p-values, two-sided and one-sided (is a better), from the counts of discordant pairs."""
    n = only_a + only_b
    tail = lambda k: sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n if n else 1.0
    return min(1.0, 2 * tail(max(only_a, only_b))), tail(only_a)


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of the four outcomes of two systems on the same instances."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return j.groupBy("a", "b").agg(F.count("*").alias("n"))


def stratified_split(df: DataFrame, stratum: str, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """(stratum, id, part): of each stratum round-half-even(share x n) rows are dev, in hash order."""
    w = W.partitionBy(stratum)
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    r = df.select(stratum, F.col(id_col).alias("id"), F.row_number().over(w.orderBy(h, id_col)).alias("n"), F.bround(F.count("*").over(w) * share, 0).alias("dev"))
    return r.select(stratum, "id", F.when(F.col("n") <= F.col("dev"), "dev").otherwise("test").alias("part"))


def first_touch(events: DataFrame, by: str, item: str, tool: str, order: list[str]) -> DataFrame:
    """Which tool first surfaced an item."""
    return events.where(F.col(item).isNotNull()).groupBy(by, item).agg(F.min_by(tool, F.struct(*order)).alias("tool"))


def tool_yield(events: DataFrame, tool: str, good: Column) -> DataFrame:
    g = events.groupBy(tool).agg(F.count("*").alias("calls"), F.sum(F.when(good, 1).otherwise(0)).alias("useful"))
    return g.withColumn("yield", F.round(F.col("useful") / F.col("calls"), 6))


def usage(events: DataFrame, message: str, amount: str) -> DataFrame:
    """Reported totals, and totals with each message counted once."""
    one = events.groupBy(message).agg(F.max(amount).alias("v")).agg(F.round(F.sum("v"), 2).alias("once"), F.count("*").alias("messages"))
    return one.crossJoin(events.agg(F.round(F.sum(amount), 2).alias("reported")))


def spans(events: DataFrame, by: str, at: str) -> DataFrame:
    """(by, calls, seconds): wall-clock span of each trajectory."""
    return events.where(F.col(at).isNotNull()).groupBy(by).agg(F.count("*").alias("calls"), F.round(F.max(at).cast("timestamp").cast("double") - F.min(at).cast("timestamp").cast("double"), 3).alias("seconds"))


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """A taxonomy: the first rule that holds names the row."""
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def shaped_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the components that are not null."""
    num, den = F.lit(0.0), F.lit(0.0)
    for c, w in parts.values():
        num = num + F.when(c.isNotNull(), c * w).otherwise(0.0)
        den = den + F.when(c.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.round(F.when(den > 0, num / den).otherwise(0.0), 6)


def correlate(a: DataFrame, b: DataFrame, by: str, order: str) -> DataFrame:
    """Two streams zipped by order within a key; unequal counts leave rows with a null side."""
    w = W.partitionBy(by).orderBy(order)
    n = lambda df, c: df.select(by, F.col(order).alias(c), F.row_number().over(w).alias("n"))
    return n(a, "left_at").join(n(b, "right_at"), [by, "n"], "full")


def sessions(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """(by, start, end, events): runs of events with no silence longer than the gap."""
    s = events.where(F.col(at).isNotNull() & F.col(by).isNotNull()).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(mean, low, high) of the difference b - a over shared instances; both sides of an instance are drawn together."""
    j = a.select(key, F.col(value).cast("double").alias("__a")).join(b.select(key, F.col(value).cast("double").alias("__b")), key)
    return bootstrap_mean(j.select(key, (F.col("__b") - F.col("__a")).alias("d")), "d", key, resamples, seed)


def pairs_needed(share_discordant: float, share_better: float, power: float = 0.8, alpha: float = 0.05, most: int = 20_000) -> int | None:
    """How many pairs an exact two-sided McNemar test needs: the least number with that power, None beyond ``most``."""
    if not 0 < share_discordant <= 1 or not 0.5 < share_better <= 1:
        raise ValueError("shares must be in (0, 1] and better above a half")

    def reached(n: int) -> bool:
        d = round(n * share_discordant)
        if not d:
            return False
        got = sum(math.comb(d, k) * share_better**k * (1 - share_better) ** (d - k) for k in range(d // 2 + 1, d + 1) if mcnemar(k, d - k)[0] <= alpha)
        return got >= power

    n = 8
    while n <= most and not reached(n):
        n = max(n + 1, int(n * 1.05))
    return n if n <= most else None


def label_agreement(df: DataFrame, a: str, b: str, by: str, least: float = 0.9) -> DataFrame:
    """(by, agreement, agrees): mean Jaccard overlap of two label sets of each row."""
    u = F.size(F.array_union(a, b))
    jac = F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(1.0)
    return df.groupBy(by).agg(F.round(F.avg(jac), 6).alias("agreement")).withColumn("agrees", F.col("agreement") >= least)


def relevant(items: DataFrame, gold: DataFrame) -> DataFrame:
    """Items (qid, rank, key, body, source_path) with ``relevant``, against gold (qid, body, keys, files).

    The first signal that a query's gold has decides: a body must be equal, keys (also none of them) must hold the
    item's, a file must be the item's path or its end after a slash. Without any signal nothing is relevant.
    """
    g = gold.select("qid", F.col("body").alias("__body"), F.col("keys").alias("__keys"), F.col("files").alias("__files"))
    path = F.exists("__files", lambda f: (F.col("source_path") == f) | F.endswith("source_path", F.concat(F.lit("/"), f)))
    yes = F.when(F.col("__body").isNotNull(), F.col("body") == F.col("__body")).when(F.col("__keys").isNotNull(), F.array_contains("__keys", F.col("key"))).when(F.size("__files") > 0, path)
    return items.join(g, "qid", "left").withColumn("relevant", F.coalesce(yes, F.lit(False))).drop("__body", "__keys", "__files")


def first_relevant(items: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank) of the first relevant item; queries without one are left out."""
    return relevant(items, gold).where("relevant").groupBy("qid").agg(F.min("rank").alias("rank"))


def largest_remainder(df: DataFrame, stratum: str, id_col: str, target: int, seed: int = 0) -> DataFrame:
    """(stratum, id): ``target`` rows shared out in proportion to the strata, what is left to the largest remainders, ties by stratum; rows in hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    q = sizes.crossJoin(F.broadcast(total)).withColumn("want", F.least(F.lit(target), F.col("total")))
    # whole numbers: quota = want * n / total, so floors and remainders are exact
    q = q.withColumn("floor", F.expr("want * n div total")).withColumn("rest", F.expr("want * n % total"))
    given = q.agg(F.sum("floor").alias("given"))
    w = W.partitionBy().orderBy(F.desc("rest"), stratum)  # one row for each stratum
    q = q.crossJoin(F.broadcast(given)).withColumn("seat", F.row_number().over(w)).withColumn("take", F.col("floor") + F.when(F.col("seat") <= F.col("want") - F.col("given"), 1).otherwise(0))
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    r = df.select(stratum, F.col(id_col).alias("id"), h.alias("h")).withColumn("at", F.row_number().over(W.partitionBy(stratum).orderBy("h", "id")))
    return r.join(q.select(stratum, "take"), stratum).where(F.col("at") <= F.col("take")).select(stratum, "id")


# The labels of a failed or solved run in the order in which they are tried, and the weights of a run's score.
LABELS = [
    "infra_error", "empty_trajectory", "crash_before_first_tool", "patch_apply_failed", "budget_exhausted", "resolved",
    "never_ran_tests", "localization_miss", "found_but_misdiagnosed", "right_idea_broken_edit", "regression_introduced", "unclassified_failure",
]
WEIGHTS = {"localization_recall": 0.20, "evidence_yield": 0.10, "patch_applies": 0.20, "f2p_fraction": 0.30, "p2p_clean": 0.10, "budget_headroom": 0.10}


def run_label() -> Column:
    """The label of a run from its columns: the first of LABELS whose condition holds.

    Booleans infra_error, has_tool, spoke, error_result, apply_failed, is_resolved, ran_tests, gold_surfaced, touches_gold; numbers
    patch_bytes, f2p_fraction, p2p_regressions, turns, turn_cap, tokens, token_cap, wall, wall_cap (a null cap is none).
    """
    c = F.col
    hit = lambda n: F.coalesce(c(n) >= c(f"{'turn' if n == 'turns' else 'token' if n == 'tokens' else n}_cap"), F.lit(False))
    silent = ~c("spoke") & ~c("error_result")
    when = [
        c("infra_error"),
        ~c("has_tool") & silent & (c("patch_bytes") == 0),
        ~c("has_tool") & ~silent,
        c("apply_failed"),
        (c("patch_bytes") == 0) & (hit("turns") | hit("tokens") | hit("wall")),
        c("is_resolved"),
        ~c("ran_tests"),
        ~c("gold_surfaced"),
        ~c("touches_gold"),
        c("f2p_fraction") < 1.0,
        c("p2p_regressions") > 0,
    ]
    return first_match(list(zip(LABELS, when, strict=False)), LABELS[-1])


def run_score() -> Column:
    """The weighted mean of six facts of a run: gold_recall, wasted_ratio, patch_applied, f2p_fraction, p2p_regressions, turns and turn_cap."""
    c = F.col
    headroom = F.when(F.coalesce(c("turn_cap"), F.lit(0)) == 0, 1.0).otherwise(1.0 - F.least(F.lit(1.0), c("turns") / c("turn_cap")))
    parts = {"localization_recall": c("gold_recall"), "evidence_yield": 1.0 - c("wasted_ratio"), "patch_applies": c("patch_applied").cast("double"), "f2p_fraction": c("f2p_fraction"), "p2p_clean": (c("p2p_regressions") == 0).cast("double"), "budget_headroom": headroom}
    return shaped_score({k: (parts[k], w) for k, w in WEIGHTS.items()})


def run_aggregate(runs: DataFrame, *by: str, infra: str = "infra_error", score: str = "score", cost: str = "cost", max_cost: float | None = None) -> DataFrame:
    """(*by, score, cost, graded, infra_excluded, within_budget): means over the graded runs, the cost of all; nothing graded scores 0."""
    bad = F.coalesce(F.col(infra), F.lit(False))
    g = runs.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.when(~bad, F.col(score))), F.lit(0.0)), 6).alias("score"), F.round(F.sum(cost), 6).alias("cost"), F.count_if(~bad).alias("graded"), F.count_if(bad).alias("infra_excluded"))
    return g.withColumn("within_budget", F.lit(True) if max_cost is None else F.col("cost") <= max_cost)


def strata_contrasts(a: DataFrame, b: DataFrame, stratum: DataFrame, key: str = "id", solved: str = "solved") -> DataFrame:
    """(stratum, only_a, only_b, n, delta): two systems on the same instances, stratum by stratum; instances without one are ``unknown``.

    Both must hold the same instances; others are left out. ``mcnemar`` gives the p-values of the two counts.
    """
    j = a.select(key, F.col(solved).alias("__a")).join(b.select(key, F.col(solved).alias("__b")), key).join(stratum.select(key, "stratum"), key, "left")
    g = j.groupBy(F.coalesce("stratum", F.lit("unknown")).alias("stratum"))
    out = g.agg(F.count_if(F.col("__a") & ~F.col("__b")).alias("only_a"), F.count_if(~F.col("__a") & F.col("__b")).alias("only_b"), F.count("*").alias("n"))
    return out.withColumn("delta", F.round((F.col("only_a") - F.col("only_b")) / F.col("n"), 6))
