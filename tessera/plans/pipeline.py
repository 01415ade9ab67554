"""Declared retrieval pipelines: a registry of steps, YAML or dict definitions, routing, presets.

A step maps a frozen state of lazy frames to a new one, so that a whole pipeline is one Catalyst plan over
a batch of queries. A pipeline is a step itself and may be nested.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters, fusion, graph, retrieval
from tessera.operators.filters import Registry

STEPS = Registry()
MAX_NESTING = 32


@dataclass(frozen=True)
class State:
    """queries (qid, terms[, embedding]); corpus (id, text[, title, node, package, embedding]); frames by name."""

    queries: DataFrame
    corpus: DataFrame
    edges: DataFrame | None = None
    ranked: DataFrame | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    where: object = None

    def put(self, name: str | None, df: DataFrame) -> State:
        return replace(self, ranked=df, frames=self.frames | ({name: df} if name else {}))


Step = Callable[[State], State]


@STEPS.add("pre_filter")
def pre_filter(spec: dict | None = None, allowed: list[str] | None = None) -> Step:
    node = filters.parse(spec)
    rest, scopes = filters.split_scope(node)
    if allowed is not None:
        filters.check(rest, set(allowed))
    return lambda s: replace(s, where=filters.column(rest) & filters.scope_column(scopes))


@STEPS.add("lexical")
def lexical(k: int = 50, publish: str | None = "bm25.ranked") -> Step:
    def run(s: State) -> State:
        text = F.concat_ws("\n", *(c for c in ("title", "text") if c in s.corpus.columns))
        return s.put(publish, retrieval.bm25(s.corpus, s.queries, "id", text, "qid", "terms", k, s.where))

    return run


@STEPS.add("dense")
def dense(k: int = 50, publish: str | None = "dense.ranked", apply_scope: bool = True) -> Step:
    def run(s: State) -> State:
        allow = s.corpus.where(s.where).select("id") if s.where is not None and apply_scope else None
        return s.put(publish, retrieval.dense(s.corpus.select("id", "embedding"), s.queries, k, allow))

    return run


@STEPS.add("rrf")
def rrf(branches: list[str], k: float = 60, limit: int | None = None) -> Step:
    """Branches that are not there are skipped."""
    return lambda s: s.put("fused", fusion.rrf([s.frames[b] for b in branches if b in s.frames], k, 0, limit))


@STEPS.add("weighted")
def weighted(branches: list[str], weights: list[float]) -> Step:
    """A branch that is not there is a KeyError."""
    return lambda s: s.put("fused", fusion.weighted([s.frames[b] for b in branches], weights))


@STEPS.add("dense_scorer")
def dense_scorer(k: int = 100) -> Step:
    def run(s: State) -> State:
        r = retrieval.dense_rescore(s.ranked, s.corpus, s.queries, k)
        return s.put(None, r.select("qid", "id", F.col("dense").alias("score"), F.col("new_rank").alias("rank")))

    return run


@STEPS.add("graph_expand")
def graph_expand(top: int = 10, depth: int = 1, decay: float = 0.9, per_node: int = 25) -> Step:
    def run(s: State) -> State:
        ids = s.corpus.select("id", "node").where("node is not null")
        seeds = s.ranked.where(F.col("rank") <= top).join(ids, "id").select("qid", "node", "score")
        g = graph.expand(seeds, s.edges, depth, decay, per_node)
        text = F.length(F.coalesce("text", F.lit("")))
        longest = s.corpus.where("node is not null").groupBy("node").agg(F.max_by("id", F.struct(text, "id")).alias("id"))
        both = s.ranked.select("qid", "id", "score").unionByName(g.join(longest, "node").select("qid", "id", "score"))
        return s.put(None, retrieval.top_k(both.groupBy("qid", "id").agg(F.max("score").alias("score")), 1 << 30, "qid", [F.desc("score"), F.asc("id")]))

    return run


@STEPS.add("top_k")
def top_k(k: int = 50) -> Step:
    return lambda s: s.put(None, retrieval.top_k(s.ranked.drop("rank"), k, "qid", [F.desc("score"), F.asc("id")]))


@STEPS.add("limit")
def limit(n: int = 8) -> Step:
    return lambda s: s.put(None, s.ranked.where(F.col("rank") <= n))


@STEPS.add("token_budget")
def token_budget(budget: int = 2000) -> Step:
    def run(s: State) -> State:
        text = retrieval.hydrate(s.ranked, s.corpus, "id", ["title", "text"])
        return s.put("composite", fusion.token_budget(text, budget))

    return run


@STEPS.add("parallel")
def parallel(branches: list) -> Step:
    """Branches from one state; their published frames are joined, the earlier branch's rows first."""
    steps = [build(b) for b in branches]

    def run(s: State) -> State:
        done = [st(s) for st in steps]
        frames = dict(s.frames)
        for d in done:
            frames |= d.frames
        return replace(done[0], frames=frames)

    return run


@STEPS.add("route")
def route(routes: list[dict], default: list | None = None) -> Step:
    """Each query goes to the first route whose predicate holds; results are put together."""
    built = [(r["when"], build(r["steps"])) for r in routes]
    other = build(default) if default else None

    def run(s: State) -> State:
        preds = filters.route_columns()
        left, parts = s.queries, []
        for name, step in built:
            p = F.coalesce(preds[name], F.lit(False))
            parts.append(step(replace(s, queries=left.where(p))).ranked)
            left = left.where(~p)
        if other:
            parts.append(other(replace(s, queries=left)).ranked)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return s.put(None, out)

    return run


def build(spec: list | dict | str, depth: int = 0) -> Step:
    """A step from its definition: a list is a sequence, a dict has a type and its parameters, a string is a preset."""
    if depth > MAX_NESTING:
        raise ValueError("pipelines are nested too deeply")
    if isinstance(spec, str):
        return build(PRESETS[spec], depth + 1)
    if isinstance(spec, list):
        names = [x["name"] for x in spec if isinstance(x, dict) and "name" in x]
        if len(names) != len(set(names)):
            raise ValueError("step names must be unique")
        steps = [build(x, depth + 1) for x in spec]

        def run(s: State) -> State:
            for st in steps:
                s = st(s)
            return s

        return run
    args = {k: v for k, v in spec.items() if k not in ("type", "name")}
    if spec.get("type") not in STEPS:
        raise ValueError(f"unknown step {spec.get('type')!r}")
    return STEPS[spec["type"]](**args)


def from_yaml(text: str) -> Step:
    import yaml

    return build(yaml.safe_load(text))


PRESETS: dict[str, list] = {
    "bm25": [{"type": "lexical"}, {"type": "top_k", "k": 50}, {"type": "limit", "n": 8}],
    "dense": [{"type": "dense"}, {"type": "top_k", "k": 50}, {"type": "limit", "n": 8}],
    "hybrid": [{"type": "parallel", "branches": [[{"type": "lexical"}], [{"type": "dense"}]]}, {"type": "rrf", "branches": ["bm25.ranked", "dense.ranked"]}, {"type": "dense_scorer"}, {"type": "limit", "n": 8}],
    "weighted": [{"type": "parallel", "branches": [[{"type": "lexical"}], [{"type": "dense"}]]}, {"type": "weighted", "branches": ["bm25.ranked", "dense.ranked"], "weights": [0.3, 0.7]}, {"type": "limit", "n": 8}],
    "dense_graph": [{"type": "dense"}, {"type": "graph_expand"}, {"type": "top_k", "k": 50}, {"type": "limit", "n": 8}],
    "bm25_graph": [{"type": "lexical"}, {"type": "graph_expand"}, {"type": "top_k", "k": 50}, {"type": "limit", "n": 8}],
    "packed": [{"type": "lexical"}, {"type": "limit", "n": 8}, {"type": "token_budget", "budget": 2000}],
    "routed": [{"type": "route", "routes": [{"when": "is_long_query", "steps": "bm25"}], "default": [{"type": "lexical"}, {"type": "limit", "n": 4}]}],
}
