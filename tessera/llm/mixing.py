"""Sources mixed to target shares of a token total, small ones repeated at most a capped number of times.

Texts are aggregated by the pattern of sources they belong to (a text stored under several sources is in
all of them). A min-cost flow routes the tokens of each pattern to the quotas of its sources, where the
r-th use of a pattern costs more than the one before. Documents are then drawn by a seeded hash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.session import cut

#: Directory of the public vocabulary files, and the one that counts tokens.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hash cells of a source; only the cell at the border is looked at row by row.
CELLS = 1 << 16


def canonical_source(c: Column | str) -> Column:
    """Names of one source that are only written differently become one: lower case, words joined by _."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(out, r"^_+|_+$", ""), F.lit(""))


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole text; null texts have 0.

    ``path`` must be readable by every executor.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path, vocabulary)
        for b in batches:
            n = [_length(enc, t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*(f.name for f in fields), "tokens"])

    return df.select(*(f.name for f in fields), F.col(text_col).alias("__text")).mapInArrow(run, schema)


_ENCODINGS: dict = {}


def _encoding(path: str, vocabulary: str):  # noqa: ANN202
    import tiktoken

    key = (path, vocabulary)
    if key not in _ENCODINGS:
        with open(f"{path}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _length(enc, text: str | None) -> int:  # noqa: ANN001
    if not text:
        return 0
    # a very long text is counted in parts cut before white space, where no token crosses
    n = 0
    while len(text) > 1_000_000:
        at = text.rfind("\n", 0, 1_000_000)
        at = at if at > 0 else 1_000_000
        n += len(enc.encode_ordinary(text[:at]))
        text = text[at:]
    return n + len(enc.encode_ordinary(text))


def min_cost_flow(supply: dict[str, tuple[int, list[str]]], caps: dict[str, int], quota: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens from each pattern to each source.

    supply: pattern -> (tokens, sources); a pattern may be used as often as the smallest cap of its sources
    allows, and the r-th use costs r a token, so the flow repeats no more than it must. Successive shortest
    paths with potentials over patterns and sources; both are few, as patterns are sets of sources.
    """
    names = ["", *supply, *quota, "sink"]
    at = {("p", p): 1 + i for i, p in enumerate(supply)} | {("s", s): 1 + len(supply) + i for i, s in enumerate(quota)}
    sink = len(names) - 1
    graph: list[list[list]] = [[] for _ in names]  # [to, capacity, cost, index of the reverse]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (tokens, sources) in supply.items():
        own = [s for s in sources if s in quota]
        for r in range(min((caps[s] for s in own), default=0)):
            arc(0, at["p", p], tokens, r + 1)
        for s in own:
            arc(at["p", p], at["s", s], 1 << 62, 0)
    for s, q in quota.items():
        arc(at["s", s], sink, q, 0)
    potential = [0] * len(names)
    while True:
        dist, via = [1 << 60] * len(names), [None] * len(names)
        dist[0] = 0
        heap = [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                nd = d + cost + potential[u] - potential[v]
                if cap > 0 and nd < dist[v]:
                    dist[v], via[v] = nd, (u, k)
                    heapq.heappush(heap, (nd, v))
        if via[sink] is None:
            break
        potential = [p + (d if d < 1 << 60 else 0) for p, d in zip(potential, dist, strict=True)]
        v, push = sink, 1 << 62
        while v:
            u, k = via[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v:
            u, k = via[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    out = {}
    for p in supply:
        for v, _, cost, back in graph[at["p", p]]:
            if cost == 0 and graph[v][back][1] > 0 and 1 + len(supply) <= v < sink:
                out[p, names[v]] = graph[v][back][1]
    return out


def largest_total(supply: dict[str, tuple[int, list[str]]], caps: dict[str, int], shares: dict[str, float]) -> tuple[int, dict[tuple[str, str], int]]:
    """The largest total whose every quota can be met, and its flow; by bisection over the flow."""
    live = {s: w for s, w in shares.items() if w > 0 and any(s in own and t > 0 for t, own in supply.values())}
    norm = sum(live.values())
    if not norm:
        return 0, {}
    quota = lambda total: {s: int(total * w / norm) for s, w in live.items()}
    # what a source alone could give bounds the total
    alone = {s: sum(t * min(caps[x] for x in own if x in caps) for t, own in supply.values() if s in own) for s in live}
    hi = min(int(alone[s] * norm / w) for s, w in live.items())
    flow = min_cost_flow(supply, caps, quota(hi))
    if sum(flow.values()) == sum(quota(hi).values()):
        return hi, flow
    lo, best = 0, {}
    while hi - lo > max(1, hi // 1_000_000):
        mid = (lo + hi) // 2
        flow = min_cost_flow(supply, caps, quota(mid))
        if sum(flow.values()) == sum(quota(mid).values()):
            lo, best = mid, flow
        else:
            hi = mid
    return lo, best


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The sample: (doc_id, source, repeats, tokens), one row for each document and source it is used for.

    Each source of ``targets`` (source, target_share, max_repeats) gets its share of the total in tokens;
    the total is the largest at which all shares can be met, or ``total_tokens`` if that is less. A source
    without documents keeps nothing and the others share what it would have had. Equal texts are one
    document, under the smallest id, and belong to the sources of all their rows; such a document is used
    at most as often as the strictest of its sources allows. Documents of a source are drawn in the
    order of a hash of id and seed; only the last one drawn overshoots its quota, by less than its length.

    Null and empty texts, and null sources or sources without target, are not used. A target that is null
    or not positive counts as 0, max_repeats that is null as 1. Repeated rows are equal texts. Targets that
    are one source in different spellings add up their shares and take the smaller cap. Extra columns are ignored.
    """
    goal = targets.select(canonical_source("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("m")).where("source is not null and w > 0").groupBy("source").agg(F.sum("w").alias("w"), F.min("m").alias("m"))
    rows_ = goal.collect()
    shares, caps = {r[0]: r[1] for r in rows_}, {r[0]: r[2] for r in rows_}
    counted = cut(texts(docs, sorted(shares), id_col, text_col, source_col, path, vocabulary))
    by = counted.groupBy(F.array_join("sources", "|").alias("pattern")).agg(F.sum("tokens").cast("long")).collect()
    supply = {r[0]: (r[1], r[0].split("|")) for r in by}
    total, flow = largest_total(supply, caps, shares)
    if total_tokens is not None and total_tokens < total:
        live = {s for (_, s) in flow}
        norm = sum(shares[s] for s in live)
        flow = min_cost_flow(supply, caps, {s: int(total_tokens * shares[s] / norm) for s in live})
    return draw(counted, supply, flow, seed)


def texts(docs: DataFrame, sources: list[str], id_col: str, text_col: str, source_col: str, path: str, vocabulary: str) -> DataFrame:
    """(doc_id, sources, tokens): one row for each distinct text with the sources that hold it.

    Tokens are counted where the text is read, so that only its fingerprint is shuffled.
    """
    src = canonical_source(source_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), src.alias("source"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("source").isin(sources) & F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    rows = rows.withColumn("print", F.unhex(F.md5("text"))).withColumn("chars", F.length("text"))
    n = count_tokens(rows, ["doc_id", "source", "print", "chars"], "text", path, vocabulary)
    return n.groupBy("print", "chars").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_set("source")).alias("sources"), F.max("tokens").alias("tokens")).where("tokens > 0").select("doc_id", "sources", "tokens")


def draw(counted: DataFrame, supply: dict[str, tuple[int, list[str]]], flow: dict[tuple[str, str], int], seed: int) -> DataFrame:
    """Seeded choice of documents for each flow.

    The tokens that a pattern gives to its sources are laid one after another along the hash order of its
    documents, round after round: a document is used once for each time its stretch is covered. Running
    sums are exact without a sort of a whole source: cells of the hash are summed first.
    """
    spark = counted.sparkSession
    spans, used = [], {}
    for (p, s), x in sorted(flow.items()):
        if x:
            spans.append((p, s, used.get(p, 0), used.get(p, 0) + x, supply[p][0]))
            used[p] = used.get(p, 0) + x
    plan = spark.createDataFrame(spans, "pattern string, source string, lo long, hi long, round long")
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    d = counted.select("doc_id", "tokens", F.array_join("sources", "|").alias("pattern"), h.alias("h")).withColumn("cell", F.floor(F.col("h") / ((1 << 40) // CELLS)))
    cells = d.groupBy("pattern", "cell").agg(F.sum("tokens").alias("t"))
    w = W.partitionBy("pattern").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("pattern", "cell", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))
    inner = W.partitionBy("pattern", "cell").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(cells, ["pattern", "cell"]).withColumn("at", F.col("before") + F.col("inside"))
    # the document begins at `at`, `at` + round, ...; it is used for a source once for each beginning in [lo, hi)
    first = lambda x: F.ceil((F.col(x) - F.col("at")) / F.col("round"))
    d = d.join(F.broadcast(plan), "pattern").withColumn("repeats", (F.greatest(first("hi"), F.lit(0)) - F.greatest(first("lo"), F.lit(0))).cast("int"))
    return d.where("repeats > 0").select("doc_id", "source", "repeats", "tokens")


def shares(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) for each target and the sample's sources."""
    goal = targets.select(canonical_source("source").alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    got = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    all_ = W.partitionBy()
    got = goal.join(got, "source", "full").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return got.select(
        "source", "target_share", F.round(F.col("tokens") / F.sum("tokens").over(all_), 6).alias("actual_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
    )
