"""The k most similar vectors of every vector, with balanced posting lists.

The number of lists grows with the number of vectors. Centroids are fitted on a bounded sample so that
their lists are about equally long; where there must be more lists than a sample can carry, those centroids
become regions, and each region fits the centroids of its lists on its own bounded sample. Every vector is
stored in the list of its nearest centroid and, at a boundary, in those that are nearly as near. Centroids
are found by best-first search over an in-memory neighbour graph, and as a query a vector visits the
lists whose centroid distance is within a ratio of the nearest. Equal vectors are searched once. Postings
are counted before lists are compared, and a list that is long is compared as a grid of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.session import cut

#: Vectors a list should hold, vectors the first centroids are fitted on, sampled vectors for each of these and for each centroid of a region.
LIST_SIZE, SAMPLE, PER_CENTROID, PER_REGION_CENTROID = 300, 20_000, 4, 16
#: Rows of a region that one task looks up; a region with more is looked up by several.
REGION_ROWS = 50_000
#: Regions a vector visits up to this ratio, at most so many, where lists are found by region.
REGION_RATIO, REGION_MOST = 1.15, 6
#: Vectors stored up to this ratio of the nearest centroid's distance, in at most so many lists.
STORE_RATIO, STORE_MOST = 1.04, 3
#: Lists visited up to this ratio, at most so many; a vector that is a centroid visits the next ones too.
VISIT_RATIO, VISIT_MOST, VISIT_LEAST = 1.10, 10, 3
#: Rows of one list compared in one task; longer lists are compared block by block.
BLOCK = 4096


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) with vec as 4-byte floats: ``dim`` finite numbers that are not all zero."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(1)
            flat = vecs.flatten()
            m = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim) if len(flat) else np.empty((0, dim), np.float32)
            if len(m) != b.num_rows:
                raise ValueError("the filter on size has failed")
            ok = np.isfinite(m).all(axis=1) & m.any(axis=1)
            raw = pa.array([r.tobytes() for r in m[ok]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), raw], names=["id", "vec"])

    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
        .where((F.size("v") == dim) & F.col("id").isNotNull())
        .withColumn("v", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")))
        .where("v is not null")
        .mapInArrow(pack, "id long, vec binary")
    )


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m.astype(np.float64), axis=1)
    return (m / n[:, None]).astype(np.float32)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means whose assignment is charged for full lists, so that lists stay balanced."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    fill = np.full(lists, len(x) / lists)
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        charge = (0.02 * np.log(np.maximum(fill, 1) * lists / len(x))).astype(np.float32)
        for i in range(0, len(x), 8192):
            near[i : i + 8192] = np.argmax(x[i : i + 8192] @ c.T - charge, axis=1)
        fill = np.bincount(near, minlength=lists).astype(float)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(x[order].astype(np.float64), at, axis=0)
        c[near[order][at]] = _unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, 1.0))
        # an empty list takes a vector out of the fullest one
        empty = np.flatnonzero(fill == 0)
        if len(empty):
            big = order[np.isin(near[order], np.argsort(-fill)[: max(1, len(empty) // 8)])]
            c[empty] = x[rng.choice(big, len(empty))]
    return c


class CentroidGraph:
    """Each centroid linked to its nearest ones; search is best-first from a few entry points, in batches."""

    def __init__(self, c: np.ndarray, degree: int = 24, beam: int = 24) -> None:
        self.c, n = c, len(c)
        self.beam = min(beam, n)
        d = min(degree, n - 1)
        near = []
        for i in range(0, n, 1024):
            s = c[i : i + 1024] @ c.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            near.append(np.argpartition(-s, d - 1, axis=1)[:, :d] if d else np.empty((len(s), 0), int))
        self.near = np.concatenate(near)
        rng = np.random.default_rng(5)
        if n > d + 4:  # a few long links keep the graph connected
            self.near = np.concatenate([self.near, rng.integers(0, n, (n, 4))], axis=1)
        self.entries = rng.choice(n, min(n, max(8, int(math.sqrt(n)))), replace=False)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, cosine) of the k best for each row of q, best first; -1 where there are fewer."""
        n, m = len(self.c), len(q)
        beam = max(self.beam, min(k, n))
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)[:, None]
        s = q @ self.c[self.entries].T
        seen[:, self.entries] = True
        ids = np.full((m, beam), -1)
        cos = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids, cos, done = self._keep(ids, cos, done, np.broadcast_to(self.entries, s.shape), s, beam)
        while True:
            open_ = np.where(done, -np.inf, cos)
            pick = np.argsort(-open_, axis=1)[:, :3]
            live = np.take_along_axis(open_, pick, 1) > -np.inf
            if not live.any():
                break
            act = np.flatnonzero(live.any(axis=1))
            pick, live, r = pick[act], live[act], act[:, None]
            done[r, pick] = True
            nb = self.near[np.where(live, ids[r, pick], ids[r, pick[:, :1]])].reshape(len(act), -1)
            fresh = ~seen[r, nb]
            seen[r, nb] = True
            # a centroid that two of the picks link to counts once
            o = np.argsort(nb, axis=1, kind="stable")
            sorted_nb = np.take_along_axis(nb, o, 1)
            first = np.ones_like(fresh)
            np.put_along_axis(first, o[:, 1:], sorted_nb[:, 1:] != sorted_nb[:, :-1], 1)
            v = np.einsum("ijd,id->ij", self.c[nb], q[act])
            v[~(fresh & first)] = -np.inf
            ids[act], cos[act], done[act] = self._keep(ids[act], cos[act], done[act], nb, v, beam)
        del rows
        o = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        return np.where(np.take_along_axis(cos, o, 1) > -np.inf, np.take_along_axis(ids, o, 1), -1), np.take_along_axis(cos, o, 1)

    @staticmethod
    def _keep(ids, cos, done, new_ids, new_cos, beam):  # noqa: ANN001, ANN205
        ids = np.concatenate([ids, new_ids], axis=1)
        cos = np.concatenate([cos, new_cos], axis=1)
        done = np.concatenate([done, np.zeros(new_ids.shape, bool)], axis=1)
        o = np.argpartition(-cos, beam - 1, axis=1)[:, :beam] if cos.shape[1] > beam else np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
        ids, cos, done = (np.take_along_axis(x, o, 1) for x in (ids, cos, done))
        return ids, cos, done | (cos == -np.inf)


def _choose(ids: np.ndarray, cos: np.ndarray, ratio: float, most: int, least: int = 1) -> np.ndarray:
    """Which of the found lists are within the distance ratio of the nearest, at most so many; the first ``least`` in any case."""
    d = np.sqrt(np.maximum(0.0, 2 - 2 * cos.astype(np.float64)))
    ok = (ids >= 0) & (d <= np.maximum(ratio * d[:, :1], d[:, :1] + 1e-6))
    ok[:, most:] = False
    ok[:, :least] = ids[:, :least] >= 0
    return ok


def all_neighbours(
    df: DataFrame,
    k: int = 5,
    dim: int = 96,
    min_cosine: float | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    list_size: int = LIST_SIZE,
    sample: int = SAMPLE,
    visit_ratio: float = VISIT_RATIO,
    visit_most: int = VISIT_MOST,
) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other rows of every row, best first.

    Cosines in double precision, rounded to 9 decimals; ties go to the smaller id. Rows whose vector is
    null, has another length than ``dim``, a null or non-finite number, or only zeros, are left out, both
    as queries and as neighbours; so are null ids. Ids must be unique: rows that repeat an id count as rows
    of their own. With fewer than k other rows there are fewer neighbours. ``min_cosine`` leaves out pairs
    below it. Extra columns are ignored.

    Approximate: a neighbour is missed if no list is shared. Lists are as many as vectors / ``list_size``, however many
    those are. Two vectors that are equal byte by byte share
    one search, so a vector that a third of all rows hold costs no more than another.

    The first centroids are fitted on at most ``sample`` rows, those of a region on PER_REGION_CENTROID rows for each
    of its lists; every row is indexed.
    """
    vecs = usable(df, id_col, vec_col, dim)
    keep = k + 1
    w = W.partitionBy("vec").orderBy("id")
    top = vecs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    groups = top.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    spark = df.sparkSession
    n = vecs.count()
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, rank int")
    part = max(1, math.ceil(min(1.0, 1.2 * sample / n) * 1_000_000))
    got = vecs.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part).select("vec").limit(sample).toArrow()
    x = _unit(_matrix(got.column(0).to_pylist(), dim)) if got.num_rows else _unit(np.ones((1, dim), np.float32))
    lists = max(1, round(n / list_size))
    carry = max(1, len(x) // PER_CENTROID)
    rules = (visit_ratio, visit_most)
    if lists <= carry:
        posted = _post(groups, fit_centroids(x, lists), dim, *rules)
    else:
        # so many regions that the lists of one are as many as there are regions, as far as the sample carries them
        regions = min(carry, math.ceil(math.sqrt(lists)))
        posted = _post_by_region(groups, fit_centroids(x, regions), dim, list_size, *rules)
    posted = cut(posted)
    # lists as they have come out: one that is long is compared as a grid of blocks in many tasks
    sizes = posted.groupBy("list").count().where(F.col("count") > BLOCK).select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("grid"))
    posted = posted.join(sizes, "list", "left").withColumn("grid", F.coalesce("grid", F.lit(1)))
    own_block = F.pmod(F.xxhash64("vec"), F.col("grid"))
    meets = F.transform(F.sequence(F.lit(0), F.col("grid") - 1), lambda o: F.least(own_block, o.cast("long")) * F.col("grid") + F.greatest(own_block, o.cast("long")))
    posted = posted.select("list", F.explode(meets).alias("cell"), "stored", "vec", "ids")
    found = posted.groupBy("list", "cell").applyInArrow(_compare_list(k, dim, min_cosine), "id long, near array<struct<c:double,i:long>>")

    own = groups.where(F.size("ids") > 1).select(F.explode("ids").alias("id"), "ids").select("id", F.explode(F.slice("ids", 1, keep)).alias("i")).where("id != i")
    own = own.select("id", F.array(F.struct(F.lit(1.0).alias("c"), F.col("i"))).alias("near"))
    tails = (
        vecs.select("id", F.md5("vec").alias("key"))
        .join(groups.where(F.size("ids") == keep).select(F.md5("vec").alias("key"), F.slice("ids", 1, k).alias("ids"), F.element_at("ids", keep).alias("last")), "key")
        .where("id > last")
        .select("id", F.transform("ids", lambda i: F.struct(F.lit(1.0).alias("c"), i.alias("i"))).alias("near"))
    )
    best = (
        found.unionByName(own).unionByName(tails)
        .groupBy("id")
        .agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        .select("id", F.posexplode(F.slice(F.array_sort(F.transform("near", lambda x: F.struct((-x["c"]).alias("c"), x["i"].alias("i")))), 1, k)).alias("at", "x"))
    )
    return best.select("id", F.col("x.i").alias("neighbour"), (-F.col("x.c")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)


POSTING = "list long, stored boolean, vec binary, ids array<long>"


def _lookup(graph: CentroidGraph, raw: list[bytes], dim: int, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, is it stored there) for the lists that each vector visits."""
    ids, cos = graph.search(_unit(_matrix(raw, dim)), max(most, STORE_MOST))
    visit = _choose(ids, cos, max(ratio, STORE_RATIO), max(most, STORE_MOST), VISIT_LEAST)
    store = _choose(ids, cos, STORE_RATIO, STORE_MOST)
    r, c = np.nonzero(visit)
    return r, ids[r, c].astype(np.int64), store[r, c]


def _post(groups: DataFrame, centroids: np.ndarray, dim: int, ratio: float, most: int) -> DataFrame:
    """The postings of all vectors; the centroids go to every task, as many as the sample carries."""
    cents = groups.sparkSession.sparkContext.broadcast(centroids)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(cents.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                r, c, stored = _lookup(graph, part.column(0).to_pylist(), dim, ratio, most)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(stored), part.column(0).take(take), part.column(1).take(take)], names=["list", "stored", "vec", "ids"])

    return groups.select("vec", "ids").mapInArrow(post, POSTING)


def _post_by_region(groups: DataFrame, regions: np.ndarray, dim: int, list_size: int, ratio: float, most: int) -> DataFrame:
    """The postings of all vectors where no task could hold the centroids of all lists.

    A vector goes to the few regions that are nearly as near as its nearest. Each region fits its centroids on
    a sample of the vectors stored there, PER_REGION_CENTROID for each list it needs, and its vectors are looked up by as
    many tasks as their counted number asks for. Only then do the rules for lists choose among what a
    vector found in all its regions, without carrying the vectors along.
    """
    own = groups.withColumn("gid", F.element_at("ids", 1))
    routed = cut(_post(own.select("vec", F.array("gid").alias("ids")), regions, dim, REGION_RATIO, REGION_MOST).select(F.col("list").alias("region"), "stored", F.element_at("ids", 1).alias("gid")))
    load = routed.groupBy("region").agg(F.count_if("stored").alias("homes"), F.ceil(F.count("*") / REGION_ROWS).cast("int").alias("salts"))
    load = cut(load.withColumn("wanted", F.greatest(F.lit(1), F.round(F.col("homes") / list_size).cast("int"))))
    drawn = F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < F.ceil(1_000_000 * F.least(F.lit(1.0), PER_REGION_CENTROID * F.col("wanted") / F.col("homes")))
    sampled = routed.where("stored").join(load, "region").where(drawn).select("region", "wanted", "gid").join(own.select("gid", "vec"), "gid")

    def fit(t: pa.Table) -> pa.Table:
        c = fit_centroids(_unit(_matrix(t.column("vec").to_pylist(), dim)), t.column("wanted")[0].as_py())
        return pa.table({"region": pa.array([t.column("region")[0].as_py()], pa.int64()), "cents": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    cents = sampled.groupBy("region").applyInArrow(fit, "region long, cents binary")
    spread = load.join(cents, "region").select(F.col("region").alias("r"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), "cents")
    salted = routed.join(load, "region").select("region", F.pmod(F.xxhash64("gid"), F.col("salts").cast("long")).cast("int").alias("salt"), "gid").join(own.select("gid", "vec"), "gid")
    schema = pa.schema([("gid", pa.int64()), ("list", pa.int64()), ("far", pa.float32())])

    def look(rows: pa.Table, centroids: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        region = rows.column("region")[0].as_py() << 32
        gid = rows.column("gid").to_numpy()
        if not centroids.num_rows:  # none of its few vectors was drawn: one list
            return pa.table([pa.array(gid), pa.array(np.full(len(gid), region)), pa.array(np.zeros(len(gid), np.float32))], schema=schema)
        graph = CentroidGraph(np.frombuffer(centroids.column("cents")[0].as_py(), np.float32).reshape(-1, dim))
        out = []
        for i in range(0, rows.num_rows, 1024):
            ids, cos = graph.search(_unit(_matrix(rows.column("vec").slice(i, 1024).to_pylist(), dim)), max(most, STORE_MOST))
            r, c = np.nonzero(_choose(ids, cos, max(ratio, STORE_RATIO), max(most, STORE_MOST), VISIT_LEAST))
            far = np.sqrt(np.maximum(0.0, 2 - 2 * cos[r, c]))
            out.append(pa.table([pa.array(gid[i + r]), pa.array(ids[r, c].astype(np.int64) + region), pa.array(far.astype(np.float32))], schema=schema))
        return pa.concat_tables(out)

    met = salted.groupBy("region", "salt").cogroup(spread.groupBy("r", "s")).applyInArrow(look, "gid long, list long, far float")
    w = W.partitionBy("gid")
    met = met.withColumn("least", F.min("far").over(w)).withColumn("place", F.row_number().over(w.orderBy("far", "list")))
    near = lambda r, m: (F.col("far") <= F.greatest(F.col("least") * r, F.col("least") + 1e-6)) & (F.col("place") <= m)
    met = met.where(near(max(ratio, STORE_RATIO), max(most, STORE_MOST)) | (F.col("place") <= VISIT_LEAST))
    return met.select("gid", "list", near(STORE_RATIO, STORE_MOST).alias("stored")).join(own, "gid").select("list", "stored", "vec", "ids")


def _compare_list(k: int, dim: int, least: float | None):  # noqa: ANN202
    """The best k of one posting list for each vector in it, in both directions, block by block."""
    schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.struct([("c", pa.float64()), ("i", pa.int64())])))])

    def run(t: pa.Table) -> pa.Table:
        m = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
        m /= np.linalg.norm(m, axis=1)[:, None]
        f = m.astype(np.float32)
        ids = t.column("ids").to_pylist()
        stored = t.column("stored").to_numpy()
        n = len(m)
        floor = -2.0 if least is None else least - 1e-5
        want = k + 3
        cand: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i in range(0, n, BLOCK):
            for j in range(0, n, BLOCK):
                s = f[i : i + BLOCK] @ f[j : j + BLOCK].T
                # at least one of the two must be stored here
                s[np.ix_(~stored[i : i + BLOCK], ~stored[j : j + BLOCK])] = -3
                if i == j:
                    np.fill_diagonal(s, -3)
                w = min(want, s.shape[1])
                o = np.argpartition(-s, w - 1, axis=1)[:, :w]
                v = np.take_along_axis(s, o, 1)
                r, c = np.nonzero(v > floor)
                if len(r):
                    a, b = r + i, o[r, c] + j
                    exact = np.round(np.einsum("ij,ij->i", m[a], m[b]), 9)
                    for x, y, e in zip(a.tolist(), b.tolist(), exact.tolist(), strict=True):
                        if least is None or e >= least:
                            cand[x].append((e, y))
        out_id, out_near = [], []
        for x, near in enumerate(cand):
            if not near:
                continue
            # a group of equal vectors stands for its smallest ids; k of them are enough for anyone
            pairs = sorted(((-c, i) for c, y in near for i in ids[y][:k]))[:k]
            row = [{"c": -c, "i": i} for c, i in pairs]
            for own in ids[x]:
                out_id.append(own)
                out_near.append(row)
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_near, schema.field("near").type)], schema=schema)

    return run


def similar_pairs(df: DataFrame, least: float = 0.78, k: int = 5, **kw: object) -> DataFrame:
    """(id_a, id_b), id_a < id_b: cosine at least ``least``, one among the k most similar of the other."""
    near = all_neighbours(df, k=k, min_cosine=least, **kw)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def brute_force(ids: list[int], vecs: list, k: int, dim: int) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for tests and for measuring recall."""
    ok = [(i, np.asarray(v, np.float32).astype(np.float64)) for i, v in zip(ids, vecs, strict=True) if v is not None and len(v) == dim and all(x is not None for x in v)]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    if not ok:
        return {}
    m = np.array([v / np.linalg.norm(v) for _, v in ok])
    s = np.round(m @ m.T, 9)
    out = {}
    for a, (i, _) in enumerate(ok):
        row = sorted(((-s[a, b], j) for b, (j, _) in enumerate(ok) if b != a))[:k]
        out[i] = [(j, -c) for c, j in row]
    return out


NEIGHBOURS = T.StructType([T.StructField("id", T.LongType()), T.StructField("neighbour", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("rank", T.IntegerType())])
