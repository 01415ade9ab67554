"""Candidate generators for many queries at once: lexical, literal, dense and late interaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import tokens
from tessera.functions.vector import dot, maxsim
from tessera.operators import lexical


def top_k(df: DataFrame, k: int, by: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps only k rows of a group on each side of the shuffle."""
    w = W.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25(corpus: DataFrame, queries: DataFrame, id_col: str, text: Column, query_id: str, query_text: str, k: int = 10, where: Column | None = None, k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
    """(query_id, id, score, rank): BM25 top k of each query over a corpus that has no stored index, terms counted once.

    The filter holds before the cut to k, and term statistics are those of the whole corpus, as in a
    full-text index. Only postings of terms that some query has are built. Documents without tokens count
    in the number of documents. Scores are rounded to 6 decimals; ties go to the smaller id.
    """
    q = queries.select(F.col(query_id).alias(query_id), F.col(query_text).alias(query_text))
    terms = q.select(F.explode(tokens(query_text)).alias("term"))
    index = lexical.build_index(corpus, id_col, text, {} if where is None else {"ok": where}, terms)
    return lexical.search(index, q, query_id, query_text, k, None if where is None else F.col("ok"), k1, b)


#: Characters of needles, and numbers of query vectors, that one pass takes along to every task.
NEEDLE_CHARS, QUERY_NUMBERS = 5_000_000, 8_000_000


def blocks(rows: Iterator, size: Callable[[object], int], most: int) -> Iterator[list]:
    """Rows in blocks of at most ``most`` in size, at least one row each."""
    block, total = [], 0
    for r in rows:
        if block and total + size(r) > most:
            yield block
            block, total = [], 0
        block.append(r)
        total += size(r)
    if block:
        yield block


def like_search(members: DataFrame, needles: DataFrame, query_id: str, needle: str, k: int = 50, columns: tuple[str, ...] = ("name", "docstring")) -> DataFrame:
    """(query_id, id, rank): members that hold the needle literally in a column, case aside, by id.

    Needles go to every task as one automaton, in blocks of at most NEEDLE_CHARS characters, and a pass over the
    members finds all needles of a block at once. Blank needles find nothing.
    """
    n = needles.select(F.col(query_id).alias("qid"), F.lower(F.trim(F.col(needle))).alias("needle")).where("needle != ''")
    hay = members.select("id", F.concat_ws("\0", *(F.lower(F.col(c)) for c in columns)).alias("hay"))
    schema = f"needle string, id {dict(hay.dtypes)['id']}"
    spark = members.sparkSession
    out = None
    for block in blocks((r[0] for r in n.select("needle").distinct().toLocalIterator()), len, NEEDLE_CHARS):
        words = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import ahocorasick

            known = ahocorasick.Automaton()
            for w in words.value:
                known.add_word(w, w)
            known.make_automaton()
            for b in batches:
                hits = [(w, k) for k, text in enumerate(b.column(1).to_pylist()) for w in {w for _, w in known.iter(text)}]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in hits], pa.string()), b.column(0).take(pa.array([k for _, k in hits], pa.int64()))], names=["needle", "id"])

        part = hay.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return top_k(n.select("qid", F.lit(None).cast(dict(hay.dtypes)["id"]).alias("id")).where("false"), k, "qid", [F.asc("id")])
    # every needle keeps its first k before it is given to the queries that ask for it
    first = top_k(out, k, "needle", [F.asc("id")], "at").drop("at")
    return top_k(first.join(n, "needle").select("qid", "id"), k, "qid", [F.asc("id")])


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, allow: DataFrame | None = None, digits: int = 6, same: tuple[str, str] | None = None, other: bool = False) -> DataFrame:
    """(qid, id, score, rank): exact inner-product top k, by products of blocks of vectors with blocks of queries.

    vectors (id, embedding), queries (qid, embedding), allow (id) an allow-list applied before scoring. ``same``
    names a column of the vectors and one of the queries that must be equal; ``other`` leaves a vector out of its own query.
    Queries go to every task in blocks of at most QUERY_NUMBERS numbers, one pass over the vectors for each. Vectors of another
    length than the query's meet no query; null vectors, and null or non-finite numbers, give no score. Ties go to the smaller id.
    """
    v = vectors.where("embedding is not null")
    if allow is not None:
        v = v.join(allow.select("id").distinct(), "id", "left_semi")
    label = F.col(same[0]).cast("string") if same else F.lit(None).cast("string")
    v = v.select("id", F.col("embedding").cast("array<double>").alias("e"), label.alias("l"))
    q = queries.where("embedding is not null").select("qid", F.col("embedding").cast("array<double>").alias("e"), (F.col(same[1]).cast("string") if same else F.lit(None).cast("string")).alias("l"))
    spark = vectors.sparkSession
    schema = f"qid {dict(q.dtypes)['qid']}, id {dict(v.dtypes)['id']}, score double"
    out = None
    for block in blocks(q.toLocalIterator(), lambda r: len(r[1]) or 1, QUERY_NUMBERS):
        sizes = {n: [r for r in block if len(r[1]) == n] for n in {len(r[1]) for r in block}}
        packed = {n: (np.array([r[0] for r in rs], object), np.array([r[1] for r in rs], np.float64), np.array([r[2] for r in rs], object)) for n, rs in sizes.items()}
        sent = spark.sparkContext.broadcast(packed)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                lengths = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                for n, (qid, m, ql) in sent.value.items():
                    at = np.flatnonzero(lengths == n)
                    if not len(at):
                        continue
                    part = b.take(pa.array(at))
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                    ids = np.array(part.column(0).to_pylist(), object)
                    own = np.array(part.column(2).to_pylist(), object)
                    step = max(1, 4_000_000 // len(x))
                    for i in range(0, len(m), step):
                        s = np.round(m[i : i + step] @ x.T, digits) + 0.0
                        ok = np.isfinite(s)
                        if same:
                            mine = ql[i : i + step, None]
                            ok &= (mine == own[None, :]) & (mine != None)  # noqa: E711
                        if other:
                            ok &= qid[i : i + step, None] != ids[None, :]
                        s[~ok] = -np.inf
                        # the best k of the batch, and all that tie with the last of them
                        if s.shape[1] > k:
                            ok &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        r, c = np.nonzero(ok)
                        if len(r):
                            yield pa.RecordBatch.from_arrays([pa.array(qid[i + r].tolist()), pa.array(ids[c].tolist()), pa.array(s[r, c])], names=["qid", "id", "score"])

        got = v.mapInArrow(score, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_k(out, k, "qid", [F.desc("score"), F.asc("id")])


def similar_edges(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float | None = None, digits: int = 6, same: tuple[str, str] | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest other vectors of each query, at least ``least`` near, as edges."""
    out = dense(vectors, queries, k, digits=digits, same=same, other=True)
    return out if least is None else out.where(F.col("score") >= least)


def dense_rescore(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 100, digits: int = 6) -> DataFrame:
    """Candidates (qid, id, rank) scored again; those without vector follow in the order they had."""
    c = candidates.join(vectors.select("id", "embedding"), "id", "left").join(queries.select("qid", F.col("embedding").alias("__q")), "qid", "left")
    c = c.withColumn("dense", F.round(dot("__q", "embedding"), digits))
    w = W.partitionBy("qid").orderBy(F.col("dense").isNull(), F.desc("dense"), "rank", "id")
    return c.select("qid", "id", "dense", F.row_number().over(w).alias("new_rank")).where(F.col("new_rank") <= k)


def late_interaction(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 100, digits: int = 6) -> DataFrame:
    """Candidates (qid, id) by MaxSim over token matrices; those without matrix are dropped."""
    c = candidates.select("qid", "id").join(docs.select("id", "matrix"), "id").join(queries.select("qid", F.col("matrix").alias("__q")), "qid")
    s = c.select("qid", "id", F.round(maxsim("__q", "matrix"), digits).alias("score"))
    return top_k(s, k, "qid", [F.desc("score"), F.asc("id")])


def hydrate(ranked: DataFrame, corpus: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Payload columns joined to ranked ids, after the cut."""
    return ranked.join(corpus.select(F.col(id_col).alias("id"), *columns), "id")
