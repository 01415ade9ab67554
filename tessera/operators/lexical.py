"""A stored full-text index: postings, document lengths, BM25 and the match grammar, for many queries at once.

Terms are counted within the row of their document, so that only counts are shuffled. An index
is written once, sorted by term, and read by as many query batches as there are; a batch reads the postings
of its own terms only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import stem as porter
from tessera.functions.text import tokens
from tessera.session import cut

#: Query terms of a batch that are sent to every task; a larger batch is joined by shuffles.
MAX_QUERY_TERMS = 200_000
#: BM25 constants.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class LexicalIndex:
    """postings (id, term, tf, dl, payload columns), number of documents, mean length; are terms stemmed."""

    postings: DataFrame
    documents: int
    mean_length: float
    stemmed: bool = False

    def write(self, path: str) -> None:
        """Postings sorted by term over the partitions, so that a reader skips the files of other terms; sizes beside them."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.documents, float(self.mean_length), self.stemmed)], "documents long, mean_length double, stemmed boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        r = spark.read.parquet(f"{path}/sizes").first()
        return LexicalIndex(spark.read.parquet(f"{path}/postings"), r[0], r[1], r[2])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row, also where a lambda in ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def term_counts(toks: Column) -> Column:
    """Array of (term, tf) of a token array: the runs of the sorted tokens."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return _let(starts, lambda st: F.transform(st, lambda p, k: F.struct(F.get(s, p - 1).alias("term"), (F.coalesce(F.get(st, k + 1), F.size(s) + 1) - p).alias("tf"))))

    return F.when(F.size(toks) > 0, _let(F.sort_array(toks), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def stem_terms(df: DataFrame, term: str = "term") -> DataFrame:
    """Adds ``stem``: each distinct term is stemmed once."""
    stems = df.select(term).distinct().withColumn("stem", F.get(porter(F.array(term)), F.lit(0)))
    return df.join(stems, term)


def build_index(corpus: DataFrame, id_col: str, text: Column, payload: dict[str, Column] | None = None, vocabulary: DataFrame | None = None, stemmed: bool = False) -> LexicalIndex:
    """The index of a corpus; ``vocabulary`` (term), a query batch's, leaves out postings of other terms but no document from the sizes.

    Ids must be unique. Null and empty texts are documents without terms. ``payload`` columns are carried in each posting.
    """
    extra = payload or {}
    # the tokens are a column of their own, so that they are taken apart once
    docs = corpus.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in extra.items()), tokens(text).alias("toks"))
    docs = docs.select("id", *extra, F.size("toks").cast("int").alias("dl"), term_counts(F.col("toks")).alias("runs"))
    # one row without a term for each document carries its length
    head = F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("tf")))
    rows = docs.select("id", *extra, "dl", F.explode(F.concat(head, "runs")).alias("r")).select("id", *extra, "dl", "r.term", "r.tf")
    if stemmed:
        rows = rows.join(rows.select("term").distinct().withColumn("stem", F.when(F.col("term") != "", F.get(porter(F.array("term")), F.lit(0))).otherwise("")), "term")
        rows = rows.groupBy("id", *extra, "dl", F.col("stem").alias("term")).agg(F.sum("tf").cast("int").alias("tf"))
    if vocabulary is not None:
        known = vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([("",)], "term string")).distinct()
        rows = rows.join(near(known), "term", "left_semi")
    # one shuffle of counted terms by document: scoring and summing stay in its partition
    rows = cut(rows.repartition("id"))
    n, mean = rows.where("term = ''").agg(F.count("*"), F.avg("dl")).first()
    return LexicalIndex(rows.where("term != ''"), n, mean or 0.0, stemmed)


def near(df: DataFrame, most: int = MAX_QUERY_TERMS) -> DataFrame:
    """Marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _top(df: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _parts(index: LexicalIndex, wanted: DataFrame, where: Column | None, k1: float, b: float) -> DataFrame:
    """(qid, id, term, part): what each term of a query adds to a document's score. Term statistics are those of the whole corpus."""
    post = index.postings
    few = near(wanted.select("term").distinct())
    df = post.join(few, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(float(index.documents))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = wanted.join(df, "term").select("qid", "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(index.mean_length))))
    return post.where(where if where is not None else F.lit(True)).join(near(weighed), "term").select("qid", "id", "term", part.alias("part"))


def search(index: LexicalIndex, queries: DataFrame, query_id: str, query_text: str, k: int = 10, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score, rank): BM25 top k of each query over an index, terms counted once; ``where`` is a predicate on payload columns and holds before the cut."""
    q = queries.select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    if index.stemmed:
        q = stem_terms(q).select("qid", F.col("stem").alias("term")).distinct()
    hits = _parts(index, q, where, k1, b).groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    return _top(hits, k)


# the match grammar

#: The words that join terms.
OPERATORS = ("AND", "OR", "NOT")


def _split(words: list[str], by: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in words:
        if w == by:
            out.append([])
        else:
            out[-1].append(w)
    return out


def match_clauses(text: str | None) -> list[list[tuple[str, bool]]]:
    """A query text as alternatives, each a list of (term, must be absent); an alternative holds if all of it does.

    With an operator, words of letters, digits and underscores alone, and every operator between two words it is an expression:
    neighbouring words belong together, then NOT binds, then AND, then OR. Anything else asks for any of its
    words of more than one letter. Without a usable word there is no alternative.
    """
    words = (text or "").split()
    if not words:
        return []
    ops = [w in OPERATORS for w in words]
    infix = not ops[0] and not ops[-1] and not any(a and b for a, b in zip(ops, ops[1:], strict=False))
    if any(ops) and infix and all(re.fullmatch(r"\w+", w, re.A) for w in words):
        out: list[list[tuple[str, bool]]] = []
        for part in _split(words, "OR"):
            variants: list[list[tuple[str, bool]]] = [[]]
            for conjunct in _split(part, "AND"):
                held, *absent = _split(conjunct, "NOT")
                variants = [v + [(t, False) for w in held for t in re.findall("[a-z0-9]+", w.lower())] for v in variants]
                for group in absent:  # not all of a group: one of them is absent
                    terms = [t for w in group for t in re.findall("[a-z0-9]+", w.lower())]
                    variants = [[*v, (t, True)] for v in variants for t in terms] if terms else variants
            out += variants
        return [c for c in out if any(not absent for _, absent in c)]
    return [[(t, False) for t in run] for w in words if len(w) > 1 and (run := re.findall("[a-z0-9]+", w.lower()))]


_CLAUSES = "array<array<struct<term:string,absent:boolean>>>"


def parse_match(text: str) -> Column:
    """The alternatives of a column of query texts."""

    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [[{"term": w, "absent": a} for w, a in c] for c in match_clauses(t)])

    return F.pandas_udf(parse, _CLAUSES)(text)


def match(index: LexicalIndex, queries: DataFrame, query_id: str, query_text: str, k: int = 10, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score, rank): BM25 top k of the documents that a query's expression admits; all terms that need not be absent count.

    The words of one alternative may stand anywhere in the document. On a stemmed index the terms are stemmed.
    """
    q = queries.select(F.col(query_id).alias("qid"), parse_match(query_text).alias("clauses")).where(F.size("clauses") > 0)
    if index.stemmed:
        each = q.select("qid", F.posexplode("clauses").alias("at", "c")).select("qid", "at", F.explode("c").alias("t")).select("qid", "at", "t.term", "t.absent")
        c = stem_terms(each).groupBy("qid", "at").agg(F.collect_list(F.struct(F.col("stem").alias("term"), "absent")).alias("c"))
        q = c.groupBy("qid").agg(F.collect_list("c").alias("clauses"))
    q = cut(q)
    terms = q.select("qid", F.explode(F.flatten("clauses")).alias("t")).groupBy("qid", F.col("t.term").alias("term")).agg(F.min("t.absent").alias("absent"))
    hits = _parts(index, terms.select("qid", "term"), where, k1, b).join(near(terms), ["qid", "term"])
    found = hits.groupBy("qid", "id").agg(F.collect_set("term").alias("held"), F.sum(F.when(F.col("absent"), 0.0).otherwise(F.col("part"))).alias("sum"))
    holds: Callable[[Column], Column] = lambda c: F.forall(c, lambda t: F.array_contains("held", t["term"]) != t["absent"])
    ok = found.join(near(q), "qid").where(F.exists("clauses", holds))
    return _top(ok.select("qid", "id", F.round("sum", 6).alias("score")), k)
