"""Incremental writes: content identity, multiset diff-merge, reconciliation, partition sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def diff_merge(existing: DataFrame, incoming: DataFrame, by: str, hash_col: str = "content_hash", id_col: str = "id") -> DataFrame:
    """(by, hash, action, existing_id, incoming_id): keep, delete or insert, as multisets of hashes.

    Of each hash min(existing, incoming) rows are kept; existing rows without hash are deleted, incoming ones
    inserted. One shuffle of each side on (by, hash).
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy(by, hash_col).orderBy(id_col)
        return df.where(F.col(hash_col).isNotNull()).select(by, hash_col, F.col(id_col).alias(name), F.row_number().over(w).alias("n"))

    j = numbered(existing, "existing_id").join(numbered(incoming, "incoming_id"), [by, hash_col, "n"], "full")
    action = F.when(F.col("incoming_id").isNull(), "delete").when(F.col("existing_id").isNull(), "insert").otherwise("keep")
    out = j.select(by, F.col(hash_col).alias("hash"), action.alias("action"), "existing_id", "incoming_id")
    nil = F.lit(None)
    gone = existing.where(F.col(hash_col).isNull()).select(by, nil.cast("string").alias("hash"), F.lit("delete").alias("action"), F.col(id_col).alias("existing_id"), nil.cast("long").alias("incoming_id"))
    new = incoming.where(F.col(hash_col).isNull()).select(by, nil.cast("string").alias("hash"), F.lit("insert").alias("action"), nil.cast("long").alias("existing_id"), F.col(id_col).alias("incoming_id"))
    return out.unionByName(gone).unionByName(new)


def changed_groups(existing: DataFrame, incoming: DataFrame, by: str, hash_col: str = "content_hash") -> DataFrame:
    """Groups whose multiset of hashes differs, is new or is gone: what an incremental pass must look at.

    A multiset is known by its size and by two sums over hashes of its members, which no order and no group size matters to.
    """
    part = lambda seed: F.sum(F.xxhash64(F.col(hash_col), F.lit(seed)).cast("decimal(38,0)")).cast("string")
    h = lambda df, n: df.groupBy(by).agg(F.concat_ws(":", F.count(hash_col), part(1), part(2)).alias(n))
    j = h(existing, "old").join(h(incoming, "new"), by, "full")
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).select(by, F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").otherwise("changed").alias("state"))


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, evidence: str, now: str) -> DataFrame:
    """(key, action, id, updated_at): identity kept by key, updated only where the evidence differs, the vanished deleted."""
    j = existing.select(key, "id", F.col(evidence).alias("__old"), "updated_at").join(incoming.select(key, F.col(evidence).alias("__new")).dropDuplicates([key]).withColumn("__in", F.lit(True)), key, "full")
    action = F.when(F.col("id").isNull(), "insert").when(F.col("__in").isNull(), "delete").when(F.col("__old").eqNullSafe(F.col("__new")), "keep").otherwise("update")
    j = j.withColumn("action", action)
    at = F.to_timestamp(F.lit(now))
    return j.select(key, "action", "id", F.when(F.col("action").isin("insert", "update"), at).otherwise(F.col("updated_at")).alias("updated_at"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that should have a vector and have none."""
    return chunks.where("embedded").select("id").join(vectors.select("id").distinct(), "id", "left_anti")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions present in df are replaced; each by a committed write."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
