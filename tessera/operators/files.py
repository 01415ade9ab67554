"""Search in files: grep, glob, exclusion, windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import glob_regex


def excluded(path: Column, names: list[str], anchored: list[str] = ()) -> Column:  # type: ignore[assignment]
    """Any component among the names, or the path is or lies below an anchored entry; byte-wise."""
    out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)
    for a in anchored:
        a = a.strip("/")
        out = out | (path == a) | F.startswith(path, F.lit(a + "/"))
    return F.coalesce(out, F.lit(False))


def lines(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, line_no from 1, line); binary texts, with a NUL in the first 8192 characters, are skipped."""
    t = df.where(F.col(text).isNotNull() & ~F.contains(F.substring(text, 1, 8192), F.lit("\0")))
    return t.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).select("id", (F.col("at") + 1).alias("line_no"), "line")


def grep(df: DataFrame, id_col: str, pattern: str, text: str = "text") -> DataFrame:
    """Lines that match a regular expression. Texts without a match anywhere are passed over before the split."""
    return lines(df.where(F.col(text).rlike("(?m)" + pattern)), id_col, text).where(F.col("line").rlike(pattern))


def grep_counts(df: DataFrame, id_col: str, pattern: str, text: str = "text") -> DataFrame:
    return grep(df, id_col, pattern, text).groupBy("id").agg(F.count("*").alias("matches"))


def context_windows(hits: DataFrame, before: int, after: int) -> DataFrame:
    """(id, first_line, last_line, hits): windows around hits, those that touch or overlap merged."""
    h = hits.select("id", F.greatest(F.col("line_no") - before, F.lit(1)).alias("a"), (F.col("line_no") + after).alias("b"))
    w = W.partitionBy("id").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    h = h.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return h.groupBy("id", "island").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.count("*").alias("hits")).drop("island")


def glob_match(df: DataFrame, path: str, pattern: str, prefix: str = "") -> DataFrame:
    out = df.where(F.startswith(F.col(path), F.lit(prefix))) if prefix else df
    return out.where(F.col(path).rlike(glob_regex(pattern)))


def read_window(df: DataFrame, id_col: str, first: int, count: int, text: str = "text") -> DataFrame:
    return lines(df, id_col, text).where(F.col("line_no").between(first, first + count - 1))
