"""Structured Streaming forms: debounce, deduplication, windows, incremental re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_events(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A folder of files as a stream; new files are new events."""
    r = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path)


def watched(stream: DataFrame, path: str, extensions: list[str], ignore: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Events of files with one of the extensions, case aside, outside the ignored folders."""
    out = stream.where(F.lower(F.substring_index(path, ".", -1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    return out.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignore)))) if ignore else out


def debounce(stream: DataFrame, by: str, at: str, gap: str, late: str) -> DataFrame:
    """Bursts: a burst of a key ends after ``gap`` of silence; events later than ``late`` are dropped."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def dedupe(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once; state is held for the watermark's delay only."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, size: str, slide: str, late: str, *by: str) -> DataFrame:
    w = F.window(at, size, slide)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drain(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, once, into Parquet; exactly-once by the checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(to)


def reindex(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Micro-batches to ``apply``: what arrives while one runs is the next, so bursts coalesce."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
