"""Session defaults and the few helpers that every operator needs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space around an id, name or kind.
SPACE = " \t\n\r\x0b\x0c\x85\xa0\u2003\u200b\u3000\ufeff"


def build_session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE on, UTC, Arrow on)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the Parquet tables in a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is that of ``spark.checkpoint.dir``; only where nothing is set and the master is local (tests on one
    machine) a temporary folder is made, on a cluster that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, made the checkpoint folder of the session where that is not done yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def strip(c: Column | str) -> Column:
    """White space around a value removed, in the JVM."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def blank_to_null(c: Column | str) -> Column:
    """Stripped value, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
