"""Where streams keep their logs and results: the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tessera.session import shared_folder


def folder(spark: SparkSession) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
