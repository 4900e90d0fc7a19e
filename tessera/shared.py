"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The local folders made for applications without a shared one.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (tests) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        found = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tessera/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "step") -> DataFrame:
    """df written to the shared folder and read again, so that loops keep no lineage and survive lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
