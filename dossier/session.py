"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Results depend on the zone; the others only shape the plan.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # what a task reads takes up to 20 times its compressed size when sorted: merge partitions to
    # 16 MB instead of 64 MB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Bring the runtime settings the jobs rely on into the session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), f"dossier-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write an intermediate result to the shared folder once and go on from the files.

    Used where an expensive or iterated result feeds several consumers: nothing is computed
    twice and a lost executor loses nothing.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
