"""Where intermediate tables go: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only in a local session that names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wherescore-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/wherescore-{uuid.uuid4().hex}/{label}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the checkpoint folder and read them from there from now on.

    Cuts the lineage like a checkpoint, survives lost executors, and gives later joins the true size
    and later scans only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
