"""A place in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """Where the setting is unset, a local session gets a temporary folder and a cluster one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}-{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: later jobs start from files that any executor can read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
