"""Tables between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where that is unset, a local session gets one in
    its temp folder; on a cluster no such folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="docproof-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows starts from its files, and a lost executor costs a task."""
    path = f"{shared_folder(df.sparkSession)}/docproof/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
