"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session (tests)
    gets one in its temp folder; on a cluster no such folder would do, so nothing is written there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="docproof-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting while something is written; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write(df: DataFrame, name: str) -> str:
    """Writes ``df`` as a table into the shared folder and tells where."""
    path = f"{shared_dir(df.sparkSession)}/docproof/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: later steps start from the files, so a lost executor costs one task and not the whole
    history."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def spread(table: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """Deals a written table over the cluster before work that makes many rows of each."""
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows_per_task))
    return table.repartition(tasks)


def plain(text) -> F.Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with its own columns, without the rows whose id and text's hash are in ``gone`` (id, place)."""
    gone = save(gone.distinct(), "gone").select(F.col("id").alias("__gone_id"), F.col("place").alias("__gone_place"))
    return docs.join(gone, (docs[id_col] == gone["__gone_id"]) & (F.xxhash64(plain(docs[text_col])) == gone["__gone_place"]), "left_anti")


def release() -> None:
    """Hands what a task has freed back to the system. Python workers stay for later stages, and would keep it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)
