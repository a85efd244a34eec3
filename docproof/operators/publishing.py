"""Extractions published as one: several tables a delivery, seen together or not at all, each document as last delivered.

A delivery writes its tables to folders of its own and is entered in the manifest last, in one small write. Readers take
the deliveries that the manifest names, so a job that dies before leaves nothing to be seen, and one that is run again
writes new folders. A delivery that the manifest already names changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the manifest: a row for each table of each delivery.
MANIFEST = "delivery string, turn long, name string, path string"


class Extractions:
    """Tables by document under a folder. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> list:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()  # a row a table and delivery
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def publish(self, delivery: str, documents: DataFrame, **tables: DataFrame) -> bool:
        """Whether the delivery was new. ``documents`` has one row a document, the other tables any number; all have doc_id."""
        known = self.manifest()
        if any(r["delivery"] == delivery for r in known):
            return False
        turn, rows = max((r["turn"] for r in known), default=0) + 1, []
        for name, table in {"documents": documents, **tables}.items():
            path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            table.write.parquet(path)
            rows.append((delivery, turn, name, path))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return True

    def _all(self, name: str) -> DataFrame:
        parts = [self.spark.read.parquet(r["path"]).withColumn("__turn", F.lit(r["turn"])) for r in self.manifest() if r["name"] == name]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        return whole

    def read(self, name: str) -> DataFrame:
        """The rows of each document from the last delivery that has it, even where that holds none of this table."""
        last = self._all("documents").groupBy(F.col("doc_id").alias("__doc")).agg(F.max("__turn").alias("__last"))
        rows = self._all(name)
        return rows.join(last, rows["doc_id"].eqNullSafe(last["__doc"]) & (F.col("__turn") == F.col("__last"))).drop("__turn", "__doc", "__last")


def rolled_up(docs: DataFrame, fields: DataFrame, checks: DataFrame) -> DataFrame:
    """``docs`` with what an extraction says of each: fields_total, fields_flagged, doc_score (the least score), arithmetic_ok, status and
    the counts of evidence. Fields: doc_id, score, needs_review, proven, code_agrees, code_filled, double_read, agreement, repaired,
    suggested_value, master_match. Checks: doc_id, status, severity."""
    sure = lambda x: F.coalesce(F.col(x), F.lit(False))
    no = lambda x: F.coalesce(~F.col(x), F.lit(False))
    counts = fields.groupBy("doc_id").agg(
        F.count("*").alias("fields_total"), F.count_if("needs_review").alias("fields_flagged"), F.round(F.min("score"), 4).alias("doc_score"),
        F.count_if(sure("code_agrees") & ~sure("code_filled")).alias("qr_confirmed"), F.count_if(sure("code_filled")).alias("qr_filled"), F.count_if(no("code_agrees")).alias("qr_mismatch"), F.count_if(sure("proven")).alias("proven"),
        F.count_if(sure("double_read") & sure("agreement")).alias("zoom_confirmed"), F.count_if(sure("double_read") & no("agreement")).alias("zoom_differs"), F.count_if(sure("repaired")).alias("repaired"),
        F.count("suggested_value").alias("suggestions"), F.count_if(sure("master_match")).alias("master_matches"),
    )
    wrong = checks.where("status = 'fail' and severity = 'error'").select("doc_id").distinct().withColumn("wrong", F.lit(True))
    rows = docs.join(counts, "doc_id", "left").join(wrong, "doc_id", "left")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in counts.columns if c not in ("doc_id", "doc_score")}
    rows = rows.withColumns(numbers | {"doc_score": F.coalesce("doc_score", F.lit(0.0)), "arithmetic_ok": F.col("wrong").isNull()}).drop("wrong")
    return rows.withColumn("status", F.when(F.col("fields_flagged") > 0, "needs_review").otherwise("ready"))
