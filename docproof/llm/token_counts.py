"""Token counts as rollups that deltas maintain.

A feed of signed rows - (key, source, lang, tokenizer, sign, tokens): +1 for an insert, -1 for a delete, and both for a
revised count - is summed a batch at a time to (source, lang, tokenizer) -> documents, tokens, with a partial aggregate
before the shuffle, so a hot source sends one row a task. A batch's sums go to a folder of their own that is written
whole, and then committed by a marker that bears the batch's name. A marker is moved to its name only where none is, which file
systems decide for one of several writers; the others' sums are never read. So a batch counts once, however often it is
delivered and whoever delivers it meanwhile, and one that was broken off is written anew. The rollup is the sum of the committed
batches; sums are additive, so batches may come in any order. ``compact`` folds the committed batches into one base, whose
marker names what it holds; ``vacuum`` deletes folders that no marker needs, when no reader is at work. Markers stay, a
small file a batch, as a record of what was delivered.

Defined results: null text counts as empty (0 tokens); null sources and languages are groups of their own; repeated rows
count each; groups whose documents and tokens are both zero disappear.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote, unquote

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm.common import plain
from docproof.llm.encoders import byte_bpe_counter

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(docs: DataFrame, ranks: str, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """``docs`` with the column ``name``: the number of tokens under the byte-level BPE ranks in that file."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(byte_bpe_counter(ranks)).astype("int64")

    return docs.withColumn(name, run(plain(text_col)))


class Rollup:
    """A rollup in ``folder`` of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(f"{self.folder}/commits")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _markers(self) -> dict[str, dict]:
        """The markers that count: name -> part, its folder of sums, and folded, the markers that it replaces. Of those
        that are folded only the names are read."""
        names = sorted((x for x in self._names() if not x.startswith((".", "_"))), key=lambda x: (not x.startswith("base-"), x))
        found, folded = {}, set()
        for some in ([x for x in names if x.startswith("base-")], [x for x in names if not x.startswith("base-")]):
            paths = [f"{self.folder}/commits/{x}" for x in some if x not in folded]
            rows = self.spark.read.text(paths, wholetext=True).select("value").collect() if paths else []
            new = {m["name"]: m for m in (json.loads(r["value"]) for r in rows)}
            folded |= {x for m in new.values() for x in m["folded"]}
            found |= new
        return {k: m for k, m in found.items() if k not in folded}

    def _commit(self, name: str, part: str, folded: list[str]) -> bool:
        """Whether the marker took its name; only the first of several can."""
        temp, final = self._path(f"{self.folder}/_pending/{uuid.uuid4().hex}"), self._path(f"{self.folder}/commits/{name}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"name": name, "part": part, "folded": folded}).encode()))
        out.close()
        context = self.spark.sparkContext
        move = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(temp, final, context._gateway.new_array(move, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._fs.delete(temp, False)
            return False
        return True

    @staticmethod
    def _name(batch: str) -> str:
        return "batch-" + quote(batch, safe="").replace(".", "%2E").replace("_", "%5F")

    def batches(self) -> set[str]:
        return {unquote(x.removeprefix("batch-")) for x in self._names() if x.startswith("batch-")}

    def apply(self, batch: str, feed: DataFrame) -> bool:
        """Adds a batch of signed rows, unless it was committed before or meanwhile; tells whether it did."""
        if self._fs.exists(self._path(f"{self.folder}/commits/{self._name(batch)}")):
            return False
        part = uuid.uuid4().hex
        sums = feed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        sums.write.parquet(f"{self.folder}/sums/{part}")
        return self._commit(self._name(batch), part, [])

    def read(self) -> DataFrame:
        return self._sum(self._markers())

    def _sum(self, markers: dict[str, dict]) -> DataFrame:
        if not markers:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*sorted(f"{self.folder}/sums/{m['part']}" for m in markers.values()))
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents != 0 or tokens != 0")

    def compact(self) -> bool:
        """Folds all committed batches into one part. The base's name tells what it starts from, so of two that fold the
        same at once one wins."""
        markers = self._markers()
        if len(markers) < 2:
            return False
        bases = [x for x in self._names() if x.startswith("base-")]
        part = uuid.uuid4().hex
        self._sum(markers).write.parquet(f"{self.folder}/sums/{part}")
        return self._commit(f"base-{len(bases):08d}", part, sorted(markers))

    def vacuum(self) -> None:
        """Deletes sums that no marker needs any more and markers that were never moved."""
        needed = {m["part"] for m in self._markers().values()}
        for folder in ("sums", "_pending"):
            at = self._path(f"{self.folder}/{folder}")
            for found in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if found.getPath().getName() not in needed:
                    self._fs.delete(found.getPath(), True)


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(rows: DataFrame, was: str, now: str) -> DataFrame:
    """Takes the old count back and adds the new one."""
    both = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col(was).alias("tokens")), F.struct(F.lit(1).alias("sign"), F.col(now).alias("tokens"))))
    return rows.select(*KEYS, both.alias("x")).select(*KEYS, "x.sign", "x.tokens")
