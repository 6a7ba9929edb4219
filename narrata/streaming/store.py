"""Stored tables with idempotent commits: each batch is written aside and put in place by one rename, once.

A batch whose number is already there changes nothing, so a stream may repeat it, and two writers of the same batch
can't both succeed. With keep="first" a key's first row stays for good, as in a cache of results; with keep="last" a
later batch's row takes its place, and earlier ones stay in their batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], keep: str = "first"):
        if keep not in ("first", "last"):
            raise ValueError(f"keep is first or last, not {keep!r}")
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys, keep
        self.schema = spark.createDataFrame([], schema).schema
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """The numbers of the batches that are there."""
        fs = self._at("x").getFileSystem(self._conf)
        found = fs.globStatus(self._at("batch=*"))
        return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in found or [])

    def read(self) -> DataFrame:
        """The row of each key, with the batch that it is from."""
        found = self.batches()
        kind = StructType([*self.schema.fields, StructField("batch", LongType())])
        if not found:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in found])
        if self.keep == "first":
            return rows  # commit() leaves one row a key
        w = Window.partitionBy(*self.keys).orderBy(F.desc("batch"))
        return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")

    def commit(self, batch: int, rows: DataFrame) -> bool:
        """Puts in a batch; False if it was there already. Of a key's rows in one batch, the least by all columns counts."""
        if batch in self.batches():
            return False
        rest = [f.name for f in self.schema if f.name not in self.keys]
        one = rows.select(*self.schema.names).groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, "_r.*").select(*self.schema.names)
        if self.keep == "first":
            one = one.join(self.read().select(*self.keys), self.keys, "left_anti")
        aside = f"_aside/{uuid.uuid4().hex}"
        one.write.parquet(f"{self.path}/{aside}")
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("x").toUri(), self._conf).rename(self._at(aside), self._at(f"batch={batch}"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def sink(self, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: commits what prepare makes of each batch, under the batch's own number."""
        return lambda rows, batch: (self.commit(batch, prepare(rows)), None)[1]


def upserted_items(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """target, reason, status, candidates for wanted (target, reason, candidates) over what is stored of them.

    What isn't stored is pending. A resolved item is opened again, a deferred one stays so, and candidates are
    replaced where there are new ones.
    """
    old = stored.select("target", "reason", F.col("status").alias("_was"), F.col("candidates").alias("_had"))
    both = wanted.join(old, ["target", "reason"], "left")
    status = F.when(F.col("_was") == "DEFERRED", "DEFERRED").otherwise("PENDING")
    return both.select("target", "reason", status.alias("status"), F.coalesce("candidates", "_had", F.lit("{}")).alias("candidates"))


def resolved_items(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """The items of targets that aren't resolved yet, resolved."""
    open_ = stored.filter("status <> 'RESOLVED'").join(targets.select("target").distinct(), "target", "left_semi")
    return open_.select("target", "reason", F.lit("RESOLVED").alias("status"), "candidates")
