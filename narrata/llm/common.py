"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        Path("/tmp/checkpoints").mkdir(exist_ok=True)
        _own_dir.append(tempfile.mkdtemp(dir="/tmp/checkpoints"))
    return _own_dir[0]


def unused(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores in front as it takes to be no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Copies of the rows of a table by whose keys rows that are alike are spread over tasks.
SPREAD = 16


def spread_join(rows: DataFrame, table: DataFrame, key: Column, table_key: str) -> DataFrame:
    """rows left joined with table, which has a row for each table_key at most; a key's rows go to SPREAD tasks."""
    part, copy = unused("_part", rows, table), unused("_copy", rows, table)
    plain = [c for c, f in zip(named(rows), rows.schema.fields) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    spread = rows.withColumn(part, F.pmod(F.xxhash64(*plain), F.lit(SPREAD)))
    copies = table.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return spread.join(copies, (key == F.col(table_key)) & (F.col(part) == F.col(copy)), "left").drop(part, copy)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(rows: DataFrame, at: str, size: str, out: str, many: int = 4096) -> DataFrame:
    """at and out, the sum of size over the rows with a smaller number at: by groups of `many` numbers, then within each.

    at has whole numbers from 0, each once.
    """
    cut = rows.select(at, size, F.floor(F.col(at) / many).alias("_p"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = cut.groupBy("_p").agg(F.sum(size).alias("_all")).select("_p", F.coalesce(F.sum("_all").over(before(Window.orderBy("_p"))), F.lit(0)).alias("_shift"))
    own = F.coalesce(F.sum(size).over(before(Window.partitionBy("_p").orderBy(at))), F.lit(0))
    return cut.withColumn("_own", own).join(groups, "_p").select(at, (F.col("_own") + F.col("_shift")).alias(out))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
