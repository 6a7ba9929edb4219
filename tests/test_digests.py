"""Digests of tables against sums of Python's whole numbers."""

import hashlib

from pyspark.sql import functions as F

from narrata.functions import digests
from narrata.plans.registry import QUERIES


def wrapped(rows):
    return (sum(int(hashlib.sha256(r.encode()).hexdigest()[:12], 16) for r in rows) + 2**63) % 2**64 - 2**63


def test_digests_of_more_rows_than_a_long_sums_up(spark, tmp_path):
    n = 150_000
    rows = [f"{k}|{k % 999}" for k in range(n)]
    total = sum(int(hashlib.sha256(r.encode()).hexdigest()[:12], 16) for r in rows)
    assert total > 2**63  # what made both queries fail
    t = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 999).alias("o_custkey"))
    t.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["d54_table_digest"](spark, str(tmp_path)).collect()
    assert [(x.n, x.digest) for x in got] == [(n, wrapped(rows))]
    both = QUERIES["x55_layout_equality"](spark, str(tmp_path)).collect()
    assert [(x.n, x.digest, x.layouts) for x in both] == [(n, wrapped(rows), 1)]


def test_digests_of_nulls(spark, tmp_path):
    """A null key makes the row's text null, which SQL's || does too; d54 takes a null customer for an empty one."""
    t = spark.createDataFrame([(1, 5), (2, None), (None, 7)], "o_orderkey long, o_custkey long")
    t.write.parquet(f"{tmp_path}/orders.parquet")
    assert [(x.n, x.digest) for x in QUERIES["d54_table_digest"](spark, str(tmp_path)).collect()] == [(3, wrapped(["1|5", "2|"]))]
    assert [(x.n, x.digest) for x in QUERIES["x55_layout_equality"](spark, str(tmp_path)).collect()] == [(3, wrapped(["1|5"]))]
    none = spark.createDataFrame([], "row string").agg(digests.summed(F.col("row")).alias("x")).collect()
    assert none[0].x is None
