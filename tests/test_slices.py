"""Rows in slices: all of them come, in order, and never more than a slice at a time."""

import pandas as pd
from pyspark.sql import functions as F

from narrata.functions import slices
from narrata.operators import markup
from narrata.sources import epub


def test_slices_hold_all_rows(spark):
    df = spark.range(0, 1000, 1, 1).select("id", F.array(F.struct(F.col("id").alias("x"))).alias("a"))
    make = lambda f: pd.DataFrame({"id": f["id"], "x": [a[0]["x"] for a in f["a"]], "n": len(f)})
    got = slices.mapped(df, make, "id long, x long, n long").collect()
    assert [(r.id, r.x) for r in got] == [(k, k) for k in range(1000)]
    assert max(r.n for r in got) == slices.ROWS
    assert slices.mapped(df.limit(0), make, "id long, x long, n long").count() == 0


def test_archives_go_in_slices(spark, monkeypatch):
    """More archives than a slice holds, broken ones among them; a batch as a whole is never made objects of."""
    seen = []
    monkeypatch.setattr(epub, "mapped", lambda rows, make, schema: seen.append(schema) or slices.mapped(rows, make, schema, 10))
    monkeypatch.setattr(markup, "mapped", lambda rows, make, schema: seen.append(schema) or slices.mapped(rows, make, schema, 10))
    files = spark.range(0, 64, 1, 1).select(F.col("id").alias("book"), F.explode(F.array(F.lit("mimetype"), F.lit("a.xhtml"))).alias("name")).withColumn("text", F.when(F.col("name") == "mimetype", epub.MEDIA).otherwise("<p>&eacute;</p>"))
    made = epub.zipped(files).unionByName(spark.createDataFrame([(99, bytearray(b"x")), (100, None)], "book long, content binary"))
    got = epub.members(made)
    assert got.filter("error IS NOT NULL").count() == 2 and got.filter("error IS NULL").count() == 128
    pages = markup.repaired(got.filter("name = 'a.xhtml'"))
    assert pages.filter("mended AND error IS NULL").count() == 64
    assert epub.blocks(made).filter("error IS NOT NULL").count() == 66
    assert len(seen) == 4
