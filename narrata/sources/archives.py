"""Archived calls: redacted, compressed JSON."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET = '("(?:api_key|authorization|token)"\\s*:\\s*")[^"]*(")'


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1***$2")


def packed(calls: DataFrame, key: str, text: str) -> DataFrame:
    """key, archive: the redacted text, compressed; null for null."""
    kind = calls.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "archive": [zlib.compress(t.encode(), 6) if t is not None else None for t in f["_t"]]})

    return calls.select(key, redacted(F.col(text)).alias("_t")).mapInPandas(run, f"{key} {kind}, archive binary")


def unpacked(archives: DataFrame, key: str) -> DataFrame:
    """key, text of archives; null where one can't be read."""
    kind = archives.schema[key].dataType.simpleString()

    def text(raw: bytes | None) -> str | None:
        try:
            return zlib.decompress(raw).decode() if raw is not None else None
        except (zlib.error, UnicodeDecodeError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "text": [text(a) for a in f["archive"]]})

    return archives.select(key, "archive").mapInPandas(run, f"{key} {kind}, text string")
