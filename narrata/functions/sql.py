"""The library's functions for SQL, registered with a session by one call.

* `scan_quotes(TABLE(SELECT book, turn, seg ...) PARTITION BY book ORDER BY turn)`: book, start_cp, end_cp, opening,
  depth of the quotes of each book. Segments are read one after another, and only what is open is kept.
* `split_sentences(TABLE(SELECT key, text ...))`: key, sentence (from 0), start_cp, end_cp, text of every sentence.
* `estimate_tokens(text)`: a token for each wide character, and one for every four others.
* `decode_text(content)`: struct(text, encoding, confidence, error) of bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from narrata.operators.text import SENTENCE, WIDE, scan_piece
from narrata.sources import files

_sentence = re.compile(SENTENCE)


class ScanQuotes:
    """A segment a row; null segments are empty."""

    def __init__(self) -> None:
        self.base, self.open = 0, []

    def eval(self, row: Row) -> Iterator[tuple]:
        book, _, seg = row
        quotes, _, self.open = scan_piece(seg or "", self.base, self.open, last=False)
        self.base += len(seg or "")
        for start, end, opening, depth, *_ in quotes:
            yield book, start, end, opening, depth


class SplitSentences:
    """A text a row; null texts have no sentences."""

    def eval(self, row: Row) -> Iterator[tuple]:
        key, text = row
        found = (m for m in _sentence.finditer(text or "") if m.group())
        for k, m in enumerate(found):
            yield key, k, m.start(), m.end(), m.group()


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL; calling it again changes nothing."""
    spark.udtf.register("scan_quotes", F.udtf(ScanQuotes, returnType="book long, start_cp long, end_cp long, opening string, depth int"))
    spark.udtf.register("split_sentences", F.udtf(SplitSentences, returnType="key long, sentence long, start_cp long, end_cp long, text string"))
    wide = f"regexp_count(t, r'{WIDE}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(t STRING) RETURNS BIGINT RETURN coalesce({wide} + floor((length(t) - {wide} + 3) / 4), 0)")

    @F.pandas_udf("text string, encoding string, confidence string, error string")
    def decode_text(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([files.detect(bytes(c)) if c is not None else (None, None, None, "empty") for c in content], columns=["text", "encoding", "confidence", "error"])

    spark.udf.register("decode_text", decode_text)
