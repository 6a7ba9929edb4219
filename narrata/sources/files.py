"""Bytes to text: encoding detection and strict decoding."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Byte order marks, the longer ones first, and the decoders that are tried without one, in this order (fixed values).
MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
TRIED = ["utf-8", "gb18030", "big5"]
LEAST, PREVIEW = 0.999, 200
_odd = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff-�]")


def plausibility(text: str) -> float:
    return 1 - len(_odd.findall(text)) / len(text) if text else 1.0


def strict(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return None


def detect(raw: bytes, requested: str | None = None) -> tuple[str | None, str | None, str | None, str | None]:
    """(text, encoding, confidence, error). Text is never repaired: without a strict reading, there is an error."""
    told = requested or next((e for mark, e in MARKS if raw.startswith(mark)), None)
    if not raw:
        return None, None, None, "empty"
    if told:
        text = strict(raw, told)
        if text is None:
            return None, told, None, "undecodable"
        return text, told, "high" if plausibility(text) >= LEAST else "low", None
    read = [(e, t) for e in TRIED if (t := strict(raw, e)) is not None and plausibility(t) >= LEAST]
    if not read:
        return None, None, None, "undecodable"
    return read[0][1], read[0][0], "medium" if len(read) == 1 else "low", None


def decoded(files: DataFrame, key: str, requested: str | None = None) -> DataFrame:
    """key, text, encoding, confidence, plausibility, error, preview for rows of bytes (key, content).

    Where bytes can't be read, text is null, error says why, and preview shows how they would look.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [detect(bytes(c) if c is not None else b"", requested) for c in f["content"]]
            out = pd.DataFrame(got, columns=["text", "encoding", "confidence", "error"])
            out["plausibility"] = [plausibility(t) if t is not None else None for t in out["text"]]
            out["preview"] = [bytes(c or b"").decode("utf-8", "replace")[:PREVIEW] if e else None for c, e in zip(f["content"], out["error"], strict=True)]
            out[key] = f[key].to_numpy()
            yield out[[key, "text", "encoding", "confidence", "plausibility", "error", "preview"]]

    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, text string, encoding string, confidence string, plausibility double, error string, preview string")
