"""Python over the rows of a table, some hundreds at a time, so that its memory doesn't follow the size of Spark's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at one time (fixed value).
ROWS = 128


def mapped(rows: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = ROWS) -> DataFrame:
    """What make gives for each `size` rows; of the rest of a batch there are only Arrow's bytes. Structs are dicts."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, size):
                yield pa.RecordBatch.from_pandas(make(b.slice(k, size).to_pandas()), schema=kind, preserve_index=False)

    return rows.mapInArrow(run, schema)
