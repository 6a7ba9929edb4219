"""Event streams: counts per window of time, and a fold of states per user that survives restarts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from narrata.operators.graph import shared_root

LATE, WIDTH = "1 hour", "1 hour"


def windowed(events: DataFrame) -> DataFrame:
    """start, event_type, n, total of each window of time; events later than LATE are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", WIDTH), "event_type")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


_STATE = "scenes bigint, open bigint, last string"
_OUT = "user_id bigint, event_id bigint, scene bigint, label bigint"


def folded(events: DataFrame, breaks: str = "purchase") -> DataFrame:
    """user_id, event_id, scene, label: the scene of each event and its number there; an event of type `breaks` opens a scene.

    The fold keeps, for each user, how many scenes there were and how many events the last one has. A batch must hold
    a user's events in order of time, as a file of the ledger does.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scenes, held, last = state.get if state.exists else (0, 0, "")
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            scenes, held = (scenes + 1, 0) if kind == breaks else (scenes, held + 1)
            last = kind
            out.append((key[0], event, scenes, held))
        state.update((scenes, held, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "scene", "label"])

    return events.groupBy("user_id").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, mode: str, label: str) -> DataFrame:
    """What a stream gives of all its input: it is run until nothing is left, and its sink is read.

    Sink and offsets are kept side by side in the shared folder, so that a run which was cut off goes on from there.
    """
    root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/offsets")
    if mode == "complete":
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/rows")).start()
    else:
        running = writer.format("parquet").option("path", f"{root}/rows").start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
