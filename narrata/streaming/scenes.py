"""Who takes part in a scene, and from when to when: states of owners in a stream, kept in a map that a stop survives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "owner long, scene long, member string, entered timestamp, gone timestamp, rows long"
#: The kind of state store that maps and lists of states need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memberships(StatefulProcessor):
    """Each row names a member; a row of the kind `ends` ends the scene, and with it all that members have in it.

    The number of the scene is a value state, members with their entry and rows a map state. What isn't ended stays in the state.
    """

    def __init__(self, ends: str, keep_ms: int | None = None):
        self.ends, self.keep_ms = ends, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scene = handle.getValueState("scene", "n long")
        self.members = handle.getMapState("members", "member string", "entered timestamp, rows long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        """Each call of a state goes to the JVM and back, so states are read and written once an owner, not once a row."""
        stored = self.scene.get()
        scene = stored[0] if stored else 0
        held = {m[0]: tuple(v) for m, v in self.members.iterator()} if stored else {}
        kept, changed, out = bool(held), set(), []
        frames = list(rows)
        f = pd.concat(frames) if len(frames) > 1 else frames[0]
        if not (f["ts"].is_monotonic_increasing and f["ts"].is_unique):
            f = f.sort_values(["ts", "event_id"], kind="stable")
        for ts, member in zip(f["ts"], f["member"], strict=True):
            if member == self.ends:
                out += [(key[0], scene, m, entered, ts, n) for m, (entered, n) in held.items()]
                if kept:
                    self.members.clear()
                kept, held, changed = False, {}, set()
                scene += 1
            else:
                entered, n = held.get(member) or (ts.to_pydatetime(), 0)
                held[member] = (entered, n + 1)
                changed.add(member)
        for m in changed:
            self.members.updateValue((m,), held[m])
        if not stored or scene != stored[0]:
            self.scene.update((scene,))
        if out:
            yield pd.DataFrame(out, columns=["owner", "scene", "member", "entered", "gone", "rows"])

    def close(self) -> None:
        pass


def memberships(rows: DataFrame, ends: str, keep_ms: int | None = None) -> DataFrame:
    """owner, scene, member, entered, gone, rows of every scene that has ended, for a stream of owner, event_id, ts, member.

    keep_ms: how long a member stays in the state without a change; none: for good. A batch must hold an owner's rows
    in order of time.
    """
    keyed = rows.select("owner", "event_id", "ts", "member").groupBy("owner")
    return keyed.transformWithStateInPandas(Memberships(ends, keep_ms), OUT, "append", "processingTime" if keep_ms else "none")


def with_provider(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that memberships() needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own
