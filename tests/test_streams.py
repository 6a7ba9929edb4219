"""Stored tables with repeated batches, and states that go on after a stop."""

import random

import pandas as pd
from pyspark.sql import functions as F

from narrata.streaming import scenes
from narrata.streaming.store import Store, resolved_items, upserted_items


def test_batches_count_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/cache", "key string, value string, run long", ["key"])
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string, run long")
    assert store.read().count() == 0
    assert store.commit(0, rows(("a", "1", 1), ("b", "2", 1), ("b", "0", 2)))
    assert not store.commit(0, rows(("a", "9", 9), ("z", "9", 9)))  # a repeated batch changes nothing
    assert store.commit(1, rows(("a", "3", 3), ("c", "4", 3)))
    again = Store(spark, f"{tmp_path}/cache", "key string, value string, run long", ["key"])
    assert sorted(tuple(x) for x in again.read().collect()) == [("a", "1", 1, 0), ("b", "0", 2, 0), ("c", "4", 3, 1)]
    assert store.commit(2, rows()) and store.batches() == [0, 1, 2] and store.read().count() == 3


def test_two_writers_of_a_batch(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/s", "key long, value long", ["key"])
    one = spark.createDataFrame([(1, 1)], "key long, value long")
    assert store.commit(5, one)
    monkeypatch.setattr(store, "batches", lambda: [])  # as seen by a writer who looked before the other one was done
    assert not store.commit(5, spark.createDataFrame([(1, 2)], "key long, value long"))
    monkeypatch.undo()
    assert [tuple(x) for x in store.read().collect()] == [(1, 1, 5)]


def test_items_over_batches(spark, tmp_path):
    items = Store(spark, f"{tmp_path}/items", "target string, reason string, status string, candidates string", ["target", "reason"], keep="last")
    want = lambda *x: spark.createDataFrame(list(x), "target string, reason string, candidates string")
    items.commit(0, upserted_items(items.read(), want(("q1", "LOW", None), ("q2", "LOW", "{1}"))))
    items.commit(1, resolved_items(items.read(), spark.createDataFrame([("q1",), ("q9",)], "target string")))
    items.commit(2, items.read().filter("target = 'q2'").withColumn("status", F.lit("DEFERRED")))
    before = {(x.target, x.status, x.candidates) for x in items.read().collect()}
    assert before == {("q1", "RESOLVED", "{}"), ("q2", "DEFERRED", "{1}")}
    items.commit(3, upserted_items(items.read(), want(("q1", "LOW", "{2}"), ("q2", "LOW", None), ("q1", "HIGH", None))))
    assert {(x.target, x.reason, x.status, x.candidates) for x in items.read().collect()} == {("q1", "LOW", "PENDING", "{2}"), ("q2", "LOW", "DEFERRED", "{1}"), ("q1", "HIGH", "PENDING", "{}")}


def test_a_stream_that_stops_in_a_scene(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.randrange(4), k, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", r.choice(["a", "b", "c", "c", "end"])) for k in range(300)]
    want, scene, held = [], {}, {}
    for owner, _, at, member in rows:
        if member == "end":
            want += [(owner, scene.get(owner, 0), m, e, at, n) for m, (e, n) in held.pop(owner, {}).items()]
            scene[owner] = scene.get(owner, 0) + 1
        else:
            e, n = held.setdefault(owner, {}).get(member, (at, 0))
            held[owner][member] = (e, n + 1)
    own = scenes.with_provider(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "owner long, event_id long, ts timestamp, member string"
    for k, cut in enumerate([rows[:110], rows[110:111], rows[111:]]):
        spark.createDataFrame(cut, "owner long, event_id long, ts string, member string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = scenes.memberships(own.readStream.schema(schema).parquet(f"{tmp_path}/in"), "end")
        stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/offsets").option("path", f"{tmp_path}/out").format("parquet").start().awaitTermination()
    got = own.read.parquet(f"{tmp_path}/out").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("entered", "gone")}).collect()
    assert sorted(map(tuple, got)) == sorted(want)


class _State:
    """A value and a map state that count how often they are asked."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _counted(self, x):
        self.calls += 1
        return x

    def exists(self):
        return self._counted(self.value is not None)

    def get(self):
        return self._counted(self.value)

    def update(self, v):
        self.value = self._counted(v)

    def containsKey(self, k):
        return self._counted(k in self.map)

    def getValue(self, k):
        return self._counted(self.map[k])

    def updateValue(self, k, v):
        self.map[k] = self._counted(v)

    def iterator(self):
        return self._counted(iter(list(self.map.items())))

    def clear(self):
        self._counted(self.map.clear())


def test_states_are_asked_once_an_owner():
    """However many rows an owner has, states are called a few times, and they hold what a stop must not lose."""
    state = _State()
    fold = scenes.Memberships("end")
    fold.init(state)
    rows = lambda n, of: pd.DataFrame({"owner": 1, "event_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="s"), "member": [of[i % len(of)] for i in range(n)]})
    assert not [x for f in fold.handleInputRows((1,), iter([rows(2000, "ab")]), None) for x in f.itertuples()]
    assert state.calls <= 6 and {k[0]: v[1] for k, v in state.map.items()} == {"a": 1000, "b": 1000}
    state.calls = 0
    got = [x[1:] for f in fold.handleInputRows((1,), iter([rows(3000, ["a", "c", "end"])]), None) for x in f.itertuples()]
    assert state.calls <= 6 and state.map == {} and state.value == (1000,)
    assert len(got) == 2 * 1000 + 1 and sum(x[5] for x in got) == 4000
