"""Streams over the event ledger, run until their input is drained, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from narrata.operators.graph import shared_root
from narrata.plans.dialogue_queries import query
from narrata.sources.dialogue import table
from narrata.sources.model import frame, with_sql
from narrata.streaming import ledger, scenes
from narrata.streaming.store import Store, resolved_items, upserted_items


def stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(s, d):
    return ledger.drained(s, ledger.windowed(stream(s, d)), "complete", "windowed")


@query("""SELECT user_id, event_id, CAST(scene AS BIGINT) AS scene, count(*) FILTER (event_type <> 'purchase') OVER (PARTITION BY user_id, scene ORDER BY ts, event_id) AS label
FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scene FROM events)""")
def stream_scene_fold(s, d):
    return ledger.drained(s, ledger.folded(stream(s, d)), "append", "folded")


@query("""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def stream_sessions(s, d):
    """Sessions of users that half an hour without events ends; the same expression serves streams and tables."""
    g = table(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


@query("""WITH n AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM events), e AS (SELECT user_id, coalesce(ended, 0) AS scene, ts AS gone FROM n WHERE event_type = 'purchase')
SELECT n.user_id AS owner, CAST(coalesce(ended, 0) AS BIGINT) AS scene, event_type AS member, min(ts) AS entered, any_value(gone) AS gone, count(*) AS rows FROM n JOIN e ON e.user_id = n.user_id AND e.scene = coalesce(ended, 0) WHERE event_type <> 'purchase' GROUP BY 1, 2, 3""")
def stream_memberships(s, d):
    """Who took part in each scene that has ended, and from when to when, by states that a stop survives."""
    own = scenes.with_provider(s)
    rows = stream(own, d).select(F.col("user_id").alias("owner"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("member"))
    out = ledger.drained(own, scenes.memberships(rows, "purchase"), "append", "memberships")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entered", "gone")})


@query("SELECT user_id, event_type, min(value) AS value, arg_min(event_id, (value, event_id)) AS event_id, min(batch) AS batch FROM (SELECT *, event_id % 3 AS batch, min(event_id % 3) OVER (PARTITION BY user_id, event_type) AS first FROM events) WHERE batch = first GROUP BY 1, 2")
def k4_stored_results(s, d):
    """A cache of results in three commits, one of them repeated: the first writer of a key stays."""
    store = Store(s, f"{shared_root(s)}/cache-{uuid.uuid4().hex}", "user_id long, event_type string, value double, event_id long", ["user_id", "event_type"])
    e = table(s, d, "events")
    for batch in (0, 1, 1, 2):
        store.commit(batch, e.filter(F.col("event_id") % 3 == batch))
    return store.read()


@query(with_sql("outputs") + """, w AS (SELECT quote_id, book, turn, basis, assignment FROM outputs WHERE basis IN ('STYLE_ONLY', 'INSUFFICIENT')) SELECT quote_id AS target, 'LOW_CONFIDENCE' AS reason,
  CASE WHEN assignment = 'EXISTING' AND basis <> 'STYLE_ONLY' THEN 'RESOLVED' WHEN assignment = 'UNKNOWN' THEN 'DEFERRED' ELSE 'PENDING' END AS status, CASE WHEN basis = 'STYLE_ONLY' THEN '{"by": "rescan"}' ELSE '{"turn": ' || turn || '}' END AS candidates,
  CAST(CASE WHEN basis = 'STYLE_ONLY' THEN 3 WHEN assignment = 'UNKNOWN' THEN 2 WHEN assignment = 'EXISTING' THEN 1 ELSE 0 END AS BIGINT) AS batch FROM w""")
def x6_stored_items(s, d):
    """Review items over four commits: created, resolved, deferred, and wanted again by a rescan."""
    store = Store(s, f"{shared_root(s)}/items-{uuid.uuid4().hex}", "target string, reason string, status string, candidates string", ["target", "reason"], keep="last")
    o = frame(s, d, "outputs").filter("basis IN ('STYLE_ONLY', 'INSUFFICIENT')").select(F.col("quote_id").alias("target"), F.lit("LOW_CONFIDENCE").alias("reason"), "turn", "basis", "assignment")
    store.commit(0, upserted_items(store.read(), o.select("target", "reason", F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")).alias("candidates"))))
    store.commit(1, resolved_items(store.read(), o.filter("assignment = 'EXISTING'")))
    store.commit(2, store.read().join(o.filter("assignment = 'UNKNOWN'").select("target"), "target", "left_semi").withColumn("status", F.lit("DEFERRED")))
    store.commit(3, upserted_items(store.read(), o.filter("basis = 'STYLE_ONLY'").select("target", "reason", F.lit('{"by": "rescan"}').alias("candidates"))))
    return store.read()
