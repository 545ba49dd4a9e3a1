"""Jobs, budgets, pacing and listings over events. A user is a job, or a caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import state as S
from .tables import Tables, registry

QUERIES, SQL, query = registry()

WANTED = {"signup": "QUEUED", "view": "RUNNING", "purchase": "COMPLETED", "error": "INTERRUPTED", "click": "QUEUED"}
_WANTED = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'restart' ELSE 'INTERRUPTED' END ELSE 'QUEUED' END"
_FINAL = f"""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_WANTED} AS w FROM events),
s AS (
  SELECT user_id, 0::BIGINT AS i, NULL::VARCHAR AS state, 0::BIGINT AS accepted FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, CASE WHEN ok THEN w ELSE state END, accepted + ok::INT FROM (
    SELECT s.user_id, e.i, s.state, s.accepted, w, CASE WHEN state IS NULL THEN w = 'QUEUED' WHEN state = 'QUEUED' THEN w <> 'QUEUED'
      WHEN state = 'RUNNING' THEN w IN ('COMPLETED', 'FAILED', 'CANCELLED', 'INTERRUPTED', 'REPLAN_REQUIRED', 'restart') WHEN state = 'restart' THEN w = 'QUEUED' ELSE false END AS ok
    FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1))
SELECT user_id AS job_id, replace(max_by(state, i), 'restart', 'INTERRUPTED') AS state, max(accepted) AS accepted FROM s GROUP BY user_id"""


def _events(t: Tables) -> DataFrame:
    wanted = F.create_map(*[F.lit(x) for pair in WANTED.items() for x in pair])
    restart = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)  # every other interruption is a restart's
    return t.events.select("event_id", "ts", F.col("user_id").alias("job_id"), F.when(restart, S.RESTART).otherwise(F.element_at(wanted, F.col("event_type"))).alias("wanted"))


@query(_FINAL)
def job_fsm_final(t: Tables) -> DataFrame:
    return S.final_states(_events(t), order=("ts", "event_id"))


@query(f"""
SELECT s.state, count(f.job_id) AS n FROM (VALUES ('QUEUED'), ('RUNNING'), ('COMPLETED'), ('FAILED'), ('CANCELLED'), ('INTERRUPTED'), ('REPLAN_REQUIRED')) s(state)
LEFT JOIN ({_FINAL}) f ON f.state = s.state GROUP BY s.state""")
def job_status_counts(t: Tables) -> DataFrame:
    return S.status_counts(job_fsm_final(t))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT user_id, event_id, i, us AS start, 1::BIGINT AS win, 1::BIGINT AS nth FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - s.start >= 86400000000 THEN e.us ELSE s.start END, CASE WHEN e.us - s.start >= 86400000000 THEN win + 1 ELSE win END, CASE WHEN e.us - s.start >= 86400000000 THEN 1 ELSE nth + 1 END
  FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT event_id, win AS "window", nth, nth > 2 AS refused FROM s""")
def rate_limit_windows(t: Tables) -> DataFrame:
    """Two requests a day and caller, in windows that begin with a caller's request."""
    found = S.budgeted(t.events.select("event_id", "user_id", "ts"), "user_id", seconds=86_400, most=2, tie="event_id")
    return found.select("event_id", "window", "nth", "refused")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT user_id, event_id, i, us AS start, 1::BIGINT AS nth FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - s.start >= 60000000 THEN e.us ELSE s.start END, CASE WHEN e.us - s.start >= 60000000 THEN 1 ELSE nth + 1 END
  FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT user_id, count(*) AS requests, count(*) FILTER (nth = 1) AS windows, count(*) FILTER (nth > 120) AS refused FROM s GROUP BY user_id""")
def rate_limit_60s(t: Tables) -> DataFrame:
    found = S.budgeted(t.events.select("event_id", "user_id", "ts"), "user_id", tie="event_id")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.max("window").alias("windows"), F.count(F.when(F.col("refused"), 1)).alias("refused"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, max(us - (i - 1) * 60000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + (i - 1) * 60000000 AS slot_us FROM e""")
def rate_pacing_slots(t: Tables) -> DataFrame:
    return S.paced(t.events.select("event_id", "user_id", "ts"), "user_id", 60_000_000, tie="event_id").select("event_id", "slot_us")


@query("""
WITH r AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 0))
SELECT event_id, us, nth, (SELECT count(*) FROM r) > 20 AS more FROM r WHERE nth <= 20""")
def keyset_page(t: Tables) -> DataFrame:
    import datetime

    page = S.keyset_page(t.events.select("ts", "event_id"), ("ts", "event_id"), (datetime.datetime(2024, 1, 20), 0), 20)
    return page.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "nth", "more")


@query("SELECT event_id, event_type AS outcome, epoch_us(ts) AS us FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 25")
def decision_recent(t: Tables) -> DataFrame:
    rows = t.events.where("event_type IN ('error', 'purchase')").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)
    return rows.select("event_id", F.col("event_type").alias("outcome"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("SELECT build_id, row_number() OVER (ORDER BY build_id DESC) <= 3 AS kept FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS build_id FROM orders)")
def retention_keep_n(t: Tables) -> DataFrame:
    return I.retained(t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("build_id")).distinct(), 3)


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1""")
def idempotent_requests(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.get_json_object("props", "$.k")))
    return S.idempotent(keyed, "key", "ts", "event_id").select("event_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT user_id, event_id, i, us AS last, true AS passes FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - s.last >= 86400000000 THEN e.us ELSE s.last END, e.us - s.last >= 86400000000
  FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT event_id FROM s WHERE passes""")
def progress_throttled(t: Tables) -> DataFrame:
    """Progress is written at most once a day and user."""
    return S.throttled(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", 86_400, "event_id").select("event_id")
