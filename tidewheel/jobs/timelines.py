"""Session records, phase seconds and timelines from the events of traced sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions.lineage import cut
from tidewheel.operators import lifecycle
from tidewheel.sources.adapters import trace_events, with_views

E = with_views("trace_events")
#: When the abandoned are looked for: seconds since 1970.
NOW, IDLE = 9.0e8, 3600.0


def _records(spark, d):
    alive = lifecycle.lived(trace_events(spark, d))
    found = lifecycle.spans(alive)
    return lifecycle.records(alive, found), found


def session_spans(spark, d):
    return lifecycle.spans(lifecycle.lived(trace_events(spark, d)))


def session_records(spark, d):
    """Each session's end, with those dropped that had nothing for an hour."""
    rows, found = _records(spark, d)
    left = found.where("end_ts IS NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("open_spans"))
    kept = lifecycle.expire(rows, F.lit(NOW), IDLE).join(left, "session_id", "left")
    return kept.select("session_id", "status", "reason", *[F.round(c, 4).alias(c) for c in ("submit_ts", "finalized_ts", "total_s")], F.coalesce("open_spans", F.lit(0)).cast("long").alias("open_spans"))


def phase_durations(spark, d):
    """Seconds of each phase's ended spans in a session; null where none has ended."""
    rows, _ = _records(spark, d)
    return rows.select("session_id", *[F.round(f"{p}_s", 4).alias(f"{p}_s") for p in lifecycle.PHASES])


def _heads(spark, d):
    """Events and spans are written once: several steps read them, and making them reads the tables and puts them in order."""
    alive = cut(lifecycle.lived(trace_events(spark, d)))
    return lifecycle.heads(alive), cut(lifecycle.spans(alive))


def session_timeline(spark, d):
    rows, found = _heads(spark, d)
    out = lifecycle.timeline(rows, found)
    return out.select("session_id", "place", "segment", F.round("start_ts", 4).alias("start_ts"), F.round("end_ts", 4).alias("end_ts"))


def timeline_sweep(spark, d):
    rows, found = _heads(spark, d)
    out = lifecycle.sweep(rows, found)
    return out.select("session_id", "place", "segment", F.round("start_ts", 4).alias("start_ts"), F.round("end_ts", 4).alias("end_ts"))


QUERIES = {f.__name__: f for f in (session_spans, session_records, phase_durations, session_timeline, timeline_sweep)}

# the SQL finds a span's end by looking for the next event, and an innermost span by looking at all that cover a stretch
_ALIVE = f"""{E}, sub AS (SELECT session_id, min(ts) AS submit_ts FROM trace_events WHERE event = 'submit' GROUP BY 1),
e AS (SELECT t.* FROM trace_events t JOIN sub USING (session_id) LEFT JOIN (SELECT session_id, min(struct_pack(ts, seq)) AS cut FROM trace_events WHERE event = 'finalized' AND status IN ('accepted', 'rejected', 'failed', 'dropped') GROUP BY 1) USING (session_id) WHERE t.ts >= submit_ts AND (cut IS NULL OR struct_pack(ts := t.ts, seq := t.seq) <= cut)),
ph AS (SELECT session_id, split_part(event, '_', 1) AS phase, split_part(event, '_', 2) AS role, ts, seq, row_number() OVER (PARTITION BY session_id, split_part(event, '_', 1) ORDER BY ts, seq) AS n FROM e WHERE event LIKE '%\\_start' ESCAPE '\\' OR event LIKE '%\\_end' ESCAPE '\\'),
sp AS (SELECT a.session_id, a.phase, a.seq, a.ts AS start_ts, CASE WHEN a.role = 'end' THEN a.ts WHEN b.role = 'end' THEN b.ts END AS end_ts FROM ph a LEFT JOIN ph b ON b.session_id = a.session_id AND b.phase = a.phase AND b.n = a.n + 1
LEFT JOIN ph c ON c.session_id = a.session_id AND c.phase = a.phase AND c.n = a.n - 1 WHERE a.role = 'start' OR coalesce(c.role, 'end') = 'end'),
r AS (SELECT session_id, coalesce(max_by(status, struct_pack(ts, seq)) FILTER (event = 'finalized' AND status IS NOT NULL), 'pending') AS status, max_by(reason, struct_pack(ts, seq)) FILTER (event = 'finalized' AND reason IS NOT NULL) AS reason,
min(ts) FILTER (event = 'submit') AS submit_ts, max(ts) FILTER (event = 'finalized') AS finalized_ts, max(ts) AS last_ts FROM e GROUP BY 1)"""
_OUT = "round(start_ts, 4) AS start_ts, round(end_ts, 4) AS end_ts"
_ORDER = "PARTITION BY session_id ORDER BY start_ts, coalesce(list_position(['generate', 'reward', 'toolcall'], phase), 0), phase, seq"
ORACLES = {
    "session_spans": f"{_ALIVE} SELECT * FROM sp",
    "session_records": f"""{_ALIVE} SELECT session_id, CASE WHEN status = 'pending' AND last_ts + {IDLE} <= {NOW} THEN 'dropped' ELSE status END AS status, CASE WHEN status = 'pending' AND last_ts + {IDLE} <= {NOW} THEN 'idle' ELSE reason END AS reason,
round(submit_ts, 4) AS submit_ts, round(finalized_ts, 4) AS finalized_ts, round(finalized_ts - submit_ts, 4) AS total_s, coalesce(o, 0) AS open_spans FROM r LEFT JOIN (SELECT session_id, count(*) AS o FROM sp WHERE end_ts IS NULL GROUP BY 1) USING (session_id)""",
    "phase_durations": f"""{_ALIVE} SELECT session_id, {", ".join(f"round(sum(end_ts - start_ts) FILTER (phase = '{p}'), 4) AS {p}_s" for p in lifecycle.PHASES)} FROM r LEFT JOIN sp USING (session_id) GROUP BY 1""",
    "session_timeline": f"""{_ALIVE}, q AS (SELECT *, coalesce(lag(end_ts) OVER w, submit_ts) AS since, lead(start_ts) OVER w IS NULL AS tail, row_number() OVER w AS n FROM sp JOIN r USING (session_id) WHERE end_ts IS NOT NULL WINDOW w AS ({_ORDER})),
p AS (SELECT session_id, 3 * n AS k, 'idle' AS segment, since AS start_ts, start_ts AS end_ts FROM q WHERE start_ts - since > 1e-6 UNION ALL SELECT session_id, 3 * n + 1, phase, start_ts, end_ts FROM q WHERE end_ts > start_ts
UNION ALL SELECT session_id, 3 * n + 2, 'idle', end_ts, finalized_ts FROM q WHERE tail AND finalized_ts - end_ts > 1e-6 UNION ALL SELECT session_id, 0, 'idle', submit_ts, finalized_ts FROM r WHERE finalized_ts - submit_ts > 1e-6 AND session_id NOT IN (SELECT session_id FROM q))
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY k) - 1)::INT AS place, segment, {_OUT} FROM p""",
    "timeline_sweep": f"""{_ALIVE}, b AS (SELECT session_id, submit_ts AS f, coalesce(finalized_ts, last_ts) AS u FROM r), c AS (SELECT session_id, phase, seq, greatest(start_ts, f) AS s, least(coalesce(end_ts, u), u) AS t FROM sp JOIN b USING (session_id)),
i AS (SELECT session_id, x, lead(x) OVER (PARTITION BY session_id ORDER BY x) AS y FROM (SELECT session_id, unnest([f, u]) AS x FROM b UNION SELECT session_id, unnest([s, t]) FROM c WHERE t > s)),
m AS (SELECT i.session_id, x, y, max(CASE WHEN phase IS NOT NULL THEN struct_pack(a := s, b := -t, c := phase, d := seq) END) AS of FROM i LEFT JOIN c ON c.session_id = i.session_id AND s <= x AND t >= y WHERE y IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT *, (row_number() OVER w = 1 OR of IS DISTINCT FROM lag(of) OVER w)::INT AS new FROM m WINDOW w AS (PARTITION BY session_id ORDER BY x)), g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY x) - 1 AS place FROM n)
SELECT session_id, place::INT AS place, coalesce(any_value(of.c), 'idle') AS segment, round(min(x), 4) AS start_ts, round(max(y), 4) AS end_ts FROM g GROUP BY 1, 2""",
}
