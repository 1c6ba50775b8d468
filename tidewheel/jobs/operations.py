"""Running things: what is left to run, whether rollouts keep up with training, and ids for merged traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform_sql
from tidewheel.operators import balance, datasets, intervals, selection, traces
from tidewheel.sources.adapters import rollouts, table, with_views

PAIR = ["agent", "task"]
WINDOW = ["agent", "window"]


def _resume(spark, d):
    """Ranges asked for by customers, runs told of as JSON lines (some broken), and pairs with an overall result."""
    key = F.col("c_custkey")
    task = lambda c: F.concat(F.lit("t"), (F.col(c) % 5).cast("string"))
    assigned = table(spark, d, "customer").select((key % 40).alias("agent"), task("c_custkey").alias("task"), ((key * 7919) % 100000).alias("start"), ((key * 7919) % 100000 + key % 3000).alias("end"))
    o = F.col("l_orderkey")
    time = F.when(o % 23 > 0, F.struct(o.alias("timestamp"), F.lit("x").alias("str")))
    output = F.when(o % 17 > 0, F.struct(F.lit("completed").alias("status"), F.lit("{}").alias("result")))
    whole = F.to_json(F.struct(time.alias("time"), F.when(o % 19 > 0, (o * 31 + F.col("l_partkey")) % 101000).alias("index"), output.alias("output")))
    lines = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("agent"), task("l_partkey").alias("task"), F.when(o % 13 > 0, whole).otherwise(F.substring(whole, 1, 20)).alias("line"))
    finished = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("agent"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("task"))
    return intervals.remaining(assigned, intervals.parse_runs(lines, PAIR), finished, PAIR)


def remaining_ranges(spark, d):
    return _resume(spark, d)[0]


def unexpected_runs(spark, d):
    return _resume(spark, d)[1]


def _month(c: str):
    return (F.year(c) * 12 + F.month(c)).alias("window")


def _production(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("agent"), _month("l_shipdate"), F.col("l_suppkey").alias("instance"), F.lit(1).alias("produced"), (F.col("l_returnflag") != "N").cast("int").alias("accepted"))


def _instances(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 7 <> 5").select((F.col("s_suppkey") % 3).alias("agent"), F.col("s_suppkey").alias("instance"), (F.col("s_nationkey") % 4).cast("long").alias("gpus"), (F.col("s_acctbal") < 0).alias("suspect"))


def _report(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("agent"), _month("o_orderdate"), "o_orderkey", "o_orderstatus")
    consumed = o.select(*WINDOW, F.lit(1).alias("consumed"), (F.col("o_orderstatus") == "P").cast("int").alias("stale"))
    steps = o.select(*WINDOW, (F.col("o_orderkey") % (F.col("window") % 6 + 2)).alias("wait_s"), (F.col("o_orderkey") % 17 + 20).alias("step_s"))
    return balance.report(_production(spark, d), consumed, steps, _instances(spark, d), WINDOW)


def balance_report(spark, d):
    r = _report(spark, d)
    return r.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in r.dtypes])


def balance_layout(spark, d):
    r = balance.layout(_production(spark, d), _instances(spark, d), WINDOW)
    return r.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in r.dtypes])


def balance_apportion(spark, d):
    """Each window's target in whole GPUs for each instance of the agent."""
    each = _report(spark, d).select(*WINDOW, "target").join(_instances(spark, d), "agent")
    return balance.apportion(each, WINDOW, "target", "gpus", "instance").select(*WINDOW, "instance", "share")


def _pick(key, n: int, cases: dict, otherwise):
    out = otherwise
    for k, v in cases.items():
        out = F.when(key % n == k, v).otherwise(out)
    return out


def _trace_ids(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    none = F.lit(None).cast("string")
    rank = _pick(u, 7, {6: "head", 5: " 5 ", 4: " "}, (u % 7 - 1).cast("string"))
    pid = _pick(e, 13, {0: "true", 1: '"main"', 2: "1.5", 3: '"10"', 4: none}, ((e % 13 - 7) * 7).cast("string"))
    tid = _pick(e, 31, {0: "false", 1: '"w"', 2: "-2.5", 3: none}, (e % 31 - 15).cast("string"))
    flow = _pick(e, 5, {0: F.concat(F.lit('"f'), (e % 50).cast("string"), F.lit('"')), 1: none}, (e % 90).cast("string"))
    return table(spark, d, "events").select("event_id", rank.alias("rank"), pid.alias("pid"), tid.alias("tid"), flow.alias("flow"), F.get_json_object("props", "$.k").alias("correlation"))


def id_remap(spark, d):
    return traces.process_ids(_trace_ids(spark, d)).select("event_id", "new_pid", "new_tid")


def flow_id_remap(spark, d):
    return traces.flow_ids(_trace_ids(spark, d), "flow", "correlation").select("event_id", "new_flow", "new_correlation")


def replay_by_index(spark, d):
    """Entries at stated places of the store, some of them out of range."""
    asked = table(spark, d, "part").select((F.col("p_partkey") * 31 - 100).alias("index"))
    return selection.replay_at(rollouts(spark, d), asked, width=1 << 44).select("index", "seq_no")


def sample_negatives(spark, d):
    """Parts in samples of 50 with some right ones, and their ranks."""
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.floor(k / 50).cast("long").alias("sample"), "p_partkey", (k * 7 % 50).alias("rank"), ((F.col("p_size") > 47) & (F.floor(k / 50) % 5 > 0)).alias("right"))
    return datasets.sample_candidates(c, "sample", F.col("right"), "p_partkey", "rank", k=5, top=10, seed=3).select("sample", "p_partkey", "positive")


QUERIES = {f.__name__: f for f in (remaining_ranges, unexpected_runs, balance_report, balance_layout, balance_apportion, id_remap, flow_id_remap, replay_by_index, sample_negatives)}

# the SQL lists every index of every range, and puts neighbours together again
_RUNS = """a AS (SELECT DISTINCT c_custkey % 40 AS agent, 't' || c_custkey % 5 AS task, unnest(range((c_custkey * 7919) % 100000, (c_custkey * 7919) % 100000 + c_custkey % 3000)) AS i FROM customer),
f AS (SELECT n_nationkey::BIGINT AS agent, 't' || n_regionkey AS task FROM nation),
r AS (SELECT DISTINCT l_suppkey % 40 AS agent, 't' || l_partkey % 5 AS task, (l_orderkey * 31 + l_partkey) % 101000 AS i FROM lineitem WHERE l_orderkey % 13 > 0 AND l_orderkey % 17 > 0 AND l_orderkey % 19 > 0 AND l_orderkey % 23 > 0)"""
_P = "p AS (SELECT l_suppkey % 3 AS agent, year(l_shipdate) * 12 + month(l_shipdate) AS \"window\", l_suppkey AS instance, count(*) AS produced, count(*) FILTER (l_returnflag <> 'N') AS accepted FROM lineitem GROUP BY 1, 2, 3)"
_I = "i AS (SELECT s_suppkey % 3 AS agent, s_suppkey AS instance, (s_nationkey % 4)::BIGINT AS gpus, s_acctbal < 0 AS suspect FROM supplier WHERE s_suppkey % 7 <> 5)"
_REPORT = f"""WITH {_P}, {_I}, o AS (SELECT o_custkey % 3 AS agent, year(o_orderdate) * 12 + month(o_orderdate) AS "window", o_orderkey AS k, o_orderstatus = 'P' AS stale FROM orders),
c AS (SELECT agent, "window", count(*) AS consumed, count(*) FILTER (stale) AS stale, sum(k % ("window" % 6 + 2))::BIGINT AS wait_s, sum(k % 17 + 20)::BIGINT AS step_s, count(*) AS steps FROM o GROUP BY 1, 2),
s AS (SELECT agent, "window", sum(produced)::BIGINT AS produced, sum(accepted)::BIGINT AS entered FROM p GROUP BY 1, 2), g AS (SELECT agent, sum(gpus)::BIGINT AS gpus FROM i GROUP BY 1),
j AS (SELECT agent, "window", coalesce(produced, 0) AS produced, coalesce(entered, 0) AS entered, coalesce(consumed, 0) AS consumed, coalesce(stale, 0) AS stale, coalesce(wait_s, 0) AS wait_s, coalesce(step_s, 0) AS step_s, coalesce(steps, 0) AS steps FROM s FULL JOIN c USING (agent, "window")),
w AS (SELECT *, CASE WHEN step_s > 0 THEN least(wait_s / step_s, 0.95) ELSE 0 END AS f FROM j LEFT JOIN g USING (agent)),
b AS (SELECT *, CASE WHEN f > 0.10 AND gpus > 0 THEN 'scale_up' WHEN f < 0.05 AND entered > 0 AND consumed > 0 AND gpus > 0 THEN 'scale_down' ELSE 'hold' END AS branch FROM w),
t AS (SELECT *, (CASE branch WHEN 'scale_up' THEN ceil(gpus / (1 - f)) WHEN 'scale_down' THEN least(gpus, ceil(gpus * (consumed / entered) * 1.10::DOUBLE)) ELSE gpus END)::BIGINT AS target FROM b)"""
_RANK = "CASE user_id % 7 WHEN 6 THEN 'head' WHEN 5 THEN '5' WHEN 4 THEN NULL ELSE (user_id % 7 - 1)::VARCHAR END"
_E = f"""e AS (SELECT event_id, user_id % 7 = 6 AS rk, CASE WHEN user_id % 7 < 6 THEN user_id % 7 - (user_id % 7 < 5)::INT END AS rn, {_RANK} IS NULL AS norank,
CASE event_id % 13 WHEN 0 THEN {{'k': 0, 'n': 1.0, 't': ''}} WHEN 1 THEN {{'k': 4, 'n': 0.0, 't': 'main'}} WHEN 2 THEN {{'k': 3, 'n': 1.5, 't': ''}} WHEN 3 THEN {{'k': 4, 'n': 0.0, 't': '10'}} WHEN 4 THEN NULL ELSE {{'k': 1, 'n': ((event_id % 13 - 7) * 7)::DECIMAL(9, 1), 't': ''}} END AS pid,
CASE event_id % 31 WHEN 0 THEN {{'k': 0, 'n': 0.0, 't': ''}} WHEN 1 THEN {{'k': 4, 'n': 0.0, 't': 'w'}} WHEN 2 THEN {{'k': 3, 'n': -2.5, 't': ''}} WHEN 3 THEN NULL ELSE CASE WHEN event_id % 31 >= 15 THEN {{'k': 1, 'n': (event_id % 31 - 15)::DECIMAL(9, 1), 't': ''}} ELSE {{'k': 2, 'n': (15 - event_id % 31)::DECIMAL(9, 1), 't': ''}} END END AS tid,
CASE event_id % 5 WHEN 0 THEN {{'k': 4, 'n': 0, 't': 'f' || event_id % 50}} WHEN 1 THEN NULL ELSE {{'k': 1, 'n': event_id % 90, 't': ''}} END AS flow, {{'k': 1, 'n': (props->>'$.k')::BIGINT, 't': ''}} AS cor FROM events)"""
ORACLES = {
    "remaining_ranges": f"""WITH {_RUNS}, l AS (SELECT * FROM a ANTI JOIN f USING (agent, task) ANTI JOIN r USING (agent, task, i)), n AS (SELECT *, i - row_number() OVER (PARTITION BY agent, task ORDER BY i) AS island FROM l)
SELECT agent, task, min(i) AS start, max(i) + 1 AS "end" FROM n GROUP BY agent, task, island""",
    "unexpected_runs": f'WITH {_RUNS} SELECT agent, task, i AS "index" FROM r ANTI JOIN f USING (agent, task) ANTI JOIN a USING (agent, task, i)',
    "balance_report": f"""{_REPORT} SELECT agent, "window", produced, entered, consumed, stale, wait_s, step_s, steps, gpus, round(f, 6) AS wait_fraction, round(CASE WHEN steps > 0 THEN wait_s / steps ELSE 0 END, 6) AS avg_wait_s, round(CASE WHEN steps > 0 THEN step_s / steps ELSE 0 END, 6) AS avg_step_s,
round(CASE WHEN produced > 0 THEN entered / produced ELSE 0 END, 6) AS accept_rate, round(CASE WHEN gpus > 0 THEN entered / gpus ELSE 0 END, 6) AS throughput_per_gpu, round(CASE WHEN consumed > 0 THEN entered / consumed END, 6) AS produce_consume, round(CASE WHEN entered > 0 THEN stale / entered ELSE 0 END, 6) AS stale_rate, branch, target, target - gpus AS delta FROM t""",
    "balance_layout": f"""WITH {_P}, {_I}, v AS (SELECT DISTINCT agent, "window" FROM p), k AS (SELECT agent, "window", instance FROM p UNION SELECT agent, "window", instance FROM v JOIN i USING (agent))
SELECT agent, "window", instance, coalesce(gpus, 0) AS gpus, coalesce(produced, 0) AS produced, coalesce(accepted, 0) AS accepted, round(coalesce(accepted / produced, 0), 6) AS accept_rate, round(CASE WHEN gpus > 0 THEN coalesce(accepted, 0) / gpus ELSE 0 END, 6) AS throughput_per_gpu,
CASE WHEN suspect IS NULL THEN 'gone' WHEN suspect THEN 'suspect' ELSE 'healthy' END AS status FROM k LEFT JOIN p USING (agent, "window", instance) LEFT JOIN i USING (agent, instance)""",
    "balance_apportion": f"""{_REPORT}, q AS (SELECT agent, "window", instance, t.target, i.gpus * t.target // sum(i.gpus) OVER w AS whole, (i.gpus * t.target) % sum(i.gpus) OVER w AS rest FROM t JOIN i USING (agent) WINDOW w AS (PARTITION BY agent, "window")),
z AS (SELECT *, row_number() OVER (PARTITION BY agent, "window" ORDER BY rest DESC, instance) AS n, target - sum(whole) OVER (PARTITION BY agent, "window") AS more FROM q) SELECT agent, "window", instance, (whole + (n <= more)::INT)::BIGINT AS share FROM z""",
    "id_remap": f"""WITH {_E}, p AS (SELECT *, dense_rank() OVER (ORDER BY rk, rn, pid.k, pid.n, pid.t) AS new_pid FROM e WHERE NOT norank AND pid IS NOT NULL), t AS (SELECT event_id, new_pid + dense_rank() OVER (PARTITION BY new_pid ORDER BY tid.k, tid.n, tid.t) - 1 AS new_tid FROM p WHERE tid IS NOT NULL)
SELECT event_id, new_pid::INT AS new_pid, new_tid::INT AS new_tid FROM events LEFT JOIN p USING (event_id) LEFT JOIN t USING (event_id)""",
    "flow_id_remap": f"""WITH {_E}, k AS (SELECT rk, rn, flow AS v FROM e WHERE NOT norank AND flow IS NOT NULL UNION SELECT rk, rn, cor FROM e WHERE NOT norank AND cor.n IS NOT NULL), n AS (SELECT *, row_number() OVER (ORDER BY rk, rn, v.k, v.n, v.t)::INT AS id FROM k)
SELECT e.event_id, a.id AS new_flow, b.id AS new_correlation FROM e LEFT JOIN n a ON NOT norank AND a.rk = e.rk AND a.rn IS NOT DISTINCT FROM e.rn AND a.v = e.flow LEFT JOIN n b ON NOT norank AND b.rk = e.rk AND b.rn IS NOT DISTINCT FROM e.rn AND b.v = e.cor""",
    "replay_by_index": f"{with_views('rollouts')}, p AS (SELECT seq_no, row_number() OVER (ORDER BY seq_no) - 1 AS place FROM rollouts) SELECT p_partkey * 31 - 100 AS \"index\", seq_no FROM part JOIN p ON place = p_partkey * 31 - 100",
    "sample_negatives": f"""WITH c AS (SELECT p_partkey // 50 AS sample, p_partkey, (p_partkey * 7) % 50 < 10 AS top, p_size > 47 AND (p_partkey // 50) % 5 > 0 AS pos FROM part),
f AS (SELECT sample, bool_or(pos) AS has, bool_or(NOT pos AND top) AS near_any, bool_or(NOT pos AND NOT top) AS rest, {hash_uniform_sql("'3'", "'pool'", "sample::VARCHAR")} < 0.8 AS a, {hash_uniform_sql("'3'", "'right'", "sample::VARCHAR")} > 0.2 AS b FROM c GROUP BY 1),
g AS (SELECT *, a AND near_any AS near, has AND (b OR NOT CASE WHEN a AND near_any THEN near_any ELSE rest END) AS ok FROM f), u AS (SELECT c.*, ok FROM c JOIN g USING (sample) WHERE (pos AND ok) OR (NOT pos AND top = near)),
r AS (SELECT *, row_number() OVER (PARTITION BY sample, pos ORDER BY {hash_uniform_sql("'3'", "sample::VARCHAR", "p_partkey::VARCHAR")}, p_partkey) AS n FROM u) SELECT sample, p_partkey, pos AS positive FROM r WHERE n <= CASE WHEN pos THEN 1 WHEN ok THEN 4 ELSE 5 END""",
}
