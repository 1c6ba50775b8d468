"""Hidden-role games, card-game logs, main metrics and classes of sample ends, over orders as games and their lines as moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import benchmarks
from tidewheel.sources.adapters import table

KEYS = ["agent"]
TASKS = ["card-std", "DCG-long", "alfworld-dev", "os-std", "Database-v1", "kg-std", "ltp-x", "Mind2Web-dev", "webshop-std", "other"]


def _games(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 50).alias("agent"), F.col("o_orderkey").alias("game"), (F.col("o_orderkey") % 11 > 0).alias("completed"), (F.col("o_orderstatus") == "F").alias("won"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("winner"))


def _moves(spark, d):
    return table(spark, d, "lineitem").join(_games(spark, d).select("agent", "game"), F.col("l_orderkey") == F.col("game"))


def hidden_role_scores(spark, d):
    """Lines are what a player thinks of each other one, is thought of by it, and votes."""
    m = _moves(spark, d)
    side = (F.col("l_linestatus") == "F").cast("int")
    beliefs = m.select("agent", "game", side.alias("side"), F.when(F.col("l_tax") < 0.005, -1.0).otherwise(F.col("l_discount") * 10).alias("belief"))
    of_me = m.select("agent", "game", side.alias("side"), (F.col("l_tax") * 12.5).alias("of_me"))
    rounds = m.select("agent", "game", (F.col("l_returnflag") == "R").cast("int").alias("vote"), side.alias("outcome"), (F.col("l_linenumber") % 3 == 0).alias("leads"))
    group = ["agent", "game"]
    scores = [benchmarks.role_beliefs(beliefs, group), benchmarks.role_deception(of_me, group), benchmarks.role_votes(rounds, group)]
    out = benchmarks.hidden_roles(_games(spark, d), scores, KEYS, "game")
    return out.select("agent", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


def card_log_totals(spark, d):
    """A line is a card in a frame of its order's log."""
    m = _moves(spark, d).withColumns({"frame": F.col("l_linenumber") - 1, "player": (F.col("l_suppkey") % 2).cast("int")})
    frames = m.select("agent", "game", "frame", "player", (F.col("l_quantity") * 12 - 150).cast("int").alias("hp"))
    errors = m.where("l_tax > 0.055").select("agent", "game", "frame", (F.col("l_partkey") * 2 + F.col("player")).alias("place"), "player")
    tries = m.select("agent", "game", "player", F.round(F.col("l_discount") * 100).cast("int").alias("try_times"))
    return benchmarks.card_logs(frames, errors, tries, _games(spark, d), KEYS, "game")


def main_metrics(spark, d):
    """The number that stands for an overall result of each family of tasks."""
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    x = (F.col("o_custkey") % 100) / 100
    custom = F.struct(F.when(F.col("o_orderkey") % 3 > 0, x).alias("score"), (x / 2).alias("win_rate"), F.struct(x.alias("success_rate"), (x + 1).alias("acc")).alias("overall"), (x + 2).alias("overall_cat_accuracy"), (x + 3).alias("main"), (x * 100).alias("step_sr"), (x + 4).alias("reward"))
    r = table(spark, d, "orders").select("o_orderkey", task.alias("task"), F.to_json(F.struct(custom.alias("custom"))).alias("result"))
    metric, legacy = benchmarks.main_metric(F.col("task"), F.col("result"))
    return r.select("o_orderkey", "task", F.round(metric, 6).alias("metric"), legacy)


def validation_breakdown(spark, d):
    """Mean share of each class of ends over the pairs of every agent and of every task."""
    names = {"click": "COMPLETED", "purchase": "TASK_LIMIT_REACHED", "error": "AGENT_VALIDATION_FAILED", "signup": "AGENT_CONTEXT_LIMIT"}
    status = F.element_at(F.array(*[F.lit(s) for s in ("AGENT_INVALID_ACTION", "UNKNOWN", "TASK_ERROR")]), (F.col("event_id") % 3 + 1).cast("int"))
    for event, name in names.items():
        status = F.when(F.col("event_type") == event, name).otherwise(status)
    r = table(spark, d, "events").select((F.col("user_id") % 5).alias("agent"), (F.col("event_id") % 4).alias("task"), status.alias("status"))
    shares = benchmarks.status_shares(r, ["agent", "task"])
    by = lambda c: benchmarks.validation_means(shares, c).select(F.lit(c).alias("level"), F.col(c).alias("name"), "ending", F.round("mean_share", 6).alias("mean_share"))
    return by("agent").unionByName(by("task"))


QUERIES = {f.__name__: f for f in (hidden_role_scores, card_log_totals, main_metrics, validation_breakdown)}

_GAMES = "g AS (SELECT o_custkey % 50 AS agent, o_orderkey AS game, o_orderkey % 11 > 0 AS done, o_orderstatus AS st FROM orders), m AS (SELECT agent, game, l.* FROM lineitem l JOIN g ON l_orderkey = game)"
_TASKS = "[" + ", ".join(f"'{t}'" for t in TASKS) + "]"
_CLASS = "CASE event_type WHEN 'click' THEN 'Completed' WHEN 'purchase' THEN 'Task Limit Exceeded' WHEN 'error' THEN 'Invalid Format' WHEN 'signup' THEN 'Context Limit Exceeded' ELSE CASE WHEN event_id % 3 = 0 THEN 'Invalid Action' ELSE 'Task Limit Exceeded' END END"
_CLASSES = "['Completed', 'Context Limit Exceeded', 'Invalid Format', 'Invalid Action', 'Task Limit Exceeded']"
ORACLES = {
    "hidden_role_scores": f"""WITH {_GAMES}, b AS (SELECT agent, game, (l_linestatus = 'F')::INT AS side, CASE WHEN l_tax < 0.005 THEN -1.0::DOUBLE ELSE l_discount * 10 END AS b, l_tax * 12.5 AS me, (l_returnflag = 'R') = (l_linestatus = 'F') AS same, l_linenumber % 3 = 0 AS leads FROM m),
c AS (SELECT *, greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, CASE WHEN b = -1 THEN 0.5::DOUBLE ELSE b END)) AS p FROM b),
s AS (SELECT game, avg(((b >= 0.5)::INT = side)::INT) AS d, sum(-(side * ln(p) + (1 - side) * ln(1 - p))) AS ce, sum(side * me) / nullif(sum(side), 0) AS de, avg(same::INT) AS inf, avg(side) FILTER (leads) AS lead FROM c GROUP BY 1)
SELECT agent, round(avg((done AND st = 'F')::INT), 9) AS win_rate, round(sum(CASE WHEN done THEN coalesce(d, 0) ELSE 0 END) / count(*), 9) AS deduction, round(avg(ce) FILTER (done), 9) AS cross_entropy, round(avg(de) FILTER (done), 9) AS deception,
round(avg(inf) FILTER (done), 9) AS influence, round(avg(lead) FILTER (done), 9) AS leadership FROM g LEFT JOIN s USING (game) GROUP BY 1""",
    "card_log_totals": f"""WITH {_GAMES}, f AS (SELECT agent, game, l_linenumber - 1 AS frame, max(l_linenumber - 1) OVER (PARTITION BY game) - 1 AS last, l_suppkey % 2 AS player, floor(l_quantity * 12 - 150)::INT AS hp, l_tax > 0.055 AS err, l_partkey * 2 + l_suppkey % 2 AS place, round(l_discount * 100)::INT AS tries FROM m),
r AS (SELECT DISTINCT agent, game, last FROM f WHERE frame = last), p AS (SELECT r.*, q AS player FROM r, range(2) t(q)),
x AS (SELECT p.agent, p.game, p.player, p.last, (SELECT arg_min(e.player, e.place) FROM f e WHERE e.game = p.game AND e.frame = p.last AND e.err) AS bad FROM p),
y AS (SELECT x.agent, x.game, x.player, any_value(x.last) AS last, any_value(x.bad) AS bad, sum(CASE WHEN f.frame = x.last AND f.player <> x.player THEN 400 - greatest(hp, 0) ELSE 0 END) AS damage, sum((f.frame = x.last AND f.player <> x.player AND hp <= 0)::INT) AS takedown, sum(CASE WHEN f.player = x.player THEN tries ELSE 0 END) AS tries FROM x JOIN f USING (game) GROUP BY 1, 2, 3)
SELECT y.agent, y.player::INT AS player, count(*) FILTER (bad IS NULL OR bad <> y.player) AS full_play, sum(tries)::BIGINT AS try_times, sum(takedown)::BIGINT AS takedown, sum(damage)::BIGINT AS damage, count(*) FILTER ((st = 'F' AND y.player = 0) OR (st = 'O' AND y.player = 1)) AS win_round, sum(last + 1)::BIGINT AS round_num, count(*) AS test_times FROM y JOIN g USING (game) GROUP BY 1, 2""",
    "main_metrics": f"""WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_custkey % 100 / 100 AS x, o_orderkey % 3 = 0 AS old FROM orders)
SELECT o_orderkey, {_TASKS}[k + 1] AS task, round(CASE WHEN k < 2 AND old THEN x / 2 WHEN k < 3 THEN x WHEN k = 3 THEN x + 1 WHEN k = 4 THEN x + 2 WHEN k < 7 THEN x + 3 WHEN k = 7 THEN x WHEN k = 8 THEN x + 4 END, 6) AS metric, k < 2 AND old AS legacy FROM o""",
    "validation_breakdown": f"""WITH e AS (SELECT user_id % 5 AS agent, event_id % 4 AS task, {_CLASS} AS c FROM events), p AS (SELECT agent, task, k AS ending, count(*) FILTER (c = k) / count(*) AS share FROM e, unnest({_CLASSES}) t(k) GROUP BY 1, 2, 3)
SELECT 'agent' AS level, agent AS name, ending, round(avg(share), 6) AS mean_share FROM p GROUP BY 2, 3 UNION ALL SELECT 'task', task, ending, round(avg(share), 6) FROM p GROUP BY 2, 3""",
}
