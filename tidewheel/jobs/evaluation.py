"""Curation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform_sql
from tidewheel.operators import curation, evaluation
from tidewheel.sources.adapters import epoch_micros, eval_results, outcomes, table, with_views

O, E = with_views("outcomes"), with_views("eval_results")


def outcome_rounds(spark, d):
    return curation.rounds(outcomes(spark, d)).withColumn("g_mean", F.round("g_mean", 6))


def greso_state(spark, d):
    return curation.streaks(curation.rounds(outcomes(spark, d)))


def filter_solved_state(spark, d):
    solved = outcomes(spark, d).withColumn("reward", (F.col("reward") > 0).cast("double"))
    s = curation.success_average(curation.rounds(solved), 0.5)
    return s.select("prompt_id", F.round("success", 6).alias("success"), (F.col("success") < 0.95).alias("submit"))


def greso_controller(spark, d):
    c = curation.controller(curation.rounds(outcomes(spark, d)))
    return c.select("version", F.round("p_easy", 6).alias("p_easy"), F.round("p_hard", 6).alias("p_hard"))


def gate_prompts(spark, d):
    prompts = table(spark, d, "customer").select(F.col("c_custkey").alias("prompt_id"))
    g = curation.gate(prompts, curation.streaks(curation.rounds(outcomes(spark, d))), p_easy=0.5, p_hard=0.7, seed=5)
    own = g.select("prompt_id", F.coalesce("streak", F.lit(0)).cast("long").alias("streak"), "kind", F.round("p", 6).alias("p"), "submit")
    return curation.force_after(own, "prompt_id", 256)


def avg_at_k(spark, d):
    a = evaluation.avg_at_k(eval_results(spark, d))
    return a.select("dataset", F.round("avg_at_k", 6).alias("avg_at_k"), F.round("mean_reward", 6).alias("mean_reward"), "total")


def pass_at_k_clamped(spark, d):
    p = evaluation.pass_at_k_means(eval_results(spark, d), 8)
    return p.select("dataset", F.round("pass_at_k", 6).alias("pass_at_k"), "samples")


def pass_at_k_suite(spark, d):
    p = evaluation.pass_at_k_suite(eval_results(spark, d), [1, 2, 4, 10, 100])
    return p.select("dataset", "k", F.round("pass_at_k", 6).alias("pass_at_k"))


def completion_numbering(spark, d):
    r = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    n = evaluation.number_attempts(r, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return n.groupBy("l_partkey", "completion_id").agg(F.max("l_orderkey").alias("l_orderkey"))


def eval_result_lookup(spark, d):
    """Attach customer and segment to orders by key; those whose customer is in debt have none and are counted as skipped."""
    c = table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("c_custkey").isNull()).alias("skipped"), F.round(F.avg("o_totalprice"), 4).alias("mean_reward"))


def replicate_eval_set(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("replica"), F.length("text").alias("len"))


def outputs_vs_targets(spark, d):
    """Labelled documents are the targets; missing outputs count as wrong."""
    t, o = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.join(o, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("quality").isNull()).alias("missing"), F.round(F.avg(F.coalesce(F.col("quality"), F.lit(0))), 6).alias("accuracy"))


def latest_per_pair(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("agent"), F.col("o_orderpriority").alias("task"), F.floor(epoch_micros("o_orderdate") / 1000000).cast("long").alias("stamp"), F.col("o_orderkey").alias("run"))
    return evaluation.latest(r, ["agent", "task"], "stamp")


def write_scoreboard(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("source").alias("agent"), "lang", "quality")
    board = evaluation.scoreboard(r, "agent", "lang", ["en", "de", "fr", "es"], F.round(F.avg("quality"), 6))
    return board


def remaining_samples(spark, d):
    o = table(spark, d, "orders")
    pairs = o.select(F.col("o_custkey").alias("agent"), F.col("o_orderkey").alias("sample"))
    done = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("sample")).distinct()
    return evaluation.remaining(pairs, done, ["sample"])


def testcase_pass_rate(spark, d):
    """Seven expected cases an order; those without a line are failures."""
    # both are dealt by order first: keys that hardly repeat must not be gathered in the tasks that read the files
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(7).alias("asked"), F.lit(None).cast("int").alias("case"), F.lit(None).cast("int").alias("ok"))
    told = table(spark, d, "lineitem").where("l_linenumber BETWEEN 1 AND 7").select(F.col("l_orderkey").alias("k"), F.lit(0).alias("asked"), F.col("l_linenumber").cast("int").alias("case"), (F.col("l_linestatus") == "F").cast("int").alias("ok"))
    cases = wanted.unionByName(told).repartition("k").groupBy("k", "case").agg(F.sum("asked").alias("asked"), F.max("ok").alias("ok"))
    each = cases.groupBy("k").agg(F.sum("asked").alias("total"), F.sum(F.coalesce("ok", F.lit(0))).cast("long").alias("passed")).where("total > 0")
    j = each.select("k", (F.col("passed") * (F.col("total") / 7)).cast("long").alias("passed"), "total")
    return j.select("k", "passed", F.round(F.col("passed") / F.col("total"), 6).alias("rate"), (F.col("passed") == F.col("total")).alias("all_passed"))


QUERIES = {f.__name__: f for f in (outcome_rounds, greso_state, filter_solved_state, greso_controller, gate_prompts, avg_at_k, pass_at_k_clamped, pass_at_k_suite, completion_numbering, eval_result_lookup, replicate_eval_set, outputs_vs_targets, latest_per_pair, write_scoreboard, remaining_samples, testcase_pass_rate)}

_ROUNDS = "r AS (SELECT prompt_id, version, avg(reward) AS g_mean, (max(reward) - min(reward) <= 1e-8)::INT AS zero_adv, count(*) AS n_trajs, CASE WHEN max(reward) - min(reward) <= 1e-8 THEN CASE WHEN avg(reward) > 0.5 THEN 'easy' ELSE 'hard' END END AS kind FROM outcomes GROUP BY 1, 2)"
_STREAK = """b AS (SELECT *, (zero_adv = 0 OR coalesce(lag(kind) OVER w <> kind, lag(version) OVER w IS NOT NULL))::INT AS brk FROM r WINDOW w AS (PARTITION BY prompt_id ORDER BY version)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY prompt_id ORDER BY version) AS island FROM b),
st AS (SELECT prompt_id, sum(zero_adv)::BIGINT AS streak, arg_max(kind, version) AS kind FROM i WHERE island = (SELECT max(island) FROM i x WHERE x.prompt_id = i.prompt_id) GROUP BY 1)"""
_N = "a AS (SELECT dataset, sample, count(*) AS n, count(*) FILTER (correct) AS c FROM eval_results GROUP BY 1, 2)"


def _p(k: str) -> str:
    return f"CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n - c < least({k}, n) THEN 1.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - least({k}, n) / i::DOUBLE)) END"


ORACLES = {
    "outcome_rounds": f"{O}, {_ROUNDS} SELECT prompt_id, version, round(g_mean, 6) AS g_mean, zero_adv, n_trajs, kind FROM r",
    "greso_state": f"{O}, {_ROUNDS}, {_STREAK} SELECT * FROM st",
    "greso_controller": f"{O.replace('WITH', 'WITH RECURSIVE', 1)}, {_ROUNDS}, n AS (SELECT version, coalesce(count(*) FILTER (kind = 'easy') / nullif(count(kind), 0)::DOUBLE, 0) AS e, coalesce(count(*) FILTER (kind = 'hard') / nullif(count(kind), 0)::DOUBLE, 0) AS h, row_number() OVER (ORDER BY version) AS i FROM r GROUP BY 1), c AS (SELECT 0::BIGINT AS i, NULL::INT AS version, 0.5::DOUBLE AS pe, 0.5::DOUBLE AS ph UNION ALL SELECT n.i, n.version, greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN e >= 0.083 THEN pe - 0.01::DOUBLE ELSE pe + 0.01::DOUBLE END)), greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN h >= 0.167 THEN ph - 0.01::DOUBLE ELSE ph + 0.01::DOUBLE END)) FROM c JOIN n ON n.i = c.i + 1) SELECT version, round(pe, 6) AS p_easy, round(ph, 6) AS p_hard FROM c WHERE i > 0",
    "filter_solved_state": f"{O}, {_ROUNDS}, g AS (SELECT prompt_id, g_mean, count(*) OVER (PARTITION BY prompt_id) - row_number() OVER (PARTITION BY prompt_id ORDER BY version) AS age FROM r), s AS (SELECT prompt_id, sum(0.5::DOUBLE * pow(0.5::DOUBLE, age) * g_mean) AS success FROM g GROUP BY 1) SELECT prompt_id, round(success, 6) AS success, success < 0.95 AS submit FROM s",
    "gate_prompts": f"{O}, {_ROUNDS}, {_STREAK}, g AS (SELECT c_custkey AS prompt_id, streak, kind, CASE WHEN coalesce(streak, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(kind, 'easy') = 'easy' THEN greatest(pow(0.5::DOUBLE, streak), 0.1) ELSE greatest(pow(0.7::DOUBLE, streak), 0.4) END AS p FROM customer LEFT JOIN st ON c_custkey = prompt_id), f AS (SELECT prompt_id, coalesce(streak, 0)::BIGINT AS streak, kind, round(p, 6) AS p, {hash_uniform_sql(chr(39) + '5' + chr(39), 'prompt_id::VARCHAR')} < p AS submit FROM g), o AS (SELECT *, row_number() OVER (ORDER BY prompt_id) - 1 AS place FROM f), l AS (SELECT *, coalesce(max(CASE WHEN submit THEN place END) OVER (ORDER BY place), -1) AS last FROM o) SELECT prompt_id, streak, kind, p, submit OR (place > last AND (place - last) % 257 = 0) AS submit FROM l",
    "avg_at_k": f"{E}, a AS (SELECT dataset, count(*) FILTER (correct) * 100.0::DOUBLE / count(*) AS v, avg(reward) AS m, count(*) AS t FROM eval_results GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT 'overall', avg(v), avg(m), sum(t)::BIGINT FROM a) SELECT dataset, round(v, 6) AS avg_at_k, round(m, 6) AS mean_reward, t AS total FROM u",
    "pass_at_k_clamped": f"{E}, {_N} SELECT dataset, round(avg({_p('8')}) * 100, 6) AS pass_at_k, count(*) AS samples FROM a GROUP BY 1",
    "pass_at_k_suite": f"{E}, {_N}, p AS (SELECT a.*, k::BIGINT AS k FROM a, (VALUES (1), (2), (4), (10), (100)) t(k)) SELECT dataset, k, round(avg({_p('k')}), 6) AS pass_at_k FROM p GROUP BY 1, 2 HAVING min(n) >= k",
    "completion_numbering": "SELECT l_partkey, (completion_id)::INT AS completion_id, l_orderkey FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS completion_id FROM lineitem)",
    "eval_result_lookup": "SELECT c_mktsegment, count(*) AS results, count(*) FILTER (c_custkey IS NULL) AS skipped, round(avg(o_totalprice), 4) AS mean_reward FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey GROUP BY 1",
    "replicate_eval_set": "SELECT item_id, r::INT AS replica, length(text)::INT AS len FROM benchmark, range(4) t(r)",
    "outputs_vs_targets": "SELECT lang, count(*) AS targets, count(*) FILTER (quality IS NULL) AS missing, round(avg(coalesce(quality, 0)), 6) AS accuracy FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1",
    "latest_per_pair": "SELECT o_custkey AS agent, o_orderpriority AS task, epoch(o_orderdate)::BIGINT AS stamp, o_orderkey AS run FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "write_scoreboard": "SELECT source AS agent, " + ", ".join(f"round(avg(quality) FILTER (lang = '{x}'), 6) AS {x}" for x in ("en", "de", "fr", "es")) + " FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "remaining_samples": "SELECT o_custkey AS agent, o_orderkey AS sample FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)",
    "testcase_pass_rate": "WITH p AS (SELECT l_orderkey AS k, l_linenumber AS c, max((l_linestatus = 'F')::INT) AS ok FROM lineitem GROUP BY 1, 2), j AS (SELECT o_orderkey AS k, sum(coalesce(ok, 0))::BIGINT AS passed FROM orders CROSS JOIN range(1, 8) t(c) LEFT JOIN p ON p.k = o_orderkey AND p.c = t.c GROUP BY 1) SELECT k, passed, round(passed / 7.0::DOUBLE, 6) AS rate, passed = 7 AS all_passed FROM j",
}
