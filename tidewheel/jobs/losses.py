"""Losses and their statistics over token rows, and forms of actions, tasks and batches beside the plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import agents, selection, tokens
from tidewheel.sources.adapters import rollouts, table, token_rows, with_views

T, R = with_views("token_rows"), with_views("rollouts")


def _policy_rows(spark, d):
    t = token_rows(spark, d).select("conv_id", F.floor(F.col("conv_id") / 8).cast("long").alias("batch"), "logprobs", "loss_mask", "input_ids")
    e = tokens.explode_tokens(t, "logprobs", "loss_mask", "input_ids", keep=("conv_id", "batch"))
    return e.select("conv_id", "batch", F.col("logprobs").alias("old_logprob"), (F.col("logprobs") * (0.4 + F.col("input_ids") % 3 * 0.5)).alias("logprob"), (F.col("pos") % 5 - 2.0).alias("advantage"), F.col("loss_mask").alias("mask"))


def _policy_stats(rows):
    n = F.greatest(F.sum("mask"), F.lit(1))
    share = lambda c: F.round(F.count_if(F.col(c)) / n, 6).alias(c)
    return rows.groupBy("batch").agg(F.round(F.sum("loss") / n, 6).alias("loss"), F.round(F.sum("ratio") / n, 6).alias("ratio"), share("clipped"), share("dual_clipped"))


def ppo_loss_stats(spark, d):
    return _policy_stats(tokens.policy_loss(_policy_rows(spark, d), "conv_id", low=0.2, high=0.28, dual=1.5))


def ppo_sequence_loss(spark, d):
    return _policy_stats(tokens.policy_loss(_policy_rows(spark, d), "conv_id", low=0.02, high=0.03, dual=None, level="sequence"))


def critic_huber_loss(spark, d):
    r = rollouts(spark, d).select(F.floor(F.col("group_id") / 32).cast("long").alias("batch"), (F.col("logprob_gap") * 30).alias("v"), (F.col("reward") * 20).alias("old"), F.col("seq_len").cast("double").alias("target"))
    loss, clipped = tokens.value_loss(F.col("v"), F.col("old"), F.col("target"), 2.0, "huber")
    return r.select("batch", loss.alias("loss"), clipped.alias("clipped")).groupBy("batch").agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg(F.col("clipped").cast("double")), 6).alias("clipped"))


def staleness_gaps(spark, d):
    """Both gaps of generated tokens: to the version that is trained and to the one before."""
    t = tokens.explode_tokens(token_rows(spark, d).withColumn("batch", F.floor(F.col("conv_id") / 8).cast("long")), "versions", "loss_mask", keep=("batch",)).where("loss_mask = 1 AND versions >= 0")
    of = {"theta": F.lit(20) - F.col("versions"), "proximal": F.lit(19) - F.col("versions")}
    return t.groupBy("batch").agg(*[f(c).alias(f"{k}_{n}") if n != "avg" else F.round(f(c), 6).alias(f"{k}_{n}") for k, c in of.items() for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))])


def batch_lengths(spark, d):
    """Lengths of right and wrong sequences, of prompts by the masks, and the share of sequences that fill their batch."""
    t = token_rows(spark, d).select(F.floor(F.col("conv_id") / 8).cast("long").alias("batch"), F.size("input_ids").alias("n"), F.aggregate("loss_mask", F.lit(0), lambda a, m: a + m).alias("own"), (F.col("conv_id") % 3 > 0).alias("right"))
    most = t.groupBy("batch").agg(F.max("n").alias("most"))
    j = t.join(most, "batch")
    return j.groupBy("batch").agg(F.round(F.avg(F.when(F.col("right"), F.col("n"))), 6).alias("correct_seq_len"), F.round(F.avg(F.when(~F.col("right"), F.col("n"))), 6).alias("incorrect_seq_len"), F.round(F.avg(F.col("n") - F.col("own")), 6).alias("prompt_len"), F.round(F.avg((F.col("n") == F.col("most")).cast("double")), 6).alias("no_eos"))


def reward_stats_strict(spark, d):
    """Rewards before the filter, and after it, those of groups with a signal alone."""
    r = rollouts(spark, d)
    flat = r.groupBy("group_id").agg((F.max("reward") - F.min("reward") > 1e-8).alias("kept"))
    j = r.join(flat, "group_id")
    of = lambda name, c: [F.count(c).alias(f"{name}_reward_count"), F.round(F.sum(c), 6).alias(f"{name}_reward_sum"), F.min(c).alias(f"{name}_reward_min"), F.max(c).alias(f"{name}_reward_max")]
    return j.groupBy("model_key").agg(*of("pre_filter", F.col("reward")), *of("post_filter", F.when(F.col("kept"), F.col("reward"))))


def ordered_batches(spark, d):
    """The place of every sequence in the next batch of either order."""
    pick = lambda p: selection.select_batch(rollouts(spark, d), 128, current=60, max_staleness=40, policy=p)
    return pick("edf").select(F.lit("edf").alias("policy"), "ordinal", "seq_no").unionByName(pick("fifo").select(F.lit("fifo").alias("policy"), "ordinal", "seq_no"))


def _said(spark, d):
    k, role = F.col("turn") % 6, F.col("role")
    text = F.when(k == 0, F.concat(F.lit("Think: look\nAct: bash\n```bash\nls "), role, F.lit("\n```\nand\n```bash\npwd\n```"))).when(k == 1, F.concat(F.lit("Act: answer(old)\nThink: x\nAct: Answer( "), role, F.lit("(1) ) ok"))).when(k == 2, "Act: answer none\nThink: y\nAct: FINISH")
    return table(spark, d, "conversations").select("conv_id", "turn", text.when(k == 3, F.concat(F.lit("C.\nAnswer: C\nAction: SELECT\nValue:  "), role, F.lit(" \nmore"))).when(k == 4, "Action: CLICK").otherwise(role).alias("t"))


def parse_shell_action(spark, d):
    return _said(spark, d).select("conv_id", "turn", *agents.shell_action(F.col("t")))


def parse_choice_action(spark, d):
    return _said(spark, d).select("conv_id", "turn", *agents.choice_action(F.col("t")))


def search_format_ok(spark, d):
    k = F.col("turn") % 6
    text = F.when(k == 0, "<think>a</think><search>q</search>").when(k == 1, "<search>q</search><access>u</access>").when(k == 2, "<answer>x</answer> </think></think>").when(k == 3, "the Assistant").when(k == 4, "<access>u").otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", agents.search_format(text).alias("ok"))


def multi_turn_discount(spark, d):
    """Turns of an order are its lines; the first that is returned ends it."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))), lambda x: F.when(x["l_returnflag"] == "R", x["l_quantity"]).otherwise(0.0)).alias("turns"))
    return o.select("l_orderkey", F.round(agents.retry_discount(F.col("turns"), 0.9), 6).alias("reward"))


def dedup_task_pairs(spark, d):
    """Targets are an order's returned parts by group, its stock the others; equal pairs are one task."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 3).cast("string").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("want"), F.count_if(F.col("l_returnflag") != "R").alias("have"))
    m = c.groupBy("l_orderkey").agg(*[F.map_from_entries(F.collect_list(F.when(F.col(x) > 0, F.struct("k", x)))).alias(y) for x, y in (("want", "t"), ("have", "s"))])
    return agents.unique_tasks(m, "l_orderkey", "t", "s").select("l_orderkey", "copies")


QUERIES = {f.__name__: f for f in (ppo_loss_stats, ppo_sequence_loss, critic_huber_loss, staleness_gaps, batch_lengths, reward_stats_strict, ordered_batches, parse_shell_action, parse_choice_action, search_format_ok, multi_turn_discount, dedup_task_pairs)}

_TOKENS = f"""{T}, e AS (SELECT conv_id, conv_id // 8 AS batch, unnest(logprobs) AS old, unnest(loss_mask) AS mask, unnest(input_ids) AS id, unnest(range(len(input_ids))) AS pos FROM token_rows),
p AS (SELECT conv_id, batch, mask > 0 AS used, old * (0.4::DOUBLE + id % 3 * 0.5::DOUBLE) - old AS gap, (pos % 5 - 2)::DOUBLE AS a FROM e)"""


def _policy(rows: str, low: float, high: float, dual: str) -> str:
    return f"""{rows}, x AS (SELECT batch, used, a, CASE WHEN used THEN exp(gap) ELSE 0.0 END AS r FROM q), y AS (SELECT *, -a * r AS l1, -a * greatest({1 - low}::DOUBLE, least({1 + high}::DOUBLE, r)) AS l2 FROM x), z AS (SELECT *, greatest(l1, l2) AS w, {dual} AS b FROM y)
        SELECT batch, round(sum(CASE WHEN used THEN least(w, b) ELSE 0.0 END) / greatest(count(*) FILTER (used), 1), 6) AS loss, round(sum(r) / greatest(count(*) FILTER (used), 1), 6) AS ratio, round(count(*) FILTER (used AND l1 < l2) / greatest(count(*) FILTER (used), 1), 6) AS clipped, round(count(*) FILTER (used AND b < w) / greatest(count(*) FILTER (used), 1), 6) AS dual_clipped FROM z GROUP BY 1"""


_H = lambda x, y: f"CASE WHEN abs({x} - {y}) < 10 THEN 0.5::DOUBLE * ({x} - {y}) * ({x} - {y}) ELSE 10.0::DOUBLE * (abs({x} - {y}) - 5.0::DOUBLE) END"
ORACLES = {
    "ppo_loss_stats": _policy(f"{_TOKENS}, q AS (SELECT * FROM p)", 0.2, 0.28, "abs(a) * 1.5::DOUBLE"),
    "ppo_sequence_loss": _policy(f"{_TOKENS}, m AS (SELECT conv_id, coalesce(avg(gap) FILTER (used), 0.0) AS g, coalesce(avg(a) FILTER (used), 0.0) AS adv FROM p GROUP BY 1), q AS (SELECT batch, used, m.g AS gap, m.adv AS a FROM p JOIN m USING (conv_id))", 0.02, 0.03, "greatest(l1, l2)"),
    "critic_huber_loss": f"{R}, r AS (SELECT group_id // 32 AS batch, logprob_gap * 30 AS v, reward * 20 AS o, seq_len::DOUBLE AS t FROM rollouts), n AS (SELECT *, o + greatest(-2.0::DOUBLE, least(2.0::DOUBLE, v - o)) AS c FROM r), l AS (SELECT batch, {_H('v', 't')} AS a, {_H('c', 't')} AS b FROM n) SELECT batch, round(avg(greatest(a, b)), 6) AS loss, round(avg((b > a)::INT), 6) AS clipped FROM l GROUP BY 1",
    "staleness_gaps": f"{T}, t AS (SELECT conv_id // 8 AS batch, unnest(versions) AS v, unnest(loss_mask) AS m FROM token_rows) SELECT batch, round(avg(20 - v), 6) AS theta_avg, max(20 - v) AS theta_max, min(20 - v) AS theta_min, round(avg(19 - v), 6) AS proximal_avg, max(19 - v) AS proximal_max, min(19 - v) AS proximal_min FROM t WHERE m = 1 AND v >= 0 GROUP BY 1",
    "batch_lengths": f"{T}, l AS (SELECT conv_id // 8 AS batch, len(input_ids) AS n, list_sum(loss_mask) AS own, conv_id % 3 > 0 AS ok, max(len(input_ids)) OVER (PARTITION BY conv_id // 8) AS most FROM token_rows) SELECT batch, round(avg(n) FILTER (ok), 6) AS correct_seq_len, round(avg(n) FILTER (NOT ok), 6) AS incorrect_seq_len, round(avg(n - own), 6) AS prompt_len, round(avg((n = most)::INT), 6) AS no_eos FROM l GROUP BY 1",
    "reward_stats_strict": f"{R}, k AS (SELECT model_key, reward, max(reward) OVER (PARTITION BY group_id) - min(reward) OVER (PARTITION BY group_id) > 1e-8 AS kept FROM rollouts) SELECT model_key, count(*) AS pre_filter_reward_count, round(sum(reward), 6) AS pre_filter_reward_sum, min(reward) AS pre_filter_reward_min, max(reward) AS pre_filter_reward_max, count(*) FILTER (kept) AS post_filter_reward_count, round(sum(reward) FILTER (kept), 6) AS post_filter_reward_sum, min(reward) FILTER (kept) AS post_filter_reward_min, max(reward) FILTER (kept) AS post_filter_reward_max FROM k GROUP BY 1",
    "ordered_batches": f"{R}, f AS (SELECT * FROM rollouts WHERE min_version IS NULL OR 60 - min_version <= 40), o AS (SELECT 'edf' AS policy, seq_no, row_number() OVER (ORDER BY min_version NULLS FIRST, seq_no) - 1 AS ordinal FROM f UNION ALL SELECT 'fifo', seq_no, row_number() OVER (ORDER BY seq_no) - 1 FROM f) SELECT policy, ordinal::INT AS ordinal, seq_no FROM o WHERE ordinal < 128",
    "parse_shell_action": "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'commit' WHEN 2 THEN 'commit' END AS action, CASE turn % 6 WHEN 0 THEN 'ls ' || role || chr(10) || chr(10) || 'pwd' WHEN 1 THEN ' ' || role || '(1) ' END AS content FROM conversations",
    "parse_choice_action": "SELECT conv_id, turn, CASE turn % 6 WHEN 3 THEN 'C' ELSE 'A' END AS option, CASE turn % 6 WHEN 3 THEN 'SELECT ' || role WHEN 4 THEN 'CLICK ' ELSE ' ' END AS action FROM conversations",
    "search_format_ok": "SELECT conv_id, turn, turn % 6 = 0 OR (turn % 6 = 5 AND role <> 'assistant') AS ok FROM conversations",
    "multi_turn_discount": "WITH t AS (SELECT l_orderkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS i FROM lineitem), f AS (SELECT l_orderkey, min(i) FILTER (l_returnflag = 'R') AS i FROM t GROUP BY 1) SELECT l_orderkey, round(coalesce(l_quantity * pow(0.9::DOUBLE, f.i), 0.0), 6) AS reward FROM f LEFT JOIN t USING (l_orderkey, i)",
    "dedup_task_pairs": "WITH c AS (SELECT l_orderkey, l_partkey % 3 AS k, count(*) FILTER (l_returnflag = 'R') AS want, count(*) FILTER (l_returnflag <> 'R') AS have FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey, string_agg(k || ':' || want || ':' || have, ',' ORDER BY k) AS form FROM c GROUP BY 1) SELECT min(l_orderkey) AS l_orderkey, count(*) AS copies FROM p GROUP BY form",
}
