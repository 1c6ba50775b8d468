"""Dataset preparation, agent metrics and parsing over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform, hash_uniform_sql
from tidewheel.jobs.scoring import _P, _words
from tidewheel.operators import agents, datasets, scoring, tokens
from tidewheel.sources.adapters import rollouts, table, token_rows, with_views

R, T = with_views("rollouts"), with_views("token_rows")
COLOURS = ["red", "blue", "green", "small", "large"]


def clean_boxed_answer(spark, d):
    boxed = F.concat(F.lit("$\\boxed{"), F.col("p_name"), F.lit("}$}"))
    return table(spark, d, "part").select("p_partkey", datasets.clean_boxed(boxed).alias("answer"))


def first_nonblank_field(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.lit(None)).alias("a"), F.when(F.col("o_orderkey") % 3 == 1, "o_orderstatus").alias("b0"), F.col("o_orderpriority").alias("c"), F.col("o_orderstatus").alias("s"))
    o = o.withColumn("b", F.when(F.col("b0").isNotNull(), F.concat(F.lit(" "), F.col("s"))))
    return o.select("o_orderkey", datasets.first_nonblank("a", "b", "c").alias("question"))


def truncate_dataset(spark, d):
    return datasets.truncate_each(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 20)


def _tests(spark, d):
    """The lines of an order as its test cases."""
    case = F.struct("l_linenumber", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_linestatus")).otherwise(F.lit("stdin")).alias("type"), F.col("l_partkey").cast("string").alias("input"), F.col("l_suppkey").cast("string").alias("output"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(case)).alias("tests"))


def validate_test_rows(spark, d):
    return _tests(spark, d).where(datasets.one_supported_type(F.col("tests"), ("stdin", "F"))).select("l_orderkey", F.size("tests").alias("n"))


def normalize_tests(spark, d):
    t = _tests(spark, d).where(datasets.one_supported_type(F.col("tests"), ("stdin",)))
    return t.select("l_orderkey", F.size(F.from_json(datasets.normalize_tests(F.col("tests")), "inputs array<string>, outputs array<string>").inputs).alias("inputs"), F.array_max(F.transform("tests", lambda x: x["input"].cast("long"))).alias("greatest"))


def prepare_eval_split(spark, d):
    rows = table(spark, d, "documents").select("lang", "doc_id")
    return datasets.split_contiguous(rows, ["lang"], hash_uniform(1, F.col("doc_id")), "doc_id", 4)


def goal_split(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").groupBy(F.when(k < 500, "test").when(k < 1500, "eval").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("goals"), F.min("p_partkey").alias("first"))


def shrink_action_space(spark, d):
    """More than 20 candidates: the first 6, 10 drawn and the chosen one, in order, and the chosen one's new index."""
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("all"), F.max("l_partkey").alias("chosen"))
    drawn = F.slice(F.transform(F.sort_array(F.transform("all", lambda p: F.struct(F.md5(F.concat_ws("|", F.lit("7"), p.cast("string"))).alias("h"), p.alias("p")))), lambda x: x["p"]), 1, 10)
    kept = F.when(F.size("all") > 20, F.array_sort(F.array_union(F.array_union(F.slice("all", 1, 6), drawn), F.array("chosen")))).otherwise(F.col("all"))
    return a.select("l_suppkey", F.size(kept).alias("n"), F.array_position(kept, F.col("chosen")).cast("int").alias("label"), F.array_join(kept, ",").alias("kept"))


def expand_goals(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("word"), F.array_distinct(F.array(F.col("p_size"), F.col("p_size") + 1)).alias("size"))
    """Every combination, weighed by the mean share of one over how many products have the word."""
    goals = datasets.expand_options(p, ["word", "size"]).select("p_partkey", "word", "size")
    have = goals.select("word", "p_partkey").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("have"))
    return goals.join(have, "word").select("p_partkey", "word", "size", F.round(1 / F.col("have"), 6).alias("weight"))


def reject_incomplete_group(spark, d):
    r = rollouts(spark, d)
    return agents.complete_groups(r, ["group_id"], F.col("seq_len") >= 49).select("group_id", "seq_no")


def trajectory_reward_gate(spark, d):
    r = rollouts(spark, d)
    g = r.groupBy("group_id", "traj_idx").agg(F.bool_and(F.col("seq_len") < 48).alias("ok"), F.max("reward").alias("reward"), F.bool_or(F.col("seq_len") == 1).alias("refused"))
    return g.select("group_id", "traj_idx", F.when(F.col("refused"), -0.5).otherwise(F.col("reward") * F.col("ok").cast("double")).alias("score"))


def agent_metric_means(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("agent"), F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double")), lambda k, v: (k != "value") | (F.col("event_type") == "purchase")).alias("m"))
    return agents.metric_means(e, ["agent"], "m").select("agent", "metric", F.round("mean", 6).alias("mean"), "episodes")


def batch_length_stats(spark, d):
    right = F.col("reward") > 0
    return rollouts(spark, d).groupBy((F.col("group_id") % 32).alias("batch")).agg(F.round(F.avg(F.when(right, F.col("seq_len"))), 6).alias("right_len"), F.round(F.avg(F.when(~right, F.col("seq_len"))), 6).alias("wrong_len"), F.round(F.avg((F.col("seq_len") >= 50).cast("double")), 6).alias("no_eos"), F.round(F.avg("reward"), 6).alias("mean_reward"))


def benchmark_overall(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy(F.col("source").alias("agent"), F.col("lang").alias("task")).agg(F.round(F.avg(F.coalesce(F.col("quality"), F.lit(0))), 6).alias("score"), F.round(F.avg("quality"), 6).alias("score_of_finished"), F.count("quality").alias("finished"), F.count(F.lit(1)).alias("total"))


def selector_metrics(spark, d):
    g = rollouts(spark, d).groupBy("group_id").agg((F.max("reward") != F.min("reward")).alias("mixed"), F.max_by("reward", "seq_no").alias("picked"))
    return g.groupBy((F.col("group_id") % 16).alias("workflow")).agg(F.round(F.avg(F.col("mixed").cast("double")), 6).alias("mixed_share"), F.round(agents.conditional_rate(F.col("picked") > 0, F.col("mixed")), 6).alias("accuracy"), F.round(F.avg(agents.selector_reward(F.col("group_id") % 7 != 0, F.col("picked") > 0)), 6).alias("reward"))


def recursive_agent_stats(spark, d):
    r = rollouts(spark, d)
    root = F.col("traj_idx") == 1
    g = r.groupBy("group_id").agg(F.avg(F.when(root, F.col("reward"))).alias("root_reward"), F.count(F.lit(1)).alias("agents"), F.sum(F.when(~root, F.col("reward"))).alias("won"), F.count_if(~root).alias("subs"))
    weighted = r.groupBy("group_id").agg(F.sum(agents.depth_weight(F.col("reward"), F.col("traj_idx"))).alias("weighted"), F.sum(agents.turn_discount(F.col("reward"), F.col("traj_idx"), 0.9)).alias("discounted"))
    return g.join(weighted, "group_id").select("group_id", F.round("root_reward", 6).alias("root_reward"), "agents", F.round(F.col("won") / F.nullif(F.col("subs"), F.lit(0)), 6).alias("sub_rate"), F.round("weighted", 6).alias("weighted"), F.round("discounted", 6).alias("discounted"))


def recall_at_k(spark, d):
    ranked = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")) - 1)
    p = ranked.groupBy("l_suppkey").agg(F.collect_list(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), F.col("rank"))).alias("ranks"))
    return p.groupBy((F.col("l_suppkey") % 4).alias("shard")).agg(*agents.recall_at(F.col("ranks"), [1, 5, 10, 20, 50])).select("shard", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 5, 10, 20, 50)])


def direct_gen_accuracy(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("right"), F.count(F.lit(1)).alias("n"))
    return g.select("l_partkey", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), (F.col("right") == 0).alias("hard"))


def previous_actions(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("all"))
    return c.select("conv_id", "all", F.posexplode("all").alias("pos", "action")).select("conv_id", "pos", "action", F.array_join(F.slice("all", F.greatest(F.lit(1), F.col("pos") - 4), F.least(F.col("pos"), F.lit(5))), ",").alias("previous"))


def candidate_score_join(spark, d):
    """Scores of a supplier's parts attached to its lines and gathered again in order of rank."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("score"))
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(s, "l_partkey", "left")
    best = F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "l_partkey"))), lambda x: x["l_partkey"]), 1, 5)
    return lines.groupBy("l_suppkey").agg(F.array_join(best, ",").alias("top"), F.count(F.lit(1)).alias("candidates"))


def metadata_two_key_lookup(spark, d):
    """Customers found by key or by the number in their name; each key once."""
    c = table(spark, d, "customer")
    keys = c.select(F.col("c_custkey").cast("string").alias("key"), "c_mktsegment", F.lit(0).alias("prio")).unionByName(c.select(F.col("c_name").alias("key"), "c_mktsegment", F.lit(1).alias("prio")))
    one = keys.groupBy("key").agg(F.min(F.struct("prio", "c_mktsegment")).alias("m")).select("key", F.col("m.c_mktsegment").alias("segment"))
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key")).join(one, "key", "left").groupBy("segment").agg(F.count(F.lit(1)).alias("orders"))


def product_attribute_join(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("attributes"))
    return table(spark, d, "part").select("p_partkey").join(a, "p_partkey", "left").select("p_partkey", F.array_join(F.coalesce("attributes", F.array(F.lit("DUMMY_ATTR"))), ",").alias("attributes"))


def answer_set_compare(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return o.select("l_orderkey", both.alias("shared"), F.round(F.when(both > 0, 2.0 * both / (F.size("a") + F.size("b"))).otherwise(0.0), 6).alias("f1"), ((F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)).alias("equal"))


def dedup_tasks(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("targets"))
    return t.groupBy("targets").agg(F.min("l_orderkey").alias("l_orderkey"), F.count(F.lit(1)).alias("copies"))


def parse_llm_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.col("props")).alias("text"))
    fence = F.regexp_extract("text", "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    return e.select("event_id", F.get_json_object(F.when(fence != "", fence).otherwise(F.col("text")), "$.k").cast("int").alias("k"))


def judge_verdict(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("agent"), F.when(F.col("event_type") == "purchase", '{"judgement": "correct"}').when(F.col("event_type") == "error", "it is Incorrect").when(F.col("event_type") == "click", "Correct!").otherwise("no idea").alias("t"))
    v = e.withColumn("v", agents.verdict(F.col("t")))
    return v.groupBy("agent").agg(F.round(F.avg((F.col("v") == "correct").cast("double")), 6).alias("mbe"), F.count_if(F.col("v") == "invalid").alias("invalid"))


def checklist_score(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", F.lit("n/a")).otherwise((F.col("value") / 10 - 1).cast("string")).alias("s"))
    return e.select("event_id", F.round(agents.clamp_score(F.col("s")), 6).alias("score"))


def parse_action(spark, d):
    text = F.concat(F.lit("I will "), F.col("event_type"), F.lit("["), F.get_json_object("props", "$.k"), F.lit("] now"))
    name, arg = agents.action(text)
    return table(spark, d, "events").select("event_id", name.alias("name"), arg.alias("arg"))


def normalize_color(spark, d):
    return table(spark, d, "part").select("p_partkey", agents.first_colour(F.col("p_name"), COLOURS).alias("colour"))


def price_draw(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 50).alias("high"))
    first = (F.floor(F.col("low") / 10) + 1) * 10
    draw = lambda n: F.floor(hash_uniform(n, F.col("p_partkey")) * 4)
    other = (draw(3) + 1 + F.floor(hash_uniform(4, F.col("p_partkey")) * 3)) % 4
    return p.select("p_partkey", F.round(F.col("low") + (F.col("high") - F.col("low")) * hash_uniform(2, F.col("p_partkey")), 2).alias("price"), (first + 10 * F.greatest(draw(3), other)).cast("int").alias("upper"))


def pad_pack(spark, d):
    t = token_rows(spark, d).withColumn("batch", F.col("conv_id") % 8)
    return agents.pack_offsets(t, "batch", "conv_id", "input_ids").select("batch", "conv_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def build_sequence(spark, d):
    """All before a conversation's last assistant turn as the prompt, that turn as the answer."""
    t = _turns(spark, d)
    last = t.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    own = t.join(last, "conv_id").groupBy("conv_id", "last").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", "ids")))), lambda x: x["ids"])).alias("prompt"), F.max(F.when(F.col("turn") == F.col("last"), F.col("ids"))).alias("answer"))
    made = own.select("conv_id", *tokens.build_sequence(F.col("prompt"), F.col("answer"), F.transform("answer", lambda i: -i / 100), F.transform("answer", lambda _: F.col("last").cast("int"))))
    return made.select("conv_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("input_ids", "loss_mask", "versions")], F.round(tokens.array_sum(F.col("logprobs")), 6).alias("logprob"), F.size("attention_mask").alias("n"))


def _turns(spark, d):
    """Turns of conversations with the lengths of their words as tokens."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.transform(F.filter(F.split("text", "\\s+"), lambda w: w != ""), lambda w: (F.length(w) % 97).cast("int")).alias("ids"))


def token_f1_cjk(spark, d):
    """Against one benchmark item each, of which every third gets Chinese characters before its text."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("答案 12,"), "text")).otherwise(F.col("text")).alias("gold"))
    all_ = table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("items"))  # one row
    x = table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(all_)).join(b, F.col("doc_id") % F.col("items") == F.col("b"))
    return x.select("doc_id", F.round(scoring.token_f1_cjk(F.col("text"), F.col("gold")), 6).alias("f1"))


QUERIES = {f.__name__: f for f in (clean_boxed_answer, first_nonblank_field, truncate_dataset, validate_test_rows, normalize_tests, prepare_eval_split, goal_split, shrink_action_space, expand_goals, reject_incomplete_group, trajectory_reward_gate, agent_metric_means, batch_length_stats, benchmark_overall, selector_metrics, recursive_agent_stats, recall_at_k, direct_gen_accuracy, previous_actions, candidate_score_join, metadata_two_key_lookup, product_attribute_join, answer_set_compare, dedup_tasks, parse_llm_json, judge_verdict, checklist_score, parse_action, normalize_color, price_draw, pad_pack, build_sequence, token_f1_cjk)}


def _chars(x: str) -> str:
    bare = f"trim(regexp_replace(lower(regexp_replace({x}, '{_P}', ' ', 'g')), '\\s+', ' ', 'g'))"
    return f"list_distinct(list_filter(string_split(regexp_replace({bare}, '[0-9，。 ,.\\-]', '', 'g'), ''), lambda c: c <> '') || regexp_extract_all({bare}, '[0-9]+'))"


_TURNS = "t AS (SELECT conv_id, turn, role, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: (length(w) % 97)::INT) AS ids FROM conversations)"
_CASES = "t AS (SELECT l_orderkey, list(CASE WHEN l_orderkey % 5 = 0 THEN l_linestatus ELSE 'stdin' END) AS kinds, count(*) AS n, max(l_partkey) AS greatest FROM lineitem GROUP BY 1)"
_H = lambda seed, x: hash_uniform_sql(f"'{seed}'", f"{x}::VARCHAR")
ORACLES = {
    "clean_boxed_answer": "SELECT p_partkey, p_name AS answer FROM part",
    "first_nonblank_field": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS question FROM orders",
    "truncate_dataset": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20",
    "validate_test_rows": f"WITH {_CASES} SELECT l_orderkey, n::INT AS n FROM t WHERE len(list_distinct(kinds)) = 1 AND kinds[1] IN ('stdin', 'F')",
    "normalize_tests": f"WITH {_CASES} SELECT l_orderkey, n::INT AS inputs, greatest FROM t WHERE len(list_distinct(kinds)) = 1 AND kinds[1] = 'stdin'",
    "prepare_eval_split": f"SELECT lang, doc_id, least((row_number() OVER (PARTITION BY lang ORDER BY {_H(1, 'doc_id')}, doc_id) - 1) // greatest(count(*) OVER (PARTITION BY lang) // 4, 1), 3)::INT AS part FROM documents",
    "goal_split": "SELECT CASE WHEN p_partkey < 500 THEN 'test' WHEN p_partkey < 1500 THEN 'eval' ELSE 'train' END AS split, count(*) AS goals, min(p_partkey) AS first FROM part GROUP BY 1",
    "shrink_action_space": "WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), a AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('7|' || l_partkey), l_partkey) AS h, count(*) OVER (PARTITION BY l_suppkey) AS n, max(l_partkey) OVER (PARTITION BY l_suppkey) AS chosen FROM s), k AS (SELECT l_suppkey, l_partkey, chosen FROM a WHERE n <= 20 OR i <= 6 OR h <= 10 OR l_partkey = chosen) SELECT l_suppkey, count(*)::INT AS n, count(*)::INT AS label, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS kept FROM k GROUP BY 1",
    "expand_goals": "WITH g AS (SELECT p_partkey, unnest(w) AS word, size FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest([p_size, p_size + 1]) AS size FROM part)), h AS (SELECT word, count(DISTINCT p_partkey) AS have FROM g GROUP BY 1) SELECT p_partkey, word, size, round(1 / have, 6) AS weight FROM g JOIN h USING (word)",
    "reject_incomplete_group": f"{R} SELECT group_id, seq_no FROM rollouts WHERE group_id NOT IN (SELECT group_id FROM rollouts WHERE seq_len >= 49)",
    "trajectory_reward_gate": f"{R} SELECT group_id, traj_idx, CASE WHEN bool_or(seq_len = 1) THEN -0.5::DOUBLE ELSE max(reward) * bool_and(seq_len < 48)::INT END AS score FROM rollouts GROUP BY 1, 2",
    "agent_metric_means": "WITH m AS (SELECT user_id % 10 AS agent, 'value' AS metric, value AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id % 10, 'k', (props->>'$.k')::DOUBLE FROM events) SELECT agent, metric, round(avg(v), 6) AS mean, count(v) AS episodes FROM m GROUP BY 1, 2",
    "batch_length_stats": f"{R} SELECT group_id % 32 AS batch, round(avg(seq_len) FILTER (reward > 0), 6) AS right_len, round(avg(seq_len) FILTER (NOT reward > 0), 6) AS wrong_len, round(avg((seq_len >= 50)::INT), 6) AS no_eos, round(avg(reward), 6) AS mean_reward FROM rollouts GROUP BY 1",
    "benchmark_overall": "SELECT source AS agent, lang AS task, round(avg(coalesce(quality, 0)), 6) AS score, round(avg(quality), 6) AS score_of_finished, count(quality) AS finished, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "selector_metrics": f"{R}, g AS (SELECT group_id, max(reward) <> min(reward) AS mixed, arg_max(reward, seq_no) AS picked FROM rollouts GROUP BY 1) SELECT group_id % 16 AS workflow, round(avg(mixed::INT), 6) AS mixed_share, round(avg((picked > 0)::INT) FILTER (mixed), 6) AS accuracy, round(avg(CASE WHEN group_id % 7 = 0 THEN 0.0::DOUBLE WHEN picked > 0 THEN 1.0 ELSE 0.5 END), 6) AS reward FROM g GROUP BY 1",
    "recursive_agent_stats": f"{R} SELECT group_id, round(avg(reward) FILTER (traj_idx = 1), 6) AS root_reward, count(*) AS agents, round(sum(reward) FILTER (traj_idx <> 1) / nullif(count(*) FILTER (traj_idx <> 1), 0), 6) AS sub_rate, round(sum(reward / (traj_idx + 1)), 6) AS weighted, round(sum(reward * pow(0.9::DOUBLE, traj_idx)), 6) AS discounted FROM rollouts GROUP BY 1",
    "recall_at_k": "WITH r AS (SELECT l_suppkey, l_returnflag = 'R' AND l_quantity > 45 AS pos, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS rank FROM lineitem), b AS (SELECT l_suppkey, coalesce(min(rank) FILTER (pos), 1 << 30) AS best FROM r GROUP BY 1) SELECT l_suppkey % 4 AS shard, " + ", ".join(f"round(avg((best < {k})::INT), 6) AS recall_{k}" for k in (1, 5, 10, 20, 50)) + " FROM b GROUP BY 1",
    "direct_gen_accuracy": "SELECT l_partkey, round(count(*) FILTER (l_returnflag = 'A') / count(*), 6) AS accuracy, count(*) FILTER (l_returnflag = 'A') = 0 AS hard FROM lineitem GROUP BY 1",
    "previous_actions": "WITH a AS (SELECT conv_id, role || turn AS action, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) SELECT x.conv_id, x.pos::INT AS pos, x.action, coalesce(string_agg(y.action, ',' ORDER BY y.pos), '') AS previous FROM a x LEFT JOIN a y ON x.conv_id = y.conv_id AND y.pos < x.pos AND y.pos >= x.pos - 5 GROUP BY 1, 2, 3",
    "candidate_score_join": "WITH c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_retailprice DESC, l_partkey) AS rn FROM c LEFT JOIN part ON l_partkey = p_partkey) SELECT l_suppkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 5) AS top, count(*) AS candidates FROM r GROUP BY 1",
    "metadata_two_key_lookup": "SELECT c_mktsegment AS segment, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "product_attribute_join": "SELECT p_partkey, coalesce(a, 'DUMMY_ATTR') AS attributes FROM part LEFT JOIN (SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS a FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON p_partkey = l_partkey",
    "answer_set_compare": "WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (l_linestatus = 'F'), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R'), []) AS b FROM lineitem GROUP BY 1), c AS (SELECT *, len(list_intersect(a, b)) AS k FROM s) SELECT l_orderkey, k::INT AS shared, round(CASE WHEN k > 0 THEN 2.0::DOUBLE * k / (len(a) + len(b)) ELSE 0.0 END, 6) AS f1, k = len(a) AND k = len(b) AS equal FROM c",
    "dedup_tasks": "WITH t AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS targets FROM lineitem GROUP BY 1) SELECT targets, min(l_orderkey) AS l_orderkey, count(*) AS copies FROM t GROUP BY 1",
    "parse_llm_json": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "judge_verdict": "SELECT user_id % 20 AS agent, round(avg((event_type IN ('purchase', 'click'))::INT), 6) AS mbe, count(*) FILTER (event_type NOT IN ('purchase', 'click', 'error')) AS invalid FROM events GROUP BY 1",
    "checklist_score": "SELECT event_id, round(CASE WHEN event_type = 'view' THEN 0.0 ELSE greatest(0.0, least(1.0, value / 10 - 1)) END, 6) AS score FROM events",
    "parse_action": "SELECT event_id, event_type AS name, props->>'$.k' AS arg FROM events",
    "normalize_color": "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{c}') THEN '{c}'" for c in COLOURS) + " ELSE p_name END AS colour FROM part",
    "price_draw": f"SELECT p_partkey, round(p_retailprice + 50 * {_H(2, 'p_partkey')}, 2) AS price, ((floor(p_retailprice / 10) + 1) * 10 + 10 * greatest(floor({_H(3, 'p_partkey')} * 4), (floor({_H(3, 'p_partkey')} * 4) + 1 + floor({_H(4, 'p_partkey')} * 3))::INT % 4))::INT AS upper FROM part",
    "pad_pack": f"{T} SELECT conv_id % 8 AS batch, conv_id, (sum(len(input_ids)) OVER w - len(input_ids))::BIGINT AS start, (sum(len(input_ids)) OVER w)::BIGINT AS end FROM token_rows WINDOW w AS (PARTITION BY conv_id % 8 ORDER BY conv_id)",
    "build_sequence": f"""WITH {_TURNS}, l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY 1), p AS (SELECT conv_id, last, coalesce(flatten(list(ids ORDER BY turn) FILTER (turn < last)), []) AS prompt, flatten(list(ids) FILTER (turn = last)) AS answer FROM t JOIN l USING (conv_id) GROUP BY 1, 2)
        SELECT conv_id, array_to_string(prompt || answer, ',') AS input_ids, array_to_string(list_transform(prompt, lambda x: 0) || list_transform(answer, lambda x: 1), ',') AS loss_mask, array_to_string(list_transform(prompt, lambda x: -1) || list_transform(answer, lambda x: last::INT), ',') AS versions, round(coalesce(-list_sum(answer) / 100.0::DOUBLE, 0.0), 6) AS logprob, len(prompt || answer)::INT AS n FROM p""",
    "token_f1_cjk": f"""WITH a AS (SELECT doc_id, d.text AS t, CASE WHEN item_id % 3 = 0 THEN '答案 12,' || b.text ELSE b.text END AS g, item_id % 3 = 0 AS cjk FROM documents d JOIN benchmark b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id),
        w AS (SELECT doc_id, CASE WHEN cjk THEN {_chars('t')} ELSE {_words('t')} END AS p, CASE WHEN cjk THEN {_chars('g')} ELSE {_words('g')} END AS q FROM a)
        SELECT doc_id, round(CASE WHEN len(list_intersect(p, q)) > 0 THEN 2.0::DOUBLE * len(list_intersect(p, q)) / (len(p) + len(q)) ELSE 0.0 END, 6) AS f1 FROM w""",
}
