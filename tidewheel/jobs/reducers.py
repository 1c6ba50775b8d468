"""Benchmark reducers over orders as samples, whose results come as JSON, and options of other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import agents, benchmarks, datasets, groups
from tidewheel.sources.adapters import rollouts, table, with_views

R = with_views("rollouts")
COLOURS = ["red", "blue", "hot", "cold"]
TYPES = ("counting", "ranking", "SELECT", "INSERT", "UPDATE")


def _samples(spark, d):
    """Orders as samples of 50 agents with their lines; every eleventh has no result."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return table(spark, d, "orders").join(lines, "o_orderkey").select((F.col("o_custkey") % 50).alias("agent"), "o_orderkey", "o_totalprice", "o_orderstatus", "lines", (F.col("o_orderkey") % 11 > 0).alias("done"))


def _pick(flag: str, value: str, as_: str):
    return F.transform(F.filter("lines", lambda x: x[flag] == value), lambda x: (x[as_] % 7).cast("string"))


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c not in keys])


def puzzle_scores(spark, d):
    made = F.to_json(F.struct((F.col("o_totalprice") % 10 / 10).alias("progress"), F.lit(0.5).alias("accuracy"), (F.size("lines") / 7).alias("efficiency"), F.lit(1.0).alias("relevance")))
    s = _samples(spark, d).select("agent", F.from_json(F.when(F.col("done"), made), "progress double, accuracy double, efficiency double, relevance double").alias("r")).select("agent", "r.*")
    return _rounded(benchmarks.puzzles(s, ["agent"]), "agent")


def answer_set_scores(spark, d):
    made = F.to_json(F.struct(_pick("l_returnflag", "R", "l_partkey").alias("predict")))
    s = _samples(spark, d).select("agent", F.from_json(F.when(F.col("done"), made), "predict array<string>")["predict"].alias("predict"), _pick("l_linestatus", "F", "l_partkey").alias("gold"))
    return _rounded(benchmarks.answer_sets(s, ["agent"]), "agent")


def shop_reward(spark, d):
    s = _samples(spark, d).select("agent", F.when(F.col("done"), F.col("o_totalprice") / 1000).alias("reward"))
    return _rounded(benchmarks.mean_of_finished(s, ["agent"], "reward"), "agent")


def database_accuracy(spark, d):
    """Types go round; answers of one value are numbers in two forms of writing."""
    kind = F.element_at(F.array(*[F.lit(t) for t in ("counting", "ranking", "SELECT", "INSERT", "UPDATE", "DELETE", "other")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    first = F.col("lines")[0]
    answer = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat((first["l_quantity"] % 3).cast("int").cast("string"), F.lit(".0")))).otherwise(_pick("l_returnflag", "N", "l_suppkey"))
    gold = F.when(F.col("o_orderkey") % 2 == 0, F.array((first["l_partkey"] % 3).cast("string"))).otherwise(_pick("l_linestatus", "O", "l_suppkey"))
    s = _samples(spark, d).select("agent", kind.alias("type"), F.when(F.col("done"), answer).alias("answer"), gold.alias("gold"))
    return _rounded(benchmarks.database(s, ["agent"], TYPES), "agent")


def web_action_scores(spark, d):
    first, last = F.col("lines")[0], F.element_at("lines", -1)
    said = F.concat_ws(" ", F.lit("CLICK"), first["l_returnflag"], first["l_returnflag"])
    s = _samples(spark, d).select("agent", F.when(F.col("done"), (first["l_partkey"] % 5).cast("string")).alias("element"), F.array((last["l_partkey"] % 5).cast("string"), F.lit("0")).alias("gold_elements"), said.alias("action"), F.concat_ws(" ", F.lit("CLICK"), last["l_returnflag"]).alias("gold_action"))
    return _rounded(benchmarks.web_actions(s, ["agent"]), "agent")


def card_game_scores(spark, d):
    played = F.when(F.col("agent") % 10 == 0, 0).otherwise(F.size("lines"))
    s = _samples(spark, d).select("agent", F.least(played, F.size(_pick("l_returnflag", "R", "l_partkey"))).alias("win_round"), played.alias("test_times"), (F.col("o_totalprice") % 1601).cast("long").alias("damage"))
    return _rounded(benchmarks.card_games(s, ["agent"]), "agent")


def pass_summary(spark, d):
    s = _samples(spark, d).select("agent", F.when(F.col("done"), F.col("o_orderstatus") == "F").alias("passed"))
    return _rounded(benchmarks.pass_counts(s, ["agent"]), "agent")


def reward_normalize_masked(spark, d):
    """Within a group around the mean left out of itself, long sequences masked; whole batches of them stay as they are."""
    r = rollouts(spark, d).withColumn("batch", F.floor(F.col("group_id") / 4).cast("long")).withColumn("mask", ((F.col("seq_len") <= 40) & (F.col("batch") % 9 > 0)).cast("int"))
    out = groups.normalize_masked(r, "mask", batch=["batch"], mean_over=["batch", "group_id"], std_over=["batch"], leave_one_out=True)
    return out.select("seq_no", F.round("normalized", 6).alias("normalized"))


def normalize_size(spark, d):
    text = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("", "3 meter", "xx-large", "40cm plus", "2 petite", "91ft feet", "9 x 4", "king", "odd")]), (F.col("p_partkey") % 9 + 1).cast("int")), F.when(F.col("p_partkey") % 9 == 0, (F.col("p_size") / 4).cast("string")))
    return table(spark, d, "part").select("p_partkey", agents.size_kind(F.trim(text)).alias("size"), agents.first_colour(F.col("p_name"), COLOURS, missing="not_matched").alias("colour"))


def normalize_function_tests(spark, d):
    """Tests given as JSON text: by their kind, and null where kinds or function names are mixed."""
    case = F.struct("l_linenumber", F.when(F.col("l_orderkey") % 4 > 0, "function_call").otherwise("stdin_stdout").alias("type"), F.col("l_partkey").cast("string").alias("input"), F.col("l_suppkey").cast("string").alias("output"), F.when(F.col("l_orderkey") % 4 == 1, "f").when(F.col("l_orderkey") % 4 == 2, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("fn_name"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(case))).alias("tests"))
    return o.select("l_orderkey", datasets.normalize_test_text(F.col("tests")).alias("tests"))


QUERIES = {f.__name__: f for f in (puzzle_scores, answer_set_scores, shop_reward, database_accuracy, web_action_scores, card_game_scores, pass_summary, reward_normalize_masked, normalize_size, normalize_function_tests)}

_S = """l AS (SELECT l_orderkey AS o_orderkey, list({'k': l_partkey, 's': l_suppkey, 'q': l_quantity, 'r': l_returnflag, 't': l_linestatus} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS x FROM lineitem GROUP BY 1),
s AS (SELECT o_custkey % 50 AS agent, o_orderkey, o_totalprice, o_orderstatus, x, o_orderkey % 11 > 0 AS done FROM orders JOIN l USING (o_orderkey))"""


def _of(flag: str, value: str, key: str) -> str:
    return f"list_transform(list_filter(x, lambda e: e.{flag} = '{value}'), lambda e: (e.{key} % 7)::VARCHAR)"


_F1 = "CASE WHEN len(list_intersect(p, g)) > 0 THEN 2.0::DOUBLE * len(list_intersect(p, g)) / (len(list_distinct(p)) + len(list_distinct(g))) ELSE 0.0 END"
_ACC = ", ".join(f"round(coalesce(avg(ok) FILTER ({'type NOT IN (' + chr(39) + 'INSERT' + chr(39) + ', ' + chr(39) + 'UPDATE' + chr(39) + ')' if t == 'SELECT' else 'type = ' + chr(39) + t + chr(39)}), 0.0), 6) AS \"{t}_accuracy\"" for t in TYPES)
ORACLES = {
    "puzzle_scores": f"WITH {_S}, m AS (SELECT agent, avg(CASE WHEN done THEN o_totalprice % 10 / 10 ELSE 0 END) AS p, avg(CASE WHEN done THEN 0.5::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN done THEN len(x) / 7.0::DOUBLE ELSE 0 END) AS e, avg(done::INT) AS r FROM s GROUP BY 1) SELECT agent, round(p, 6) AS main, round(a, 6) AS \"SGA\", round(e, 6) AS \"RE\", round(r, 6) AS \"QR\", round(p, 6) AS \"GP\" FROM m",
    "answer_set_scores": f"WITH {_S}, c AS (SELECT agent, done, {_of('r', 'R', 'k')} AS p, {_of('t', 'F', 'k')} AS g FROM s) SELECT agent, round(avg(CASE WHEN done THEN {_F1} ELSE 0.0 END), 6) AS f1, round(avg((done AND list_sort(list_distinct(p)) = list_sort(list_distinct(g)))::INT), 6) AS em, round(avg((done AND len(p) > 0)::INT), 6) AS executability FROM c GROUP BY 1",
    "shop_reward": "SELECT o_custkey % 50 AS agent, round(coalesce(avg(o_totalprice / 1000) FILTER (o_orderkey % 11 > 0), 0.0), 6) AS reward FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "database_accuracy": f"""WITH {_S}, c AS (SELECT agent, ['counting', 'ranking', 'SELECT', 'INSERT', 'UPDATE', 'DELETE', 'other'][o_orderkey % 7 + 1] AS type, o_orderkey % 2 = 0 AS one, (x[1].q % 3)::INT AS a, (x[1].k % 3)::INT AS b, {_of('r', 'N', 's')} AS p, {_of('t', 'O', 's')} AS g FROM s WHERE done),
        k AS (SELECT *, (CASE WHEN one THEN CASE WHEN type IN ('INSERT', 'DELETE', 'UPDATE') THEN false ELSE a = b END WHEN type IN ('INSERT', 'DELETE', 'UPDATE') THEN p = g ELSE list_sort(list_distinct(p)) = list_sort(list_distinct(g)) END)::INT AS ok FROM c), m AS (SELECT agent, {_ACC}, coalesce(avg(ok) FILTER (type NOT IN ('INSERT', 'UPDATE')), 0) + coalesce(avg(ok) FILTER (type = 'INSERT'), 0) + coalesce(avg(ok) FILTER (type = 'UPDATE'), 0) AS three FROM k GROUP BY 1) SELECT * EXCLUDE (three), round(three / 3, 6) AS overall_cat_accuracy FROM m""",
    "web_action_scores": f"WITH {_S}, c AS (SELECT agent, done AND ((x[1].k % 5) = (x[-1].k % 5) OR x[1].k % 5 = 0) AS hit, CASE WHEN NOT done THEN 0.0::DOUBLE WHEN x[1].r = x[-1].r THEN 1.0 ELSE 0.5 END AS f1 FROM s) SELECT agent, round(avg(hit::INT) * 100, 6) AS element_acc, round(avg(f1) * 100, 6) AS action_f1, round(avg((hit AND f1 >= 1)::INT) * 100, 6) AS step_sr FROM c GROUP BY 1",
    "card_game_scores": f"WITH {_S}, c AS (SELECT agent, CASE WHEN agent % 10 = 0 THEN 0 ELSE len(list_filter(x, lambda e: e.r = 'R')) END AS w, CASE WHEN agent % 10 = 0 THEN 0 ELSE len(x) END AS n, floor(o_totalprice % 1601)::BIGINT AS dmg FROM s), m AS (SELECT agent, sum(w)::BIGINT AS w, sum(n)::BIGINT AS n, sum(dmg) / (count(*) * 1600.0::DOUBLE) AS dr FROM c GROUP BY 1) SELECT agent, w AS win_round, n AS total_round, round(CASE WHEN n = 0 THEN -1 ELSE w / n END, 6) AS win_rate, round(CASE WHEN n = 0 THEN -1 ELSE dr END, 6) AS damage_rate, round(CASE WHEN n = 0 THEN -1 ELSE w / n * 0.7::DOUBLE + least(0.3::DOUBLE, dr * 0.3::DOUBLE) END, 6) AS score FROM m",
    "pass_summary": f"WITH {_S}, p AS (SELECT agent, done AND o_orderstatus = 'F' AS ok FROM s) SELECT agent, count(*) AS total, count(*) FILTER (ok) AS pass, count(*) FILTER (NOT ok) AS wrong, round(avg(ok::INT), 6) AS success_rate FROM p GROUP BY 1",
    "reward_normalize_masked": f"""{R}, a AS (SELECT seq_no, group_id, group_id // 4 AS batch, reward AS x, (seq_len <= 40 AND (group_id // 4) % 9 > 0)::INT AS m FROM rollouts),
        b AS (SELECT *, sum(m) OVER g AS n, sum(x * m) OVER g AS t, count(*) OVER g AS rows, sum(m) OVER (PARTITION BY batch) AS bn, count(*) OVER (PARTITION BY batch) AS brows FROM a WINDOW g AS (PARTITION BY group_id)),
        c AS (SELECT *, CASE WHEN rows = 1 OR n <= 1 THEN 0 WHEN m > 0 THEN (t - x) / (n - 1) ELSE t / n END AS mean FROM b), e AS (SELECT *, (x - mean) * m AS off FROM c), f AS (SELECT *, sum(off * off) OVER (PARTITION BY batch) AS sq FROM e)
        SELECT seq_no, round(CASE WHEN bn = 0 THEN x ELSE off / (CASE WHEN brows = 1 OR bn <= 1 THEN 1 ELSE sqrt(sq / (bn - 1)) END + 1e-5) END, 6) AS normalized FROM f""",
    "normalize_size": "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'numeric_size' WHEN 1 THEN '(.*)meter' WHEN 2 THEN 'xx-large' WHEN 3 THEN '(.*)plus' WHEN 4 THEN '(.*)petite' WHEN 5 THEN '(.*)ft' WHEN 6 THEN '(.*)x(.*)' WHEN 7 THEN 'king' ELSE 'not_matched' END AS size, CASE " + " ".join(f"WHEN contains(p_name, '{c}') THEN '{c}'" for c in COLOURS) + " ELSE 'not_matched' END AS colour FROM part",
    "normalize_function_tests": "WITH c AS (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS i, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS o, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN to_json({'inputs': i, 'outputs': o})::VARCHAR WHEN l_orderkey % 4 = 1 OR (l_orderkey % 4 = 2 AND lo = hi) THEN to_json({'fn_name': 'f' || CASE WHEN l_orderkey % 4 = 2 THEN lo::VARCHAR ELSE '' END, 'inputs': i, 'outputs': o})::VARCHAR END AS tests FROM c",
}
