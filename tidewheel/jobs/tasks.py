"""Agent task queries: tool calls, search responses, shopping goals and purchases, code benchmarks and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import catalogue, datasets, graph, scoring
from tidewheel.sources.adapters import table

HEADERS = ["shopping game\ninstruction:", "corner shop\ninstruction:"]
METRIC_GROUPS = {"actor_loss": "training", "clip_ratio": "clip", "approx_kl": "kl", "version_stats/": "staleness"}
TAG_KINDS = {"planks": [("ends", "_planks")], "logs": [("ends", "_log"), ("ends", "_stem"), ("is", "log"), ("is", "stem")], "wool": [("ends", "_wool")], "coals": [("is", "coal"), ("is", "charcoal")]}


def parse_tool_calls(spark, d):
    """Turns as an agent's texts with calls, some broken off and some in another order."""
    role, k = F.col("role"), F.col("turn") % 5
    text = F.when(k == 0, F.concat(F.lit("think <search> "), role, F.lit("\n</search> then <answer>x</answer>"))).when(k == 1, F.concat(F.lit("<search> open <access>page/"), F.col("conv_id").cast("string"), F.lit("</access> <search>late</search>")))
    text = text.when(k == 2, F.concat(F.lit("no call "), role)).when(k == 3, F.concat(F.lit("<answer>"), role, F.lit("</answer><search>q</search>"))).otherwise(F.lit("<access>u"))
    c = table(spark, d, "conversations").withColumn("said", text)
    return c.select("conv_id", "turn", *scoring.tool_call(F.col("said")))


def flatten_search_response(spark, d):
    """A search server's JSON for each order: its lines as passages, every second with a score of its own."""
    line = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("text"), F.col("l_returnflag").alias("source"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("score"), "l_discount")
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("p"))
    passages = F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["source"].alias("source"), x["score"].alias("score")))
    body = F.to_json(F.struct(F.struct(F.array(passages).alias("passages"), F.array(F.transform("p", lambda x: x["l_discount"])).alias("scores")).alias("results")))
    return o.select("l_orderkey", F.posexplode(scoring.flatten_search(body)).alias("pos", "r")).select("l_orderkey", "pos", "r.text", "r.source", "r.score")


def metric_namespace(spark, d):
    names = {"actor/update/actor_loss/avg": "c_acctbal", "actor/update/clip_ratio": "c_nationkey", "actor/update/version_stats/v_theta": "c_custkey", "actor/update/other": "c_custkey", "time/step": "c_acctbal"}
    m = F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("double"))])
    return table(spark, d, "customer").select("c_custkey", F.explode(scoring.regroup_metrics(m, "actor/update/", METRIC_GROUPS)).alias("metric", "value"))


def trajectory_text_clean(spark, d):
    state = F.concat(F.lit('Shopping Game\nInstruction: "I\'m after a '), F.initcap("p_name"), F.lit('", and price lower than 40.00 dollars\n[button] Search [button_]'))
    return table(spark, d, "part").select("p_partkey", datasets.clean_goal(F.when(F.col("p_partkey") % 4 > 0, state).otherwise(F.concat(F.lit(" Corner Shop\nInstruction: "), F.col("p_name"), F.lit(" \n[button] Search [button_]"))), HEADERS).alias("goal"))


def goal_search_pairs(spark, d):
    goal = datasets.clean_goal(F.concat(F.lit("Corner Shop\nInstruction: Find a "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(", and price lower than 9")), HEADERS)
    p = table(spark, d, "part").select("p_partkey", goal.alias("goal"), F.array("p_name", F.lower("p_brand")).alias("searches"))
    return datasets.goal_searches(p, "searches", p.select("goal", F.col("p_partkey").alias("place")), 20, 1500)


def product_lookup_modes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"), F.col("p_name").alias("query"), F.array(F.col("p_brand"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("attributes"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), v.alias("value")) for m, v in (("<c>", F.col("category")), ("<q>", F.col("query")), ("<a>", F.col("attributes")[0]), ("<a>", F.col("attributes")[1]), ("<r>", F.lit("")))]))
    q = p.select(each.alias("k")).select("k.*").distinct().withColumn("query_id", F.concat_ws(" ", "mode", "value"))
    return catalogue.lookup(p, q, draws=50, seed=4).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first"), F.max("item").alias("last"))


def purchases(spark, d):
    """Every part bought for the goal of the next: names as nouns, type and brand as categories, words and size as attributes."""
    words = F.split("p_name", " ")
    own = {"query": F.col("p_type"), "categories": F.concat_ws(" › ", "p_type", "p_brand", F.element_at(words, 1)), "nouns": F.slice(words, 2, 9), "attributes": F.array(F.lower("p_brand"), F.concat(F.lit("size "), F.col("p_size").cast("string"))), "texts": F.array("p_name"), "options": F.array(F.element_at(words, 1)), "price": F.col("p_retailprice")}
    p = table(spark, d, "part")
    bought = p.select("p_partkey", *[c.alias(n) for n, c in own.items()])
    goal = {n: own[n] for n in ("query", "categories", "nouns", "options")} | {"attributes": F.array(F.lower("p_brand"), F.element_at(words, 2)), "price": F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice") + F.col("p_partkey") % 3 - 1).otherwise(0.0)}
    return bought.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), *[c.alias(f"goal_{n}") for n, c in goal.items()]), "p_partkey")


def purchase_reward(spark, d):
    r = catalogue.purchase_reward(purchases(spark, d))
    return r.select("p_partkey", "r_type", "attributes_met", "options_met", F.round("reward", 6).alias("reward"))


def convert_code_benchmark(spark, d):
    """Orders as problems: odd lines are public cases, even ones private; every fourth calls a function."""
    case = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("input"), F.col("l_suppkey").cast("string").alias("output"))
    part = lambda odd: F.to_json(F.transform(F.filter(F.sort_array("c"), lambda x: x["l_linenumber"] % 2 == odd), lambda x: F.struct(x["input"].alias("input"), x["output"].alias("output"))))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(case).alias("c"))
    called = F.col("l_orderkey") % 4 == 0
    starter = F.when(called, "def f(x):").otherwise("")
    meta = F.when(called, F.concat(F.lit('{"func_name":"f'), F.col("l_orderkey").cast("string"), F.lit('"}'))).otherwise("{}")
    content = F.concat(F.lit(" problem "), F.col("l_orderkey").cast("string"), F.lit(" "))
    question = datasets.code_question(content, starter, "Solve it.", F.concat(F.lit("Start from "), starter), "Read standard input.")
    made = o.select("l_orderkey", question.alias("question"), datasets.code_cases(part(1), part(0), meta).alias("input_output"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("difficulty"), F.col("o_orderstatus").alias("platform"))
    numbered = datasets.numbered(made, "l_orderkey", "idx").join(known, "l_orderkey", "left")
    key = F.col("l_orderkey").cast("string")
    question_id = F.when(F.col("l_orderkey") % 7 > 0, key)
    kept = [question_id.alias("question_id"), F.concat(F.lit("problem "), key).alias("question_title"), (F.col("l_orderkey") % 100).cast("string").alias("contest_id"), "platform", "difficulty"]
    return numbered.select(F.coalesce(question_id, F.col("idx").cast("string")).alias("query_id"), "question", "input_output", F.col("idx").cast("long").alias("idx"), *kept)


def _recipe_tables(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_size")
    made = p.where("item > 0 AND item % 3 <> 0")
    parts = made.select("item", F.explode(F.array(*[F.struct(F.floor(F.col("item") / k).cast("long").alias("part"), F.lit(k).alias("k")) for k in (4, 7)])).alias("x"))
    uses = parts.groupBy("item", F.col("x.part").alias("part")).agg(F.max(1 + (F.col("item") + F.col("x.k")) % 3).alias("uses"))
    targets = p.where("p_size > 45").select(F.col("item").alias("target"), "item", F.col("p_size").alias("count"))
    return targets, made.select("item", (1 + F.col("item") % 4).alias("makes")), uses, p.where("item % 5 > 0").select("item", (F.col("item") % 5).alias("have"))


def base_materials(spark, d):
    targets, recipes, uses, stock = _recipe_tables(spark, d)
    return graph.base_materials(targets, recipes, uses, stock)


def recipe_chain(spark, d):
    targets, _, uses, _ = _recipe_tables(spark, d)
    return graph.recipe_chain(targets, uses).groupBy("target").agg(F.count(F.lit(1)).alias("recipes"), F.max("depth").alias("depth"))


def tag_satisfying_items(spark, d):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    ends = F.element_at(F.array(*[F.lit(x) for x in ("_planks", "_log", "_stem", "_wool")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, d, "part")
    tags = p.select(F.concat(first, F.when(F.col("p_partkey") % 2 == 0, "_logs").otherwise("_stems")).alias("tag")).union(p.select(F.explode(F.array(*[F.lit(t) for t in TAG_KINDS])))).distinct()
    return graph.tag_items(graph.tag_rules(tags, TAG_KINDS), p.select(F.concat(first, ends).alias("item")))


def target_satisfied(spark, d):
    """Suppliers whose lines not returned cover, part group by part group, those returned."""
    c = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 8).alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("want"), F.count_if(F.col("l_returnflag") == "N").alias("have"))
    m = c.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.when(F.col("want") > 0, F.struct("k", "want")))).alias("targets"), F.map_from_entries(F.collect_list(F.when(F.col("have") > 0, F.struct("k", "have")))).alias("stock"))
    return m.select("l_suppkey", graph.targets_met(F.col("targets"), F.col("stock")).alias("met"))


QUERIES = {f.__name__: f for f in (parse_tool_calls, flatten_search_response, metric_namespace, trajectory_text_clean, goal_search_pairs, product_lookup_modes, purchase_reward, convert_code_benchmark, base_materials, recipe_chain, tag_satisfying_items, target_satisfied)}

_MAKE = """i AS (SELECT item, part, max(1 + (item + k) % 3) AS uses FROM (SELECT p_partkey AS item, p_partkey // k AS part, k FROM part, (VALUES (4), (7)) x(k) WHERE p_partkey > 0 AND p_partkey % 3 <> 0) GROUP BY 1, 2)"""
_BRAND = "'find a ' || p_name || ' of ' || lower(p_brand)"
ORACLES = {
    "parse_tool_calls": """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'think <search> ' || role || chr(10) || '</search>' WHEN 1 THEN '<search> open <access>page/' || conv_id || '</access>' WHEN 2 THEN 'no call ' || role WHEN 3 THEN '<answer>' || role || '</answer>' ELSE '<access>u' END AS cut,
        CASE turn % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'access' WHEN 3 THEN 'answer' END AS kind, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN 'page/' || conv_id WHEN 3 THEN role END AS argument FROM conversations""",
    "flatten_search_response": "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR, l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, l_discount) - 1)::INT AS pos, l_partkey::VARCHAR AS text, l_returnflag AS source, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_discount END AS score FROM lineitem",
    "metric_namespace": "SELECT c_custkey, unnest(['training/actor_loss/avg', 'clip/clip_ratio', 'staleness/version_stats/v_theta', 'misc/other', 'time/step']) AS metric, unnest([c_acctbal, c_nationkey::DOUBLE, c_custkey::DOUBLE, c_custkey::DOUBLE, c_acctbal]) AS value FROM customer",
    "trajectory_text_clean": "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'im after a ' || lower(p_name) ELSE lower(p_name) END AS goal FROM part",
    "goal_search_pairs": f"WITH g AS (SELECT {_BRAND} AS goal, p_partkey AS place, unnest([p_name, lower(p_brand)]) AS search FROM part) SELECT goal, search FROM g WHERE goal IN (SELECT goal FROM g GROUP BY 1 HAVING min(place) BETWEEN 20 AND 1499)",
    "product_lookup_modes": "WITH k AS (SELECT p_partkey AS item, unnest(['<c> ' || p_type, '<q> ' || p_name, '<a> ' || p_brand, '<a> size ' || p_size]) AS query_id FROM part UNION ALL SELECT p_partkey, '<r> ' FROM (SELECT p_partkey FROM part ORDER BY ('0x' || substr(md5('4|' || p_partkey), 1, 8))::BIGINT, p_partkey LIMIT 50)) SELECT query_id, count(*) AS n, min(item) AS first, max(item) AS last FROM k GROUP BY 1",
    "convert_code_benchmark": """WITH c AS (SELECT l_orderkey, list({'i': l_partkey::VARCHAR, 'o': l_suppkey::VARCHAR} ORDER BY l_linenumber % 2 DESC, l_linenumber, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS c FROM lineitem GROUP BY 1)
        SELECT CASE WHEN l_orderkey % 7 > 0 THEN l_orderkey ELSE row_number() OVER (ORDER BY l_orderkey) - 1 END::VARCHAR AS query_id, (row_number() OVER (ORDER BY l_orderkey) - 1)::BIGINT AS idx, CASE WHEN l_orderkey % 7 > 0 THEN l_orderkey END::VARCHAR AS question_id, 'problem ' || l_orderkey AS question_title, (l_orderkey % 100)::VARCHAR AS contest_id, o_orderstatus AS platform, o_orderpriority AS difficulty,
        'Solve it.' || chr(10) || chr(10) || '### Question:' || chr(10) || 'problem ' || l_orderkey || chr(10) || chr(10) || '### Format: ' || CASE WHEN l_orderkey % 4 = 0 THEN 'Start from def f(x):' ELSE 'Read standard input.' END || chr(10) || chr(10) || '### Answer: (use the provided format with backticks)' || repeat(chr(10), 3) AS question,
        CASE WHEN l_orderkey % 4 = 0 THEN to_json({'inputs': list_transform(c, lambda x: x.i), 'outputs': list_transform(c, lambda x: x.o), 'fn_name': 'f' || l_orderkey})::VARCHAR ELSE to_json({'inputs': list_transform(c, lambda x: x.i || chr(10)), 'outputs': list_transform(c, lambda x: x.o || chr(10)), 'remote': false})::VARCHAR END AS input_output FROM c LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "base_materials": f"WITH RECURSIVE {_MAKE}, n AS (SELECT p_partkey AS target, p_partkey AS item, p_size::BIGINT AS need FROM part WHERE p_size > 45 UNION ALL SELECT n.target, i.part, ((need - n.item % 5 + n.item % 4) // (1 + n.item % 4) * uses)::BIGINT FROM n JOIN i ON i.item = n.item WHERE need > n.item % 5) SELECT target, item, sum(need - item % 5)::BIGINT AS needed FROM n WHERE need > item % 5 AND (item = 0 OR item % 3 = 0) GROUP BY 1, 2",
    "recipe_chain": f"WITH RECURSIVE {_MAKE}, n AS (SELECT p_partkey AS target, p_partkey AS item, 0 AS depth FROM part WHERE p_size > 45 AND p_partkey > 0 AND p_partkey % 3 <> 0 UNION ALL SELECT target, part, depth + 1 FROM n JOIN i USING (item) WHERE part > 0 AND part % 3 <> 0) SELECT target, count(*) AS recipes, max(depth) AS depth FROM n GROUP BY 1",
    "tag_satisfying_items": """WITH p AS (SELECT split_part(p_name, ' ', 1) AS w, p_partkey % 4 AS k, p_partkey % 2 AS odd FROM part), i AS (SELECT DISTINCT w || ['_planks', '_log', '_stem', '_wool'][k + 1] AS item FROM p), t AS (SELECT DISTINCT w, w || CASE odd WHEN 0 THEN '_logs' ELSE '_stems' END AS tag FROM p)
        SELECT tag, item FROM t JOIN i ON item IN (w || '_log', w || '_stem') UNION SELECT 'planks', item FROM i WHERE item LIKE '%\\_planks' ESCAPE '\\' UNION SELECT 'wool', item FROM i WHERE item LIKE '%\\_wool' ESCAPE '\\' UNION SELECT 'logs', item FROM i WHERE item LIKE '%\\_log' ESCAPE '\\' OR item LIKE '%\\_stem' ESCAPE '\\'""",
    "target_satisfied": "WITH c AS (SELECT l_suppkey, l_partkey % 8 AS k, count(*) FILTER (l_returnflag = 'R') AS want, count(*) FILTER (l_returnflag = 'N') AS have FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, bool_and(have >= want)::INT AS met FROM c GROUP BY 1",
}
