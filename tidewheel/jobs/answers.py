"""Pages and answers: chunks, tags, fences and numbers; blended scores; workflows' rounds, memories and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import agents, pages, scoring, workflows
from tidewheel.sources.adapters import rollouts, table, with_views

R = with_views("rollouts")
NOW = 1.7e9


def html_reduce(spark, d):
    return table(spark, d, "pages").select("page_id", pages.reduce_page("html").alias("text"))


def summarize_page_tags(spark, d):
    """A draft before the page, sometimes no summary, a second one that never ends, and fences that are open."""
    k = F.col("page_id")
    said = F.concat(F.lit("<title>draft</title>"), "html", F.when(k % 5 > 0, F.concat(F.lit("<summary> "), "url", F.lit("\n</summary>"))).otherwise(""), F.when(k % 7 == 0, "<summary> open").otherwise(""))
    own = F.concat(F.lit('["'), k.cast("string"), F.lit('"]'))
    points = F.when(k % 4 == 0, "none").when(k % 4 == 1, "```json open").when(k % 4 == 2, F.concat(F.lit("```json\n[0]\n``` then ```json\n"), own, F.lit("\n```"))).otherwise(F.concat(F.lit("```json "), own, F.lit(" ``` then ```json open")))
    t = table(spark, d, "pages").select("page_id", said.alias("said"), points.alias("points"))
    return t.select("page_id", pages.last_between(F.col("said"), "<title>", "</title>").alias("title"), pages.last_between(F.col("said"), "<summary>", "</summary>").alias("summary"), pages.last_fence(F.col("points")).alias("points"))


def bracket_number(spark, d):
    """Answers in brackets, and as the last number where there are none."""
    k, n = F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("it is ["), n, F.lit("] not [x"))).when(k % 4 == 1, F.concat(F.lit("[a b] or 1,2"), n)).when(k % 4 == 2, F.concat(F.lit("about 3,000.5 then -"), n)).otherwise("nothing")
    e = table(spark, d, "events").select("event_id", text.alias("t"))
    return e.select("event_id", pages.bracket_count(F.col("t")).alias("counted"), pages.bracket_or_number(F.col("t")).alias("answer"))


def extract_code_block(spark, d):
    """Fences of several kinds, short ones, and texts without any."""
    k = F.col("item_id")
    fence = lambda kind, body: F.concat(F.lit(f"```{kind}\n"), body, F.lit("\n```"))
    text = F.when(k % 4 == 0, F.concat(fence("python", F.col("text")), F.lit(" and "), fence("py", F.lit("x = 1")))).when(k % 4 == 1, F.concat(fence("", F.lit("an early block of enough length")), fence("PYTHON", F.concat(F.lit("import os\n"), "text")))).when(k % 4 == 2, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise("short")
    b = table(spark, d, "benchmark").select("item_id", text.alias("t"))
    return b.select("item_id", F.md5(pages.python_code(F.col("t"))).alias("code"), F.md5(pages.python_code(F.col("t"), markers=True)).alias("marked"))


def cover_em(spark, d):
    """Documents against an item each; every tenth answers a question of yes or no."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), F.col("text").alias("gold"))
    count = table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("items"))  # one row
    k = F.col("doc_id")
    a = table(spark, d, "documents").join(F.broadcast(count)).join(items, k % F.col("items") == F.col("b"))
    said = F.when(k % 10 == 0, "True").when(k % 10 == 1, "False").otherwise(F.col("text"))
    gold = F.when(k % 20 < 2, "yes").when(k % 10 < 2, "False").otherwise(F.col("gold"))
    return a.select("doc_id", scoring.cover_match(scoring.yes_no(said), scoring.yes_no(gold)).alias("cem"))


def best_over_golds(spark, d):
    """Every document against all items: even ones are right answers, odd ones augmented; a third of the documents has none of those."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark")
    best = lambda part: scoring.best_over_golds(docs, items.where(F.col("item_id") % 2 == part).select(F.col("text").alias("gold")))
    both = best(0).withColumnRenamed("best", "score").join(best(1).withColumnRenamed("best", "aug"), "doc_id")
    return both.select("doc_id", F.round(pages.blended(F.col("score"), F.when(F.col("doc_id") % 3 > 0, F.col("aug"))), 6).alias("best"))


def relative_since(spark, d):
    """Seconds, dates of three forms and spans before a fixed now."""
    k = F.col("event_id")
    of = lambda form: F.date_format("ts", form)
    text = F.when(k % 8 == 0, (k * 1.5).cast("string")).when(k % 8 == 1, of("yyyy-MM-dd HH:mm:ss")).when(k % 8 == 2, of("yyyy-MM-dd")).when(k % 8 == 3, of("yyyy-MM")).when(k % 8 == 4, F.concat((k % 9).cast("string"), F.lit(".5d"))).when(k % 8 == 5, F.concat((k % 23).cast("string"), F.lit(" h ago"))).when(k % 8 == 6, F.concat((k % 59).cast("string"), F.lit("m"))).otherwise(F.concat((k % 7).cast("string"), F.lit("y")))
    return table(spark, d, "events").select("event_id", F.round(pages.seconds_before(text, F.lit(NOW)), 3).alias("since"))


def verifier_metrics(spark, d):
    """Conversations as trajectories, turns as rounds whose text ends in a verdict."""
    n = F.length("text") % 3
    said = F.concat("text", F.when(n == 0, " ACCEPT").when(n == 1, " ACCEPT no REJECT").otherwise(""))
    r = table(spark, d, "conversations").select((F.col("conv_id") % 16).alias("workflow"), "conv_id", F.col("turn").alias("round"), workflows.verdict_of(said).alias("verdict"))
    out = workflows.verifier_metrics(r, ["workflow"], "conv_id")
    return out.select("workflow", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def agent_memory_stats(spark, d):
    """Turns as an agent's records: the model's, searches and pages read, some of them failed."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    kind = F.when(F.col("role") == "assistant", "llm_gen").when(F.col("role") == "user", "search_results").otherwise("webpage")
    n = F.length("text")
    text = F.when((F.col("role") == "user") & (n % 5 == 0), workflows.NOTHING_FOUND).when((F.col("role") == "system") & (n % 2 == 0), F.concat(F.lit(workflows.FIRST_PAGE), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    r = table(spark, d, "conversations").withColumn("w", words)
    r = r.select("conv_id", kind.alias("type"), text.alias("text"), F.lag("w").over(w).alias("input_tokens"), F.col("w").alias("output_tokens"))
    return workflows.memory_stats(r, ["conv_id"])


def router_metrics(spark, d):
    """Sequences as questions sent to one of two models; some answers name no route."""
    r = rollouts(spark, d)
    parsed, large, small_right, large_right = F.col("seq_len") > 2, F.col("model_key") == 1, F.col("traj_idx") % 2 == 0, F.col("reward") > 0
    decision = F.when(parsed, F.when(large, "large").otherwise("small"))
    routes = r.select((F.col("group_id") % 16).alias("workflow"), decision.alias("decision"), agents.router_reward(parsed, large, small_right, large_right).alias("reward"), small_right.alias("small_right"), large_right.alias("large_right"))
    out = workflows.router_metrics(routes, ["workflow"])
    return out.select("workflow", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def testgen_reward(spark, d):
    """Groups as sets of generated tests: the share valid, whether their verdict is the true one, what the final code passes."""
    g = rollouts(spark, d).groupBy("group_id").agg(F.avg((F.col("seq_len") > 4).cast("double")).alias("valid"), F.avg("reward").alias("final"), F.max("model_key").alias("k"))
    made = g.select("group_id", *workflows.testgen_rewards(F.when(F.col("group_id") % 10 > 0, F.col("valid")), F.col("k") == 1, F.col("final")))
    return made.select("group_id", *[F.round(c, 6).alias(c) for c in ("discrete", "continuous", "coupled")])


def reference_solution(spark, d):
    """Prompt and canonical solution as the one solution; none where either is missing."""
    b = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    j = table(spark, d, "documents").select("doc_id", "text").join(b, "doc_id", "left")
    canonical = F.when(F.col("quality") == 1, F.lit("    return 1\n"))
    solutions = F.when(F.col("text").isNotNull() & canonical.isNotNull(), F.array(F.concat("text", canonical))).otherwise(F.array().cast("array<string>"))
    return j.select("doc_id", F.size(solutions).alias("n"), F.md5(F.try_element_at(solutions, F.lit(1))).alias("solution"))


def resume_unjudged(spark, d):
    """Judged rows as they are, behind them the raw ones that none of them has; those without a successful verdict are to be judged."""
    judged = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, "success").otherwise("failed").alias("status"), (F.col("quality") == 1).cast("double").alias("mbe"))
    raw = table(spark, d, "documents").select("doc_id", "source")
    fresh = raw.join(judged.select("doc_id").distinct(), "doc_id", "left_anti")
    merged = judged.withColumn("previous", F.lit(True)).unionByName(fresh.withColumn("previous", F.lit(False)), allowMissingColumns=True)
    done = F.coalesce(F.col("status") == "success", F.lit(False))
    return merged.select("doc_id", "source", "previous", F.when(done, F.col("mbe")).alias("mbe"), (~done).alias("pending"))


def spawn_sequences(spark, d):
    """A conversation's first turn as the prompt, its second as the first answer, its third as spawned results, its last as the answer."""
    ids = F.transform(F.filter(F.split("text", "\\s+"), lambda w: w != ""), lambda w: (F.length(w) % 97).cast("int"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    turn = lambda n: F.coalesce(F.try_element_at("t", F.lit(n))["text"], F.lit(""))
    of = lambda n: F.transform(F.filter(F.split(turn(n), "\\s+"), lambda w: w != ""), lambda w: (F.length(w) % 97).cast("int"))
    said = lambda n: F.transform(of(n), lambda i: F.struct(i.alias("id"), (-i / 100).alias("logprob"), F.lit(n).alias("version")))
    results = F.when(F.col("conv_id") % 4 > 0, of(3)).otherwise(F.slice(of(3), 1, 0))
    made = c.select("conv_id", *workflows.spawn_sequence(of(1), said(2), results, said(4), F.lit(400)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return made.select("conv_id", F.size("input_ids").alias("n"), F.md5(F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",")).alias("ids"), F.array_join(F.transform("loss_mask", lambda i: i.cast("string")), "").alias("mask"), F.round(total(F.col("logprobs")), 6).alias("logprob"), F.aggregate("versions", F.lit(0), lambda a, v: a + v).cast("long").alias("versions"))


QUERIES = {f.__name__: f for f in (html_reduce, summarize_page_tags, bracket_number, extract_code_block, cover_em, best_over_golds, relative_since, verifier_metrics, agent_memory_stats, router_metrics, testgen_reward, reference_solution, resume_unjudged, spawn_sequences)}

_P = "[!-/:-@\\[-`{-~]"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '{_P}', ' ', 'g'), '\\s+'), lambda w: w <> ''))"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _between(x: str, a: str, b: str) -> str:
    return f"CASE WHEN contains({x}, '{a}') AND contains({x}, '{b}') THEN {_strip(f"string_split(string_split({x}, '{a}')[-1], '{b}')[1]")} END"


_IDS = "list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w: (length(w) % 97)::INT)"
_YES = lambda x: f"CASE {x} WHEN 'True' THEN 'yes' WHEN 'False' THEN 'no' ELSE {x} END"
_SAID = f"""t AS (SELECT page_id, '<title>draft</title>' || html || CASE WHEN page_id % 5 > 0 THEN '<summary> ' || url || chr(10) || '</summary>' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '<summary> open' ELSE '' END AS said,
CASE page_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '```json open' WHEN 2 THEN '```json' || chr(10) || '[0]' || chr(10) || '``` then ```json' || chr(10) || '["' || page_id || '"]' || chr(10) || '```' ELSE '```json ["' || page_id || '"] ``` then ```json open' END AS points FROM pages)"""
ORACLES = {
    "summarize_page_tags": f"WITH {_SAID} SELECT page_id, {_between('said', '<title>', '</title>')} AS title, {_between('said', '<summary>', '</summary>')} AS summary, CASE WHEN page_id % 4 = 2 THEN '[\"' || page_id || '\"]' END AS points FROM t",
    "bracket_number": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN v ELSE '' END AS counted, CASE event_id % 4 WHEN 0 THEN v WHEN 1 THEN 'a b' WHEN 2 THEN '-' || v ELSE '' END AS answer FROM (SELECT event_id, value::DECIMAL(18,2)::VARCHAR AS v FROM events)",
    "extract_code_block": f"""WITH c AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN {_strip('text')} WHEN 1 THEN {_strip("'import os' || chr(10) || text")} WHEN 2 THEN {_strip('text')} ELSE '' END AS c, item_id % 4 AS k FROM benchmark)
SELECT item_id, CASE WHEN length(c) >= 20 THEN md5(c) WHEN k = 0 THEN md5({_strip("'```python' || chr(10) || c || chr(10) || '``` and ```py' || chr(10) || 'x = 1' || chr(10) || '```'")}) END AS code,
CASE WHEN length(c) >= 20 AND (k < 2 OR len(list_filter(['def ', 'class ', 'import ', 'from ', 'print(', 'if __name__', 'for ', 'while ', 'return '], lambda m: contains(c, m))) > 0) THEN md5(c) END AS marked FROM c""",
    "cover_em": f"""WITH a AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE d.text END AS said, CASE WHEN doc_id % 20 < 2 THEN 'yes' WHEN doc_id % 10 < 2 THEN 'False' ELSE b.text END AS gold FROM documents d JOIN benchmark b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id),
m AS (SELECT doc_id, {_YES('said')} AS said, {_YES('gold')} AS gold FROM a) SELECT doc_id, (len(list_filter({_words('gold')}, lambda w: NOT list_contains({_words('said')}, w))) = 0)::INT AS cem FROM m""",
    "best_over_golds": f"""WITH p AS (SELECT doc_id, {_words('text')} AS w FROM documents), g AS (SELECT item_id, {_words('text')} AS v FROM benchmark), s AS (SELECT doc_id, item_id, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM p) JOIN (SELECT item_id, unnest(v) AS x FROM g) USING (x) GROUP BY 1, 2),
b AS (SELECT doc_id, coalesce(max(2.0::DOUBLE * k / (len(w) + len(v))) FILTER (item_id % 2 = 0), 0.0) AS s, coalesce(max(2.0::DOUBLE * k / (len(w) + len(v))) FILTER (item_id % 2 = 1), 0.0) AS a FROM p LEFT JOIN s USING (doc_id) LEFT JOIN g USING (item_id) GROUP BY 1)
SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN s ELSE s * 0.7::DOUBLE + greatest(a, s) * (1 - 0.7::DOUBLE) END, 6) AS best FROM b""",
    "relative_since": f"""SELECT event_id, round(CASE event_id % 8 WHEN 0 THEN event_id * 1.5::DOUBLE WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN epoch(date_trunc('day', ts)) WHEN 3 THEN epoch(date_trunc('month', ts)) WHEN 4 THEN {NOW} - (event_id % 9 + 0.5::DOUBLE) * 86400 WHEN 5 THEN {NOW} - event_id % 23 * 3600 WHEN 6 THEN {NOW} - event_id % 59 * 60 END, 3) AS since FROM events""",
    "verifier_metrics": """WITH r AS (SELECT conv_id % 16 AS workflow, conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' ELSE regexp_extract_all(text, '(ACCEPT|REJECT)')[-1] END AS v FROM conversations),
t AS (SELECT workflow, conv_id, count(*) AS n, count(*) FILTER (v = 'ACCEPT') AS a, count(v) AS told, arg_max(coalesce(v = 'ACCEPT', false)::INT, turn) AS ok FROM r GROUP BY 1, 2)
SELECT workflow, round(sum(a) / nullif(sum(told), 0), 6) AS accept_rate, round(avg(ok), 6) AS approve_rate, round(avg(1 - ok), 6) AS retry_rate, round(avg(n), 6) AS avg_turns FROM t GROUP BY 1""",
    "agent_memory_stats": """WITH r AS (SELECT conv_id, role, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w, contains(text, 'No search results are found') AS x, contains(text, '>>>> Page 1 >>>>') AS y, turn, text FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) FILTER (role = 'assistant') AS llm_gens, sum(CASE WHEN role = 'assistant' THEN coalesce(before, 0) ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'assistant' THEN w ELSE 0 END)::BIGINT AS output_tokens, count(*) FILTER (role = 'user') AS searches, count(*) FILTER (role = 'user' AND NOT (n % 5 = 0 OR x)) AS searches_ok, count(*) FILTER (role = 'user' AND (n % 5 = 0 OR x)) AS searches_failed,
count(*) FILTER (role NOT IN ('user', 'assistant')) AS pages, count(*) FILTER (role = 'system' AND (n % 2 = 0 OR y)) AS pages_ok, count(*) FILTER (role = 'system' AND NOT (n % 2 = 0 OR y)) AS pages_failed FROM p GROUP BY 1""",
    "router_metrics": f"{R}, r AS (SELECT group_id % 16 AS workflow, seq_len > 2 AS p, model_key = 1 AS l, traj_idx % 2 = 0 AS s, reward > 0 AS b FROM rollouts) SELECT workflow, round(avg((p AND NOT l)::INT), 6) AS small_route_rate, round(avg(CASE WHEN NOT p THEN -0.5 WHEN NOT l AND s THEN 1.0 WHEN l AND b AND NOT s THEN 1.0 WHEN l AND b THEN 0.5 ELSE 0.0 END), 6) AS router_reward, round(avg(s::INT), 6) AS small_right_rate, round(avg(b::INT), 6) AS large_right_rate FROM r GROUP BY 1",
    "testgen_reward": f"{R}, g AS (SELECT group_id, CASE WHEN group_id % 10 = 0 THEN 0.0 ELSE avg((seq_len > 4)::INT) END AS v, avg(reward) AS f, max(model_key) = 1 AS k FROM rollouts GROUP BY 1) SELECT group_id, round(0.5::DOUBLE * ((v >= 1)::INT + (v >= 1 AND k)::INT), 6) AS discrete, round(0.5::DOUBLE * (v + (v >= 0.99 AND k)::INT), 6) AS continuous, round(f + v, 6) AS coupled FROM g",
    "reference_solution": "WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT doc_id, (text IS NOT NULL AND coalesce(q, 0) = 1)::INT AS n, CASE WHEN coalesce(q, 0) = 1 THEN md5(text || '    return 1' || chr(10)) END AS solution FROM documents LEFT JOIN l USING (doc_id)",
    "resume_unjudged": "SELECT doc_id, NULL::VARCHAR AS source, true AS previous, CASE WHEN toxic = 0 THEN (quality = 1)::INT::DOUBLE END AS mbe, toxic IS DISTINCT FROM 0 AS pending FROM labels UNION ALL SELECT doc_id, source, false, NULL, true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "spawn_sequences": f"""WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) AS t FROM conversations GROUP BY 1), i AS (SELECT conv_id, {", ".join(f"{_IDS.format(x=f"coalesce(t[{n}], '')")} AS p{n}" for n in range(1, 5))} FROM c),
s AS (SELECT conv_id, p1, p2, CASE WHEN conv_id % 4 > 0 THEN p3 ELSE [] END AS p3, CASE WHEN conv_id % 4 > 0 AND len(p3) > 0 THEN p4 ELSE [] END AS p4 FROM i), a AS (SELECT *, p1 || p2 || p3 || p4 AS ids FROM s), f AS (SELECT *, len(ids) <= 400 AS ok FROM a)
SELECT conv_id, CASE WHEN ok THEN len(ids)::INT END AS n, CASE WHEN ok THEN md5(array_to_string(ids, ',')) END AS ids, CASE WHEN ok THEN repeat('0', len(p1)) || repeat('1', len(p2)) || repeat('0', len(p3)) || repeat('1', len(p4)) END AS mask,
CASE WHEN ok THEN round(coalesce(list_sum(list_transform(p2 || p4, lambda x: -x / 100.0::DOUBLE)), 0), 6) END AS logprob, CASE WHEN ok THEN (-len(p1) + 2 * len(p2) - len(p3) + 4 * len(p4))::BIGINT END AS versions FROM f""",
}
