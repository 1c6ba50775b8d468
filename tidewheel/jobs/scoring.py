"""Scoring and token-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import datasets, packing, scoring, tokens
from tidewheel.sources.adapters import rollouts, table, token_rows, with_views

T, R = with_views("token_rows"), with_views("rollouts")


def _answers(spark, d, words: bool = False):
    """Every document's text against one benchmark item; ids go round all items, so each is scored."""
    own = scoring.answer_words(F.col("text")) if words else F.col("text")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), own.alias("gold"))
    all_ = table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("items"))  # one row
    docs = table(spark, d, "documents").select("doc_id", own.alias("text")).join(F.broadcast(all_))
    return docs.join(b, F.col("doc_id") % F.col("items") == F.col("b"))


def normalize_answer(spark, d):
    n = scoring.normalize_answer(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(n).alias("n"), F.md5(n).alias("normalized"))


def exact_sub_match(spark, d):
    """Against the item's text and its last word as the two right answers."""
    golds = F.array(F.col("gold"), F.regexp_extract("gold", "(\\S+)\\s*$", 1))
    return _answers(spark, d).select("doc_id", scoring.matches_any(F.col("text"), golds).alias("em"), scoring.matches_any(F.col("text"), golds, inside=True).alias("sub"))


def token_f1(spark, d):
    """Words of a text and of an item are made once each, before they are compared."""
    return _answers(spark, d, words=True).select("doc_id", F.round(scoring.word_f1(F.col("text"), F.col("gold")), 6).alias("f1"))


def answer_format_ok(spark, d):
    tags = ["article", "nav", "title"]
    return table(spark, d, "pages").select("page_id", scoring.balanced_tags(F.col("html"), tags).alias("ok"), scoring.count_of(F.col("html"), "<p").alias("paragraphs"))


def strip_cot_suffix(spark, d):
    """Texts of which some end with the request to reason in steps, in one case or another."""
    ask = "Let's think step by step and output the final answer within \\boxed{}."
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n" + ask))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" " + ask.upper().replace("BOXED", "boxed") + " \n"))).otherwise(F.concat(F.lit(ask), "text"))
    return table(spark, d, "documents").select("doc_id", F.md5(datasets.strip_suffix(text)).alias("stripped"))


def filter_by_token_length(spark, d):
    return table(spark, d, "documents").where(F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")) <= 300).select("doc_id", "lang")


def attach_query_ids(spark, d):
    """Ids by place in the order of ``doc_id``, whatever ids are missing or repeated before."""
    rows = table(spark, d, "documents").select("doc_id", "source").where("source <> 'web'")
    return datasets.numbered(rows, "doc_id", "place").select(F.format_string("%s-%08d", F.lit("docs"), "place").alias("query_id"), "doc_id")


def prompt_from_problem(spark, d):
    m = datasets.prompt_messages(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.to_json(m).alias("messages"), F.concat(F.lit("\\boxed{"), F.col("item_id").cast("string"), F.lit("}")).alias("answer"))


def version_bounds(spark, d):
    low, high = tokens.version_bounds(F.col("versions"))
    return token_rows(spark, d).select("conv_id", low.alias("min_version"), high.alias("max_version"), F.size("input_ids").alias("n"))


def masked_stats(spark, d):
    r = token_rows(spark, d)
    s = r.select("conv_id", *tokens.masked_stats(F.col("logprobs"), F.col("loss_mask"), "lp"))
    return s.select("conv_id", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


def staleness_stats(spark, d):
    t = tokens.explode_tokens(token_rows(spark, d), "versions", "loss_mask", keep=("conv_id",)).where("loss_mask = 1 AND versions >= 0")
    gap = F.lit(20) - F.col("versions")
    return t.groupBy((F.col("conv_id") % 16).alias("batch")).agg(F.round(F.avg(gap), 6).alias("mean"), F.max(gap).alias("most"), F.min(gap).alias("least"), F.count(F.lit(1)).alias("tokens"))


def kl_estimate(spark, d):
    t = tokens.explode_tokens(token_rows(spark, d), "logprobs", keep=("conv_id",))
    gap = F.col("logprobs") + 0.35
    return t.groupBy("conv_id").agg(*[F.round(F.sum(tokens.kl(gap, k)), 5).alias(k) for k in ("k1", "k2", "k3")])


def _gaps(spark, d):
    r = rollouts(spark, d)
    return r.withColumn("advantage", F.col("reward") - 0.25).withColumn("ratio", F.exp((F.col("logprob_gap") - 0.5)))


def ppo_token_loss(spark, d):
    g = _gaps(spark, d).withColumn("loss", tokens.ppo_token_loss(F.col("ratio"), F.col("advantage"), low=0.2, high=0.28, dual=3.0))
    return g.groupBy((F.col("group_id") % 32).alias("batch")).agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("ratio"), 6).alias("ratio"))


def sapo_token_loss(spark, d):
    g = _gaps(spark, d).withColumn("loss", tokens.sapo_token_loss(F.col("ratio"), F.col("advantage"), tau_up=1.0, tau_down=1.05))
    return g.groupBy((F.col("group_id") % 32).alias("batch")).agg(F.round(F.avg("loss"), 6).alias("loss"))


def critic_loss(spark, d):
    g = _gaps(spark, d).withColumn("loss", tokens.critic_loss(F.col("logprob_gap"), F.col("reward") / 2, F.col("advantage"), 0.2))
    return g.groupBy((F.col("group_id") % 32).alias("batch")).agg(F.round(F.avg("loss"), 6).alias("loss"))


def m2po_clip_range(spark, d):
    """Batches of consecutive groups, so that their number and not their size grows; gaps go beyond 1, and some batches have few."""
    g = _gaps(spark, d).withColumn("batch", F.floor(F.col("group_id") / 16).cast("long")).withColumn("gap", (F.col("logprob_gap") - 0.5) * (1 + F.col("batch") % 5))
    c = tokens.clip_range(g, "batch", "gap", ((F.col("advantage") * F.col("gap")) > 0) & (F.col("batch") % 7 != 0) & (F.col("seq_len") > 30), threshold=0.04)
    return c.select("batch", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def gae_advantages(spark, d):
    """Rewards at the last generated token, values from log-probabilities; sums by conversation."""
    r = token_rows(spark, d).select("conv_id", "loss_mask", F.transform("logprobs", lambda x: x / 2).alias("values"), F.transform("loss_mask", lambda m, i: F.when(i == F.size("loss_mask") - 1, 1.0).otherwise(-0.01)).alias("rewards"))
    out = tokens.gae(r, gamma=0.99, lam=0.95)
    return out.select("conv_id", F.round(tokens.array_sum(F.col("advantages")), 5).alias("total"), F.size("advantages").alias("n"))


def _batches(spark, d):
    """Batches of 256 consecutive groups: their number grows with the table, their size doesn't."""
    return rollouts(spark, d).select(F.floor(F.col("group_id") / 256).cast("long").alias("batch"), "seq_no", "seq_len")


def pack_token_budget(spark, d):
    return packing.pack_token_budget(_batches(spark, d), "batch", "seq_no", "seq_len", capacity=512, min_groups=4, divisor=2)


def balance_batches(spark, d):
    return packing.balance_batches(_batches(spark, d), "batch", "seq_no", "seq_len", 8)


def contiguous_partition(spark, d):
    return packing.contiguous_partition(_batches(spark, d), "batch", "seq_no", "seq_len", 8)


QUERIES = {f.__name__: f for f in (normalize_answer, exact_sub_match, token_f1, answer_format_ok, strip_cot_suffix, filter_by_token_length, attach_query_ids, prompt_from_problem, version_bounds, masked_stats, staleness_stats, kl_estimate, ppo_token_loss, sapo_token_loss, critic_loss, m2po_clip_range, gae_advantages, pack_token_budget, balance_batches, contiguous_partition)}

_P = "[!-/:-@\\[-`{-~]"


def _norm(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '{_P}', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '{_P}', ' ', 'g'), '\\s+'), lambda w: w <> ''))"


def _f1(p: str, g: str) -> str:
    return f"CASE WHEN len(list_intersect({_words(p)}, {_words(g)})) > 0 THEN 2.0::DOUBLE * len(list_intersect({_words(p)}, {_words(g)})) / (len({_words(p)}) + len({_words(g)})) ELSE 0.0 END"


_A = "a AS (SELECT doc_id, d.text, b.text AS gold FROM documents d JOIN benchmark b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id)"
_ASK = "Let''s think step by step and output the final answer within \\boxed{}."
_G = f"{R}, g AS (SELECT group_id % 32 AS batch, reward, logprob_gap, reward - 0.25 AS advantage, exp(logprob_gap - 0.5) AS ratio FROM rollouts)"
_M2PO = f"""{R}, g AS (SELECT *, (logprob_gap - 0.5) * (1 + batch % 5) AS gap FROM (SELECT group_id // 16 AS batch, reward - 0.25 AS advantage, logprob_gap, seq_len FROM rollouts)),
    m AS (SELECT batch, CASE WHEN advantage * gap > 0 AND batch % 7 <> 0 AND seq_len > 30 THEN gap * gap END AS m2 FROM g),
    c AS (SELECT batch, m2, sum(m2) OVER w / nullif(count(m2) OVER w, 0) AS upto FROM m WINDOW w AS (PARTITION BY batch ORDER BY m2 NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
ORACLES = {
    # the recursion in closed form: a token's delta counts in all advantages up to its own, by falling powers of gamma times lambda
    "gae_advantages": f"""{T}, t AS (SELECT conv_id, len(loss_mask) AS n, unnest(loss_mask) AS m, unnest(logprobs) / 2 AS v, unnest(range(1, len(loss_mask) + 1)) AS i FROM token_rows), o AS (SELECT *, CASE WHEN i = n THEN 1.0::DOUBLE ELSE -0.01::DOUBLE END AS r FROM t WHERE m = 1),
    k AS (SELECT conv_id, r + 0.99::DOUBLE * coalesce(lead(v) OVER w, 0) - v AS d, row_number() OVER w AS j FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)), s AS (SELECT conv_id, sum(d * (1 - pow(0.99::DOUBLE * 0.95, j)) / (1 - 0.99::DOUBLE * 0.95)) AS total FROM k GROUP BY 1)
    SELECT conv_id, round(coalesce(total, 0), 5) AS total, len(loss_mask)::INT AS n FROM token_rows LEFT JOIN s USING (conv_id)""",
    "normalize_answer": f"SELECT doc_id, length({_norm('text')})::INT AS n, md5({_norm('text')}) AS normalized FROM documents",
    "strip_cot_suffix": f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '\\s+$', '') WHEN doc_id % 3 = 1 THEN regexp_replace(text, '\\s+$', '') ELSE '{_ASK}' || text END) AS stripped FROM documents",
    "exact_sub_match": f"WITH {_A}, n AS (SELECT doc_id, {_norm('text')} AS t, {_norm('gold')} AS g, {_norm("regexp_extract(gold, '(\\S+)\\s*$', 1)")} AS w FROM a) SELECT doc_id, (t = g OR t = w)::INT AS em, (contains(t, g) OR contains(t, w))::INT AS sub FROM n",
    "token_f1": f"WITH {_A} SELECT doc_id, round({_f1('text', 'gold')}, 6) AS f1 FROM a",
    "answer_format_ok": "WITH c AS (SELECT page_id, html, " + ", ".join(f"len(html) - len(replace(html, '<{t}', '')) AS o{i}, len(html) - len(replace(html, '</{t}>', '')) AS c{i}" for i, t in enumerate(("article", "nav", "title"))) + " FROM pages) SELECT page_id, " + " AND ".join(f"o{i} / {len(t) + 1} = c{i} / {len(t) + 3} AND c{i} <= {len(t) + 3}" for i, t in enumerate(("article", "nav", "title"))) + " AS ok, ((len(html) - len(replace(html, '<p', ''))) // 2)::INT AS paragraphs FROM c",
    "filter_by_token_length": "SELECT doc_id, lang FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 300",
    "attach_query_ids": "SELECT format('docs-{:08d}', row_number() OVER (ORDER BY doc_id) - 1) AS query_id, doc_id FROM documents WHERE source <> 'web'",
    "prompt_from_problem": """SELECT item_id, to_json([{'role': 'user', 'content': text}])::VARCHAR AS messages, '\\boxed{' || item_id || '}' AS answer FROM benchmark""",
    "version_bounds": f"{T} SELECT conv_id, coalesce(list_min(list_filter(versions, lambda v: v > 0)), 0) AS min_version, list_max(versions) AS max_version, len(input_ids)::INT AS n FROM token_rows",
    "masked_stats": f"{T}, m AS (SELECT conv_id, list_transform(list_filter(list_zip(logprobs, loss_mask), lambda x: x[2] = 1), lambda x: x[1]) AS k FROM token_rows) SELECT conv_id, round(list_avg(k), 6) AS lp_avg, round(list_min(k), 6) AS lp_min, round(list_max(k), 6) AS lp_max, round(list_sum(k), 6) AS lp_sum FROM m",
    "staleness_stats": f"{T}, t AS (SELECT conv_id, unnest(versions) AS v, unnest(loss_mask) AS m FROM token_rows) SELECT conv_id % 16 AS batch, round(avg(20 - v), 6) AS mean, max(20 - v) AS most, min(20 - v) AS least, count(*) AS tokens FROM t WHERE m = 1 AND v >= 0 GROUP BY 1",
    "kl_estimate": f"{T}, t AS (SELECT conv_id, greatest(-10.0, least(10.0, unnest(logprobs) + 0.35::DOUBLE)) AS d FROM token_rows) SELECT conv_id, round(sum(d), 5) AS k1, round(sum(d * d / 2), 5) AS k2, round(sum(exp(-d) - 1 + d), 5) AS k3 FROM t GROUP BY 1",
    "ppo_token_loss": f"{_G}, l AS (SELECT batch, ratio, advantage, greatest(-advantage * ratio, -advantage * greatest(0.8::DOUBLE, least(1.28::DOUBLE, ratio))) AS w FROM g) SELECT batch, round(avg(CASE WHEN advantage < 0 THEN least(-advantage * 3.0, w) ELSE w END), 6) AS loss, round(avg(ratio), 6) AS ratio FROM l GROUP BY 1",
    "sapo_token_loss": f"{_G}, l AS (SELECT *, CASE WHEN advantage > 0 THEN 1.0::DOUBLE ELSE 1.05::DOUBLE END AS tau FROM g) SELECT batch, round(avg(-(4 / tau) / (1 + exp(-tau * (ratio - 1))) * advantage), 6) AS loss FROM l GROUP BY 1",
    "critic_loss": f"{_G}, l AS (SELECT batch, logprob_gap AS v, advantage AS t, reward / 2 + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, logprob_gap - reward / 2)) AS n FROM g) SELECT batch, round(avg(0.5 * greatest((v - t) * (v - t), (n - t) * (n - t))), 6) AS loss FROM l GROUP BY 1",
    "m2po_clip_range": f"{_M2PO}, t AS (SELECT batch, count(m2) AS n, avg(m2) AS mean, sqrt(coalesce(max(m2) FILTER (upto < 0.04), min(m2))) AS tau FROM c GROUP BY 1) SELECT batch, round(CASE WHEN n = 0 OR mean <= 0.04 THEN 0.95 ELSE least(1 - exp(-tau), 0.95) END, 6) AS low, round(CASE WHEN n = 0 OR mean <= 0.04 THEN 20.0 ELSE least(exp(tau) - 1, 20.0) END, 6) AS high FROM t",
}
