"""Training sequences over conversations and rollouts: merging, padding, packing, routing, advantages and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import curation, datasets, evaluation, packing, tokens
from tidewheel.sources.adapters import outcomes, rollouts, table, token_rows, with_views

T, O = with_views("token_rows"), with_views("outcomes")


def _text(*columns: str):
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in columns]


def agent_turns(spark, d):
    """Assistant turns as generations: each reads all turns before it, but every fifth without turn 0."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(F.filter(F.split("text", "\\s+"), lambda w: w != ""), lambda w: (F.length(w) % 97).cast("int")).alias("ids"))
    own = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "ids"))).alias("all"))
    each = own.select("conv_id", "all", F.explode("all").alias("t")).where("t.role = 'assistant'")
    seen = F.filter("all", lambda x: (x["turn"] < F.col("t.turn")) & ((F.col("t.turn") % 5 != 4) | (x["turn"] > 0)))
    return each.select("conv_id", F.col("t.turn").alias("turn"), F.flatten(F.transform(seen, lambda x: x["ids"])).alias("input_ids"), F.col("t.ids").alias("output_ids"), F.transform("t.ids", lambda i: -i / 100).alias("logprobs"), F.transform("t.ids", lambda _: F.col("t.turn").cast("int")).alias("versions"))


def merge_prefix_turns(spark, d):
    merged = tokens.merge_prefix_turns(agent_turns(spark, d), ["conv_id"], "turn")
    s = merged.select("conv_id", F.explode("sequences").alias("s")).select("conv_id", "s.*")
    return s.select("conv_id", *_text("input_ids", "loss_mask", "versions"), F.round(tokens.array_sum(F.col("logprobs")), 6).alias("logprob"))


def pad_sequences(spark, d):
    t = token_rows(spark, d).withColumn("batch", F.floor(F.col("conv_id") / 8).cast("long"))
    padded = tokens.pad_batch(t.select("batch", "conv_id", "input_ids", "versions"), "batch", "input_ids", {"input_ids": F.lit(0), "versions": F.lit(-1)})
    return padded.select("batch", "conv_id", *_text("input_ids", "versions", "attention_mask"))


def pack_sequences(spark, d):
    t = token_rows(spark, d).withColumn("batch", F.floor(F.col("conv_id") / 8).cast("long"))
    return tokens.pack_batch(t, "batch", "conv_id", ["input_ids", "loss_mask"]).select("batch", *_text("cu_seqlens", "input_ids", "loss_mask"))


def route_tokens_by_model(spark, d):
    """Tokens come from three models by their id; conversations of every fifth id name none."""
    ids = F.when(F.col("conv_id") % 5 > 0, F.transform("input_ids", lambda x: ((x + F.col("conv_id")) % 3).cast("int")))
    routed = tokens.route_tokens(token_rows(spark, d).withColumn("model_ids", ids), [0, 1])
    return routed.select("conv_id", "model", *_text("loss_mask"))


def compute_advantages(spark, d):
    t = token_rows(spark, d).select("conv_id", "loss_mask", "logprobs", F.transform("logprobs", lambda x: x * 1.25).alias("ref_logprobs"), F.transform("logprobs", lambda x: x / 2).alias("values"), (F.col("conv_id") % 3).cast("double").alias("reward"))
    a = tokens.advantages(t, gamma=0.99, lam=0.95, kl_weight=0.1)
    return a.select("conv_id", *[F.round(tokens.array_sum(F.col(c)), 5).alias(c) for c in ("kl_rewards", "tot_rewards", "advantages", "returns")])


def redistribute_ranks(spark, d):
    r = rollouts(spark, d).select(F.floor(F.col("group_id") / 256).cast("long").alias("batch"), "seq_no", "seq_len")
    return packing.redistribute_ranks(r, "batch", "seq_no", "seq_len", granularity=4, ranks=8).select("batch", "seq_no", "segment", "rank")


def batch_positions(spark, d):
    """The place of every outcome in the order of arrival."""
    return datasets.numbered(outcomes(spark, d), "seq_no", "position").select("prompt_id", "seq_no", F.col("position").cast("long").alias("position"))


def smoothed_waits(spark, d):
    """Exponential averages of the waits and steps of every user's sessions, and the share of waiting."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("wait"), (F.col("value") + F.col("event_id") % 7).alias("step"))
    s = curation.smoothed(e, ["user_id"], ["event_id"], ["wait", "step"], 0.2)
    return s.select("user_id", "n", F.round("wait", 6).alias("wait"), F.round("step", 6).alias("step"), F.round(curation.wait_fraction(F.col("wait"), F.col("step")), 6).alias("fraction"))


def expand_eval_runs(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("dataset"), "doc_id")
    return evaluation.expand_runs(s, 4)


QUERIES = {f.__name__: f for f in (merge_prefix_turns, pad_sequences, pack_sequences, route_tokens_by_model, compute_advantages, redistribute_ranks, batch_positions, smoothed_waits, expand_eval_runs)}

_TURNS = "t AS (SELECT conv_id, turn, role = 'assistant' AS own, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: (length(w) % 97)::INT) AS ids FROM conversations)"


def _kind(own: str, since: int) -> str:
    """The sequence that all assistant turns of one kind grow to, up to the last of them."""
    return f"""SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(list_transform(ids, lambda x: ({own})::INT) ORDER BY turn)) AS mask, flatten(list(list_transform(ids, lambda x: CASE WHEN {own} THEN turn ELSE -1 END) ORDER BY turn)) AS versions
        FROM t JOIN (SELECT conv_id, max(turn) AS last FROM t WHERE {own} GROUP BY 1) USING (conv_id) WHERE turn BETWEEN {since} AND last GROUP BY 1"""


ORACLES = {
    "compute_advantages": f"""{T}, t AS (SELECT conv_id, len(loss_mask) AS n, unnest(loss_mask) AS m0, unnest(logprobs) AS lp, unnest(range(0, len(loss_mask))) AS i FROM token_rows),
    h AS (SELECT *, lp / 2 AS v, coalesce(lead(m0) OVER w, 0) AS m, coalesce(lead(lp) OVER w, 0) AS nx FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)), g AS (SELECT *, -0.1::DOUBLE * greatest(-10, least(10, (nx - nx * 1.25::DOUBLE) * m)) AS kl FROM h),
    r AS (SELECT *, CASE WHEN i = n - 1 THEN 0 ELSE kl END + CASE WHEN i = greatest(n - 2, 0) THEN conv_id % 3 ELSE 0 END AS tot FROM g), o AS (SELECT conv_id, tot + 0.99::DOUBLE * coalesce(lead(v) OVER w, 0) - v AS d, row_number() OVER w AS j FROM r WHERE m = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    a AS (SELECT conv_id, sum(d * (1 - pow(0.99::DOUBLE * 0.95, j)) / (1 - 0.99::DOUBLE * 0.95)) AS adv FROM o GROUP BY 1), s AS (SELECT conv_id, sum(kl) AS kl, sum(tot) AS tot, sum(v) AS v FROM r GROUP BY 1)
    SELECT conv_id, round(coalesce(kl, 0), 5) AS kl_rewards, round(coalesce(tot, 0), 5) AS tot_rewards, round(coalesce(adv, 0), 5) AS advantages, round(coalesce(adv, 0) + coalesce(v, 0), 5) AS returns FROM token_rows LEFT JOIN s USING (conv_id) LEFT JOIN a USING (conv_id)""",
    "merge_prefix_turns": f"WITH {_TURNS}, s AS ({_kind('own AND turn % 5 <> 4', 0)} UNION ALL {_kind('own AND turn % 5 = 4', 1)}) SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(mask, ',') AS loss_mask, array_to_string(versions, ',') AS versions, round(coalesce(-list_sum(list_transform(list_zip(ids, mask), lambda x: x[1] * x[2])) / 100.0::DOUBLE, 0.0), 6) AS logprob FROM s",
    "pad_sequences": f"{T}, p AS (SELECT conv_id // 8 AS batch, conv_id, input_ids, versions, range(max(len(input_ids)) OVER (PARTITION BY conv_id // 8) - len(input_ids)) AS more FROM token_rows) SELECT batch, conv_id, array_to_string(input_ids || list_transform(more, lambda x: 0), ',') AS input_ids, array_to_string(versions || list_transform(more, lambda x: -1), ',') AS versions, array_to_string(list_transform(input_ids, lambda x: 1) || list_transform(more, lambda x: 0), ',') AS attention_mask FROM p",
    "pack_sequences": f"{T}, e AS (SELECT conv_id // 8 AS batch, conv_id, input_ids, loss_mask, sum(len(input_ids)) OVER (PARTITION BY conv_id // 8 ORDER BY conv_id)::BIGINT AS upto FROM token_rows) SELECT batch, '0,' || string_agg(upto::VARCHAR, ',' ORDER BY conv_id) AS cu_seqlens, array_to_string(flatten(list(input_ids ORDER BY conv_id)), ',') AS input_ids, array_to_string(flatten(list(loss_mask ORDER BY conv_id)), ',') AS loss_mask FROM e GROUP BY 1",
    "route_tokens_by_model": f"{T}, m AS (SELECT conv_id, input_ids, loss_mask, unnest([0, 1])::INT AS model FROM token_rows), k AS (SELECT conv_id, model, CASE WHEN conv_id % 5 = 0 THEN loss_mask ELSE list_transform(list_zip(loss_mask, input_ids), lambda x: CASE WHEN (x[2] + conv_id) % 3 = model THEN x[1] ELSE 0 END) END AS own FROM m) SELECT conv_id, model, array_to_string(own, ',') AS loss_mask FROM k WHERE conv_id % 5 = 0 OR list_contains(own, 1)",
    "batch_positions": f"{O} SELECT prompt_id, seq_no, row_number() OVER (ORDER BY seq_no) - 1 AS position FROM outcomes",
    "smoothed_waits": "WITH a AS (SELECT user_id, value AS wait, value + event_id % 7 AS step, count(*) OVER w - row_number() OVER (w ORDER BY event_id) AS age, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id)), k AS (SELECT *, pow(0.8::DOUBLE, age) * CASE WHEN age = n - 1 THEN 1 ELSE 0.2 END AS weight FROM a), s AS (SELECT user_id, count(*) AS n, sum(weight * wait) AS wait, sum(weight * step) AS step FROM k GROUP BY 1) SELECT user_id, n, round(wait, 6) AS wait, round(step, 6) AS step, round(CASE WHEN step > 0 THEN least(wait / step, 0.95) ELSE 0 END, 6) AS fraction FROM s",
    "expand_eval_runs": "SELECT source AS dataset, doc_id, run_idx::INT AS run_idx FROM documents JOIN labels USING (doc_id), range(4) r(run_idx)",
}
