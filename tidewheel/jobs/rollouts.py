"""Rollout groups, normalisation and batch selection over the ``rollouts`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform, hash_uniform_sql
from tidewheel.operators import groups, selection
from tidewheel.sources.adapters import rollouts, with_views

KEYS = ["group_id", "model_key"]
ALL = "group_id, traj_idx, model_key, reward, min_version, seq_len, seq_no"
COLUMNS = ALL.split(", ")
NOW, LIMIT = 100, 24
FRESH = f"(min_version IS NULL OR {NOW} - min_version <= {LIMIT})"
W = with_views("rollouts")


def group_reward_stats(spark, d):
    return groups.group_reward_stats(rollouts(spark, d), KEYS).select(*KEYS, F.round("g_mean", 6).alias("g_mean"), F.round("g_std", 6).alias("g_std"), "n_trajs")


def zero_adv_flag(spark, d):
    return groups.zero_advantage(rollouts(spark, d), KEYS, "seq_no")


def filter_zero_adv(spark, d):
    r = rollouts(spark, d)
    return groups.keep_signal(r, groups.zero_advantage(r, KEYS, "seq_no"), KEYS).select(*COLUMNS)


def ingest_counters(spark, d):
    r = rollouts(spark, d)
    flagged = r.join(groups.zero_advantage(r, KEYS, "seq_no").drop("n_trajs"), KEYS)
    return flagged.groupBy("model_key").agg(F.count_if(F.col("zero_adv") == 0).alias("accepted"), F.count_if(F.col("zero_adv") == 1).alias("filtered"), F.count(F.lit(1)).alias("total"))


def reward_stats(spark, d):
    of = F.col("reward") - F.col("logprob_gap")
    return rollouts(spark, d).groupBy("model_key").agg(F.round(F.sum(of), 4).alias("sum"), F.count(of).alias("count"), F.round(F.min(of), 6).alias("min"), F.round(F.max(of), 6).alias("max"))


def drop_zero_std_rounddown(spark, d):
    r = rollouts(spark, d)
    stats = groups.group_reward_stats(r, KEYS).select(*KEYS, "g_std")
    return groups.round_down_survivors(r.join(stats, KEYS).withColumn("batch", F.col("group_id") % 64), "batch", F.col("g_std"), "seq_no", 16).select("batch", *COLUMNS)


def staleness_filter(spark, d):
    return rollouts(spark, d).where(selection.fresh(NOW, LIMIT)).select(*COLUMNS)


def route_sequences_by_model(spark, d):
    return groups.route_by_model(rollouts(spark, d).withColumn("model_key", F.when(F.col("traj_idx") == 7, -1).otherwise(F.col("model_key"))), [0, 1]).groupBy("target_model", "model_key").agg(F.count(F.lit(1)).alias("n"), F.sum("seq_len").alias("tokens"))


def reward_normalize(spark, d):
    out = groups.normalize(rollouts(spark, d), mean_over=["group_id"], std_over=["group_id"])
    return out.select("seq_no", F.round("normalized", 6).alias("normalized"))


def reward_normalize_loo(spark, d):
    out = groups.normalize(rollouts(spark, d), mean_over=["group_id"], std_over=None, leave_one_out=True)
    return out.select("seq_no", F.round("normalized", 6).alias("normalized"))


def stamped_group_norm(spark, d):
    r = rollouts(spark, d)
    stats = groups.group_reward_stats(r, KEYS)
    value = groups.stamped_norm(F.col("reward"), F.col("g_mean"), F.col("g_std"), bias=-0.5, scale=2.0, clip=5.0)
    return r.join(stats, KEYS).select("seq_no", F.round(value, 6).alias("normalized"))


def overlong_penalty(spark, d):
    cut = groups.overlong_penalty(F.col("seq_len"), longest=50, overlong=20, factor=0.5)
    return rollouts(spark, d).select("seq_no", F.round(F.col("reward") + cut, 6).alias("reward"))


def select_fresh_batch(spark, d):
    return selection.select_batch(rollouts(spark, d), 256, current=NOW, max_staleness=LIMIT, policy="edf").select(*COLUMNS)


def select_fifo_batch(spark, d):
    return selection.select_batch(rollouts(spark, d), 256, current=NOW, max_staleness=LIMIT, policy="fifo").select(*COLUMNS)


def consume_stats(spark, d):
    return selection.consume_stats(rollouts(spark, d), 256, current=NOW, max_staleness=LIMIT, policy="fifo")


def evict_to_capacity(spark, d):
    return selection.evict_to_capacity(rollouts(spark, d).withColumn("buffer", F.col("group_id") % 100), 20, ["buffer"]).select("buffer", *COLUMNS)


def replay_select_latest(spark, d):
    return selection.replay_latest(rollouts(spark, d), 64).select(*COLUMNS)


def mix_training_batch(spark, d):
    r = rollouts(spark, d)
    return selection.mix_batch(r.where("group_id % 2 = 0"), r.where("group_id % 2 = 1"), 200, 0.25, current=NOW, max_staleness=LIMIT).select("part", *COLUMNS)


def record_train_version(spark, d):
    served = F.when(F.col("traj_idx") % 2 == 0, F.array(F.lit(NOW - 1))).otherwise(F.array().cast("array<int>"))
    return rollouts(spark, d).where(selection.fresh(NOW, LIMIT)).select("seq_no", F.array_join(F.concat(served, F.array(F.lit(NOW))), ",").alias("train_versions"))


def aggregate_metadata(spark, d):
    return selection.merge_metadata(rollouts(spark, d), KEYS)


def buffer_stats(spark, d):
    s = selection.buffer_stats(rollouts(spark, d), ["model_key"], current=NOW, max_staleness=LIMIT)
    return s.select("model_key", "fresh_rows", "stale_rows", *[F.round(c, 6).alias(c) for c in ("fresh_mean_len", "stale_mean_len", "accept_rate")])


def sample_dump(spark, d):
    return rollouts(spark, d).where(hash_uniform(17, F.col("seq_no")) < 1 / 128).select("min_version", "seq_no", "seq_len")


def epoch_order(spark, d):
    """One epoch's batches of each buffer, shuffled by hash; the ragged last batch of each is dropped."""
    from pyspark.sql import Window

    w = Window.partitionBy("shard")
    r = rollouts(spark, d).select((F.col("group_id") % 97).alias("shard"), "seq_no").withColumn("rn", F.row_number().over(w.orderBy(hash_uniform(3, 1, F.col("seq_no")), "seq_no"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.withColumn("batch", F.floor((F.col("rn") - 1) / 32).cast("long")).where((F.col("batch") + 1) * 32 <= F.col("n")).select("shard", "seq_no", "batch")


QUERIES = {f.__name__: f for f in (group_reward_stats, zero_adv_flag, filter_zero_adv, ingest_counters, reward_stats, drop_zero_std_rounddown, staleness_filter, route_sequences_by_model, reward_normalize, reward_normalize_loo, stamped_group_norm, overlong_penalty, select_fresh_batch, select_fifo_batch, consume_stats, evict_to_capacity, replay_select_latest, mix_training_batch, record_train_version, aggregate_metadata, buffer_stats, sample_dump, epoch_order)}

_STATS = "s AS (SELECT group_id, model_key, avg(reward) AS g_mean, coalesce(stddev_samp(reward), 1.0) AS g_std, count(*) AS n_trajs FROM rollouts GROUP BY 1, 2)"
_ZERO = "z AS (SELECT group_id, model_key, count(*) AS n_trajs, (greatest(max(reward) - arg_min(reward, seq_no), arg_min(reward, seq_no) - min(reward)) <= 1e-8 + 1e-5 * abs(arg_min(reward, seq_no)))::INT AS zero_adv FROM rollouts GROUP BY 1, 2)"
ORACLES = {
    "group_reward_stats": f"{W}, {_STATS} SELECT group_id, model_key, round(g_mean, 6) AS g_mean, round(g_std, 6) AS g_std, n_trajs FROM s",
    "zero_adv_flag": f"{W}, {_ZERO} SELECT * FROM z",
    "filter_zero_adv": f"{W}, {_ZERO} SELECT {ALL} FROM rollouts JOIN z USING (group_id, model_key) WHERE zero_adv <> 1",
    "ingest_counters": f"{W}, {_ZERO} SELECT model_key, count(*) FILTER (zero_adv = 0) AS accepted, count(*) FILTER (zero_adv = 1) AS filtered, count(*) AS total FROM rollouts JOIN z USING (group_id, model_key) GROUP BY 1",
    "reward_stats": f"{W} SELECT model_key, round(sum(reward - logprob_gap), 4) AS sum, count(*) AS count, round(min(reward - logprob_gap), 6) AS min, round(max(reward - logprob_gap), 6) AS max FROM rollouts GROUP BY 1",
    "drop_zero_std_rounddown": f"{W}, {_STATS}, k AS (SELECT group_id % 64 AS batch, {ALL}, row_number() OVER (PARTITION BY group_id % 64 ORDER BY seq_no) AS rn, count(*) OVER (PARTITION BY group_id % 64) AS n FROM rollouts JOIN s USING (group_id, model_key) WHERE g_std > 0) SELECT batch, {ALL} FROM k WHERE rn <= n // 16 * 16",
    "staleness_filter": f"{W} SELECT {ALL} FROM rollouts WHERE {FRESH}",
    "route_sequences_by_model": f"{W}, m AS (SELECT CASE WHEN traj_idx = 7 THEN -1 ELSE model_key END AS model_key, seq_len FROM rollouts) SELECT t.m::INT AS target_model, model_key, count(*) AS n, sum(seq_len)::BIGINT AS tokens FROM m, (VALUES (0), (1)) t(m) WHERE model_key = t.m OR model_key < 0 GROUP BY 1, 2",
    "reward_normalize": f"{W}, o AS (SELECT seq_no, group_id, reward - avg(reward) OVER (PARTITION BY group_id) AS off FROM rollouts) SELECT seq_no, round(off / (CASE WHEN count(*) OVER g > 1 THEN sqrt(sum(off * off) OVER g / (count(*) OVER g - 1)) ELSE 1.0 END + 1e-5), 6) AS normalized FROM o WINDOW g AS (PARTITION BY group_id)",
    "reward_normalize_loo": f"{W} SELECT seq_no, round(reward - coalesce((sum(reward) OVER g - reward) / nullif(count(*) OVER g - 1, 0), 0.0), 6) AS normalized FROM rollouts WINDOW g AS (PARTITION BY group_id)",
    "stamped_group_norm": f"{W}, {_STATS} SELECT seq_no, round((greatest(-5.0, least(5.0, (reward - 0.5) * 2.0)) - (g_mean - 0.5) * 2.0) / (g_std * 2.0 + 1e-5), 6) AS normalized FROM rollouts JOIN s USING (group_id, model_key)",
    "overlong_penalty": f"{W} SELECT seq_no, round(reward + least(-(seq_len - 30) / 20.0::DOUBLE * 0.5, 0.0), 6) AS reward FROM rollouts",
    "select_fresh_batch": f"{W} SELECT {ALL} FROM rollouts WHERE {FRESH} ORDER BY min_version NULLS FIRST, seq_no LIMIT 256",
    "select_fifo_batch": f"{W} SELECT {ALL} FROM rollouts WHERE {FRESH} ORDER BY seq_no LIMIT 256",
    "consume_stats": f"{W}, e AS (SELECT count(*) AS k, max(seq_no) AS last FROM (SELECT seq_no FROM rollouts WHERE {FRESH} ORDER BY seq_no LIMIT 256)) SELECT count(*) FILTER ({FRESH}) AS consumed, count(*) FILTER (NOT {FRESH}) AS skipped_stale, coalesce(sum(seq_len) FILTER ({FRESH}), 0)::BIGINT AS consumed_tokens, coalesce(sum(seq_len) FILTER (NOT {FRESH}), 0)::BIGINT AS stale_tokens FROM rollouts, e WHERE k < 256 OR seq_no <= last",
    "evict_to_capacity": f"{W}, l AS (SELECT group_id % 100 AS buffer, {ALL}, seq_no = max(seq_no) OVER (PARTITION BY group_id % 100) AS is_last FROM rollouts) SELECT buffer, {ALL} FROM l QUALIFY row_number() OVER (PARTITION BY buffer ORDER BY is_last DESC, min_version DESC NULLS LAST, seq_no DESC) <= 20",
    "replay_select_latest": f"{W} SELECT {ALL} FROM rollouts ORDER BY seq_no DESC LIMIT 64",
    "mix_training_batch": f"{W} (SELECT 'replay' AS part, {ALL} FROM rollouts WHERE group_id % 2 = 1 ORDER BY seq_no DESC LIMIT 50) UNION ALL (SELECT 'fresh', {ALL} FROM rollouts WHERE group_id % 2 = 0 AND {FRESH} ORDER BY min_version NULLS FIRST, seq_no LIMIT 150)",
    "record_train_version": f"{W} SELECT seq_no, CASE WHEN traj_idx % 2 = 0 THEN '99,100' ELSE '100' END AS train_versions FROM rollouts WHERE {FRESH}",
    "aggregate_metadata": f"{W} SELECT group_id, model_key, min(min_version) AS min_version, max(min_version) AS max_version, min((reward = 0)::INT) AS all_zero, arg_min(seq_len, seq_no) AS first_len FROM rollouts GROUP BY 1, 2",
    "buffer_stats": f"{W} SELECT model_key, count(*) FILTER ({FRESH}) AS fresh_rows, count(*) FILTER (NOT {FRESH}) AS stale_rows, round(avg(seq_len) FILTER ({FRESH}), 6) AS fresh_mean_len, round(avg(seq_len) FILTER (NOT {FRESH}), 6) AS stale_mean_len, round(count(*) FILTER ({FRESH}) * 100.0::DOUBLE / count(*), 6) AS accept_rate FROM rollouts GROUP BY 1",
    "sample_dump": f"{W} SELECT min_version, seq_no, seq_len FROM rollouts WHERE {hash_uniform_sql(chr(39) + '17' + chr(39), 'seq_no::VARCHAR')} < 1 / 128::DOUBLE",
    "epoch_order": f"{W}, o AS (SELECT group_id % 97 AS shard, seq_no, row_number() OVER (PARTITION BY group_id % 97 ORDER BY {hash_uniform_sql(chr(39) + '3' + chr(39), chr(39) + '1' + chr(39), 'seq_no::VARCHAR')}, seq_no) AS rn, count(*) OVER (PARTITION BY group_id % 97) AS n FROM rollouts) SELECT shard, seq_no, (rn - 1) // 32 AS batch FROM o WHERE ((rn - 1) // 32 + 1) * 32 <= n",
}
