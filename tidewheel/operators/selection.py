"""Choosing sequences for training: staleness, order, capacity, replay and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ranking import place_within


def fresh(current: int, max_staleness: int, version: str = "min_version") -> Column:
    """Rows without a version always pass."""
    return F.col(version).isNull() | (F.lit(current) - F.col(version) <= max_staleness)


def arrival_order(policy: str) -> list[Column]:
    """``fifo``: by arrival. ``edf``: earliest version first, those without one before all, ties by arrival."""
    return [F.col("min_version").asc_nulls_first(), F.col("seq_no").asc()] if policy == "edf" else [F.col("seq_no").asc()]


def select_batch(buffer: DataFrame, n: int, *, current: int, max_staleness: int, policy: str = "edf") -> DataFrame:
    """The next ``n`` fresh rows with their place as ``ordinal``, or none when there are fewer: a top-n, never a sort of the whole buffer."""
    best = buffer.where(fresh(current, max_staleness)).orderBy(*arrival_order(policy)).limit(n)
    batch = Window.partitionBy(F.lit(0))  # n rows
    return best.withColumn("_n", F.count(F.lit(1)).over(batch)).where(F.col("_n") == n).drop("_n").withColumn("ordinal", F.row_number().over(batch.orderBy(*arrival_order(policy))) - 1)


def consume_stats(buffer: DataFrame, n: int, *, current: int, max_staleness: int, policy: str = "edf") -> DataFrame:
    """Rows and tokens taken and dropped as stale up to the n-th fresh row; rows after it were never looked at."""
    live = fresh(current, max_staleness)
    ends = buffer.where(live).orderBy(*arrival_order(policy)).limit(n).agg(F.count(F.lit(1)).alias("_taken"), F.max(F.struct(F.coalesce("min_version", F.lit(-(1 << 31))), "seq_no") if policy == "edf" else F.struct("seq_no")).alias("_end"))
    key = F.struct(F.coalesce("min_version", F.lit(-(1 << 31))), "seq_no") if policy == "edf" else F.struct("seq_no")
    seen = buffer.withColumn("_key", key).withColumn("_live", live).join(F.broadcast(ends), (F.col("_taken") < n) | (F.col("_key") <= F.col("_end")))
    count = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    return seen.agg(count(F.col("_live"), 1).alias("consumed"), count(~F.col("_live"), 1).alias("skipped_stale"), count(F.col("_live"), F.col("seq_len")).alias("consumed_tokens"), count(~F.col("_live"), F.col("seq_len")).alias("stale_tokens"))


def evict_to_capacity(buffer: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """What a buffer of ``capacity`` holds for each key after all rows were put: the last arrival and the greatest others."""
    w = Window.partitionBy(*keys)
    last = buffer.withColumn("_last", F.max("seq_no").over(w) == F.col("seq_no"))
    rank = F.row_number().over(w.orderBy(F.col("_last").desc(), F.col("min_version").desc_nulls_last(), F.col("seq_no").desc()))
    return last.withColumn("_rank", rank).where(F.col("_rank") <= capacity).drop("_last", "_rank")


def replay_latest(store: DataFrame, n: int, order: str = "seq_no") -> DataFrame:
    """The latest ``n`` of the replay store."""
    return store.orderBy(F.col(order).desc()).limit(n)


def replay_at(store: DataFrame, asked: DataFrame, index: str = "index", order: str = "seq_no", width: int = 1 << 32) -> DataFrame:
    """Entries of the replay store at the asked places (from 0, by whole-numbered ``order``), each as often as asked for; places out of range give none."""
    placed = place_within(store, [], F.floor(F.col(order) / width), [F.col(order)], "_place")
    return asked.join(placed, F.col(index) == F.col("_place")).drop("_place")


def mix_batch(buffer: DataFrame, store: DataFrame, n: int, ratio: float, *, current: int, max_staleness: int) -> DataFrame:
    """Replay (at most ``int(n * ratio)``) is read before fresh rows are taken; ``part`` tells them apart."""
    replay = replay_latest(store, int(n * ratio)).withColumn("part", F.lit("replay"))
    count = replay.count()  # at most n * ratio rows
    taken = select_batch(buffer, n - count, current=current, max_staleness=max_staleness).drop("ordinal").withColumn("part", F.lit("fresh"))
    return taken.unionByName(replay)


def merge_metadata(seqs: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata of a group as one row: least and greatest version, flag of all, other columns from the first arrival."""
    return seqs.groupBy(*keys).agg(F.min("min_version").alias("min_version"), F.max("min_version").alias("max_version"), F.min((F.col("reward") == 0).cast("int")).alias("all_zero"), F.min_by("seq_len", "seq_no").alias("first_len"))


def buffer_stats(seqs: DataFrame, keys: list[str], *, current: int, max_staleness: int) -> DataFrame:
    """Accepted share, counts and mean lengths of fresh and stale rows; null where there are none."""
    live = fresh(current, max_staleness)
    return seqs.groupBy(*keys).agg(
        F.count_if(live).alias("fresh_rows"), F.count_if(~live).alias("stale_rows"), F.avg(F.when(live, F.col("seq_len"))).alias("fresh_mean_len"), F.avg(F.when(~live, F.col("seq_len"))).alias("stale_mean_len"), (F.count_if(live) * 100.0 / F.count(F.lit(1))).alias("accept_rate")
    )
