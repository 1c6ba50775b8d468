"""Reward groups: statistics, zero-signal flags, filters and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_reward_stats(seqs: DataFrame, keys: list[str], reward: str = "reward") -> DataFrame:
    """Mean, sample deviation (1 for a single member) and size of each reward group: one combining aggregate."""
    return seqs.groupBy(*keys).agg(F.avg(reward).alias("g_mean"), F.coalesce(F.stddev_samp(reward), F.lit(1.0)).alias("g_std"), F.count(F.lit(1)).alias("n_trajs"))


def zero_advantage(seqs: DataFrame, keys: list[str], order: str, reward: str = "reward") -> DataFrame:
    """``zero_adv`` 1 where all rewards of a group are close to its first by ``order``.

    The largest distance from the first is at the least or the greatest reward, so no window is needed.
    """
    first = F.min_by(reward, order)
    stats = seqs.groupBy(*keys).agg(first.alias("_first"), F.min(reward).alias("_low"), F.max(reward).alias("_high"), F.count(F.lit(1)).alias("n_trajs"))
    far = F.greatest(F.col("_high") - F.col("_first"), F.col("_first") - F.col("_low"))
    return stats.select(*keys, "n_trajs", (far <= 1e-8 + 1e-5 * F.abs("_first")).cast("int").alias("zero_adv"))


def keep_signal(seqs: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences of groups that aren't flagged ``zero_adv``."""
    return seqs.join(flags.where("zero_adv = 1").select(*keys), keys, "left_anti")


def round_down_survivors(seqs: DataFrame, batch: str, std: Column, order: str, unit: int) -> DataFrame:
    """Each batch's sequences with ``std`` > 0, the last few cut so that a multiple of ``unit`` remains."""
    whole = Window.partitionBy(batch)
    kept = seqs.where(std > 0).withColumn("_rank", F.row_number().over(whole.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(whole))
    return kept.where(F.col("_rank") <= F.floor(F.col("_n") / unit) * unit).drop("_rank", "_n")


def normalize(seqs: DataFrame, *, mean_over: list[str] | None, std_over: list[str] | None, leave_one_out: bool = False, unbiased: bool = True, eps: float = 1e-5, value: str = "reward") -> DataFrame:
    """``value`` less the mean of one level over the deviation of another, both around the mean that was taken.

    A level is a list of keys, or None for no mean or no scaling. Left out of its own mean, a single member has mean 0.
    """
    x = F.col(value)
    df, mean = seqs, F.lit(0.0)
    if mean_over is not None:
        w = Window.partitionBy(*mean_over)
        if leave_one_out:
            mean = F.coalesce((F.sum(x).over(w) - x) / F.nullif(F.count(x).over(w) - 1, F.lit(0)), F.lit(0.0))
        else:
            mean = F.avg(x).over(w)
    df = df.withColumn("_mean", mean).withColumn("_off", x - F.col("_mean"))
    scale = F.lit(1.0)
    if std_over is not None:
        w = Window.partitionBy(*std_over)
        n = F.count(x).over(w) - (1 if unbiased else 0)
        scale = F.when(n > 0, F.sqrt(F.sum(F.col("_off") * F.col("_off")).over(w) / n)).otherwise(F.lit(1.0)) + eps
    return df.withColumn("normalized", F.col("_off") / scale).drop("_mean", "_off")


def normalize_masked(seqs: DataFrame, mask: str, *, batch: list[str], mean_over: list[str] | None, std_over: list[str] | None, leave_one_out: bool = False, unbiased: bool = True, eps: float = 1e-5, value: str = "reward") -> DataFrame:
    """As ``normalize`` over the rows with ``mask`` 1; others become 0, and a ``batch`` without any such row stays as it is.

    A masked row's mean is that of all others in use, also where means leave the row itself out. A single row has
    mean 0 when it is left out, and deviation 1 where that is unbiased.
    """
    x, m = F.col(value), F.col(mask)
    mean = F.lit(0.0)
    if mean_over is not None:
        w = Window.partitionBy(*mean_over)
        n, total = F.sum(m).over(w), F.sum(x * m).over(w)
        plain = F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0))
        mean = F.when((F.count(F.lit(1)).over(w) == 1) | (n <= 1), 0.0).when(m > 0, (total - x) / F.nullif(n - 1, F.lit(0))).otherwise(plain) if leave_one_out else plain
    df = seqs.withColumn("_off", (x - mean) * m)
    scale = F.lit(1.0)
    if std_over is not None:
        w = Window.partitionBy(*std_over)
        n = F.sum(m).over(w) - (1 if unbiased else 0)
        alone = (F.count(F.lit(1)).over(w) == 1) & F.lit(unbiased)
        scale = F.when(alone | (n <= 0), 1.0).otherwise(F.sqrt(F.sum(F.col("_off") * F.col("_off")).over(w) / F.nullif(n, F.lit(0)))) + eps
    none = F.sum(m).over(Window.partitionBy(*batch)) == 0
    return df.withColumn("normalized", F.when(none, x).otherwise(F.col("_off") / scale)).drop("_off")


def stamped_norm(reward: Column, mean: Column, std: Column, *, bias: float, scale: float, clip: float, eps: float = 1e-5) -> Column:
    """A biased, scaled and clipped reward against stamped group statistics: row-local, no shuffle."""
    scaled = F.greatest(F.lit(-clip), F.least(F.lit(clip), (reward + bias) * scale))
    return (scaled - (mean + bias) * scale) / (std * abs(scale) + eps)


def overlong_penalty(length: Column, *, longest: int, overlong: int, factor: float) -> Column:
    """What a sequence that runs into the last ``overlong`` tokens loses."""
    return F.least(-(length - (longest - overlong)) / overlong * factor, F.lit(0.0))


def route_by_model(seqs: DataFrame, models: list[int], model: str = "model_key") -> DataFrame:
    """One copy of each sequence for every model with tokens in it (here: its own, or all where it names none)."""
    return seqs.withColumn("target_model", F.explode(F.array(*[F.lit(m) for m in models]))).where((F.col(model) == F.col("target_model")) | (F.col(model) < 0))
