"""Whether rollout instances keep up with the trainer: counters joined by window, a scaling target, and its share for each instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.sizes import broadcast_if_small

#: Shares of waiting that call for more or fewer GPUs, what is added to a smaller target, and the most waiting that is believed.
WAIT_HIGH, WAIT_LOW, PAD, WAIT_MOST = 0.10, 0.05, 1.10, 0.95


def _share(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(otherwise)


def wait_fraction(wait: Column, step: Column) -> Column:
    """Seconds waited of the seconds of steps, at most ``WAIT_MOST``; 0 without a step."""
    return F.least(_share(wait, step), F.lit(WAIT_MOST))


def report(produced: DataFrame, consumed: DataFrame, steps: DataFrame, instances: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each agent and window (``keys``): rates, and the GPUs that the window's waiting asks for.

    ``produced``: ``instance, produced, accepted``; ``consumed``: ``consumed, stale``; ``steps``: ``wait_s, step_s``, a
    row a step; ``instances``: the agent's (first key) ``instance, gpus`` now. Each is summed by window on its own
    before they meet, so that none multiplies another's counts; a window that only some have counts 0 for the others.

    Over ``WAIT_HIGH`` of waiting the target is ``ceil(G / (1 - waiting))``; under ``WAIT_LOW``, with anything
    produced and consumed, ``min(G, ceil(G * consumed / entered * PAD))``; else it stays. Stale rows are told only.
    """
    counts = {"produced": "produced", "accepted": "entered"}, {"consumed": "consumed", "stale": "stale"}, {"wait_s": "wait_s", "step_s": "step_s"}
    sums = [df.groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in names.items()], *([F.count(F.lit(1)).alias("steps")] if df is steps else [])) for df, names in zip((produced, consumed, steps), counts, strict=True)]
    joined = sums[0].join(sums[1], keys, "full").join(sums[2], keys, "full").fillna(0)
    gpus = instances.groupBy(keys[0]).agg(F.sum("gpus").alias("gpus"))
    both = joined.join(broadcast_if_small(gpus), keys[0], "left").withColumn("gpus", F.coalesce("gpus", F.lit(0)))
    waiting = both.withColumn("wait_fraction", wait_fraction(F.col("wait_s"), F.col("step_s")))
    some, g, w = F.col("gpus") > 0, F.col("gpus"), F.col("wait_fraction")
    branch = F.when((w > WAIT_HIGH) & some, "scale_up").when((w < WAIT_LOW) & (F.col("entered") > 0) & (F.col("consumed") > 0) & some, "scale_down").otherwise("hold")
    target = F.when(F.col("branch") == "scale_up", F.ceil(g / (1 - w))).when(F.col("branch") == "scale_down", F.least(g, F.ceil(g * (F.col("consumed") / F.col("entered")) * PAD))).otherwise(g)
    told = waiting.withColumns(
        {
            "avg_wait_s": _share(F.col("wait_s"), F.col("steps")),
            "avg_step_s": _share(F.col("step_s"), F.col("steps")),
            "accept_rate": _share(F.col("entered"), F.col("produced")),
            "throughput_per_gpu": _share(F.col("entered"), g),
            "produce_consume": F.when(F.col("consumed") > 0, F.col("entered") / F.col("consumed")),
            "stale_rate": _share(F.col("stale"), F.col("entered")),
            "branch": branch,
        }
    )
    return told.withColumn("target", target.cast("long")).withColumn("delta", F.col("target") - g)


def layout(produced: DataFrame, instances: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each instance of an agent and window: its counts and rates, and whether it is healthy, suspect or gone.

    Instances without a row in a window have counts of 0 there; those that produced and aren't in the pool any more are gone.
    """
    agent = keys[0]
    own = produced.groupBy(*keys, "instance").agg(F.sum("produced").alias("produced"), F.sum("accepted").alias("accepted"))
    windows = own.select(*keys).distinct()
    here = windows.join(broadcast_if_small(instances.select(agent, "instance", "gpus", "suspect", F.lit(True).alias("_here"))), agent)
    rows = own.join(here, [*keys, "instance"], "full")
    gpus = F.coalesce("gpus", F.lit(0))
    made, kept = F.coalesce("produced", F.lit(0)), F.coalesce("accepted", F.lit(0))
    status = F.when(F.col("_here").isNull(), "gone").when(F.col("suspect"), "suspect").otherwise("healthy")
    return rows.select(*keys, "instance", gpus.alias("gpus"), made.alias("produced"), kept.alias("accepted"), _share(kept, made).alias("accept_rate"), _share(kept, gpus).alias("throughput_per_gpu"), status.alias("status"))


def apportion(rows: DataFrame, keys: list[str], total: str, weight: str, tie: str, name: str = "share") -> DataFrame:
    """``total`` of each group of ``keys`` in whole numbers by ``weight``: the floor of each quota, and one more for the largest remainders.

    Equal remainders go by ``tie``. A group without weight gets nothing.
    """
    group = Window.partitionBy(*keys)
    quota = F.when(F.sum(weight).over(group) > 0, F.col(total) * F.col(weight) / F.sum(weight).over(group)).otherwise(0.0)
    # quotas of whole numbers that a division misses by a hair are whole
    parts = rows.withColumn("_q", F.round(quota, 9)).withColumn("_rest", F.col("_q") - F.floor("_q"))
    left = F.round(F.sum("_q").over(group)) - F.sum(F.floor("_q")).over(group)
    place = F.row_number().over(group.orderBy(F.desc("_rest"), tie))
    return parts.withColumns({"_left": left, "_place": place}).withColumn(name, (F.floor("_q") + (F.col("_place") <= F.col("_left")).cast("long")).cast("long")).drop("_q", "_rest", "_left", "_place")
