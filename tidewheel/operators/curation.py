"""Prompt curation: streaks of outcomes without signal, success averages, and the gate that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform
from tidewheel.functions.ranking import greatest_before
from tidewheel.operators.datasets import numbered


def rounds(outcomes: DataFrame) -> DataFrame:
    """One row for each prompt and version: mean reward, whether rewards were equal, and the kind that says."""
    own = outcomes.groupBy("prompt_id", "version").agg(F.avg("reward").alias("g_mean"), (F.max("reward") - F.min("reward") <= 1e-8).cast("int").alias("zero_adv"), F.count(F.lit(1)).alias("n_trajs"))
    return own.withColumn("kind", F.when(F.col("zero_adv") == 1, F.when(F.col("g_mean") > 0.5, "easy").otherwise("hard")))


def streaks(rounds_: DataFrame) -> DataFrame:
    """Each prompt's trailing run of equal-kind rounds without signal; any signal ends it, a change of kind starts anew."""
    w = Window.partitionBy("prompt_id").orderBy("version")
    breaks = (F.col("zero_adv") == 0) | F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lag("version").over(w).isNotNull())
    island = rounds_.withColumn("_island", F.sum(breaks.cast("int")).over(w))
    last = island.withColumn("_last", F.max("_island").over(Window.partitionBy("prompt_id"))).where(F.col("_island") == F.col("_last"))
    return last.groupBy("prompt_id").agg(F.sum("zero_adv").cast("long").alias("streak"), F.max_by("kind", "version").alias("kind"))


def success_average(rounds_: DataFrame, decay: float) -> DataFrame:
    """Exponential average of success in version order, from 0, in closed form: no ordered fold, one aggregate after a rank."""
    w = Window.partitionBy("prompt_id")
    age = F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("version"))
    return rounds_.withColumn("_age", age).groupBy("prompt_id").agg(F.sum((1 - decay) * F.pow(F.lit(decay), F.col("_age")) * F.col("g_mean")).alias("success"))


def shares(rounds_: DataFrame) -> DataFrame:
    """``version, easy, hard, n``: how many rounds of a version gave no signal of either kind, and how many there were."""
    return rounds_.groupBy("version").agg(F.count_if(F.col("kind") == "easy").alias("easy"), F.count_if(F.col("kind") == "hard").alias("hard"), F.count(F.lit(1)).alias("n"))


def controller(rounds_: DataFrame, **settings) -> DataFrame:
    """Submission probabilities after each version of rounds; see ``steer``."""
    return steer(shares(rounds_), **settings)


def steer(tallies: DataFrame, *, p0: float = 0.5, step: float = 0.01, easy_target: float = 0.083, hard_target: float = 0.167, low: float = 0.01, high: float = 0.99, warm_up: int = 0) -> DataFrame:
    """``version, p_easy, p_hard`` from ``shares``: a clamped step down at or over its target share, else up.

    Nothing moves before ``warm_up`` rounds were seen, those of the version itself included. Versions are few (one row
    each) and clamping makes the order matter, so they are folded in order as one array.
    """
    known = F.nullif(F.col("easy") + F.col("hard"), F.lit(0))
    share = tallies.select("version", "n", F.coalesce(F.col("easy") / known, F.lit(0.0)).alias("e"), F.coalesce(F.col("hard") / known, F.lit(0.0)).alias("h"))
    ordered = share.agg(F.sort_array(F.collect_list(F.struct("version", "e", "h", "n"))).alias("v"))

    def move(p: Column, x: Column, target: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), F.when(x >= target, p - step).otherwise(p + step)))

    zero = F.struct(F.lit(p0).alias("pe"), F.lit(p0).alias("ph"), F.lit(0).cast("long").alias("seen"), F.array().cast("array<struct<version:int,p_easy:double,p_hard:double>>").alias("out"))

    def merge(a: Column, x: Column) -> Column:
        seen = a["seen"] + x["n"]
        pe, ph = (F.when(seen >= warm_up, move(a[p], x[s], t)).otherwise(a[p]) for p, s, t in (("pe", "e", easy_target), ("ph", "h", hard_target)))
        return F.struct(pe.alias("pe"), ph.alias("ph"), seen.alias("seen"), F.concat(a["out"], F.array(F.struct(x["version"].alias("version"), pe.alias("p_easy"), ph.alias("p_hard")))).alias("out"))

    return ordered.select(F.explode(F.aggregate("v", zero, merge, lambda a: a["out"])).alias("o")).select("o.*")


def gate(prompts: DataFrame, state: DataFrame, *, p_easy: float, p_hard: float, seed: int, floor_easy: float = 0.1, floor_hard: float = 0.4) -> DataFrame:
    """Every candidate prompt with its probability and decision; prompts without state or streak always pass."""
    z = F.coalesce(F.col("streak"), F.lit(0))
    easy = F.coalesce(F.col("kind"), F.lit("easy")) == "easy"
    p = F.when(z == 0, 1.0).when(easy, F.greatest(F.pow(F.lit(p_easy), z), F.lit(floor_easy))).otherwise(F.greatest(F.pow(F.lit(p_hard), z), F.lit(floor_hard)))
    return prompts.join(state, "prompt_id", "left").withColumn("p", p).withColumn("submit", hash_uniform(seed, F.col("prompt_id")) < F.col("p"))


def force_after(decided: DataFrame, order: str, most: int) -> DataFrame:
    """``submit`` made true for the candidate after ``most`` rejections in a row, by the numeric ``order``; the count begins anew behind it."""
    placed = numbered(decided, order, "_place").withColumn("_taken", F.when(F.col("submit"), F.col("_place")))
    run = greatest_before(placed, [], F.floor(F.col("_place") / 4096), [F.col("_place")], "_taken", "_last")
    behind = F.col("_place") - F.coalesce("_last", F.lit(-1))
    return run.withColumn("submit", F.col("submit") | (behind % (most + 1) == 0)).drop("_place", "_taken", "_last")


def smoothed(rows: DataFrame, keys: list[str], order: list[str], values: list[str], alpha: float) -> DataFrame:
    """``keys``, ``n`` and each value's exponential average ``alpha * x + (1 - alpha) * before`` in order, from the first value, in closed form."""
    w = Window.partitionBy(*keys)
    aged = rows.withColumn("_age", F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    weight = F.pow(F.lit(1 - alpha), F.col("_age")) * F.when(F.col("_age") == F.col("_n") - 1, 1.0).otherwise(alpha)
    return aged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(weight * F.col(v)).alias(v) for v in values])


def wait_fraction(wait: Column, step: Column, most: float = 0.95) -> Column:
    """Share of a step spent waiting; 0 without a step."""
    return F.when(step > 0, F.least(wait / step, F.lit(most))).otherwise(0.0)
