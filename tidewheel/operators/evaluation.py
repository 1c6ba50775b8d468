"""Evaluation: avg@k, pass@k, scoreboards and what remains to be run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product, with k at most n."""
    k = F.least(k if isinstance(k, Column) else F.lit(k).cast("long"), n)
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def attempts(results: DataFrame, keys: list[str], correct: str = "correct") -> DataFrame:
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("c"))


def avg_at_k(results: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Share right in percent and mean reward of each dataset, and the unweighted mean of datasets as ``overall``."""
    own = results.groupBy(dataset).agg((F.count_if("correct") * 100.0 / F.count(F.lit(1))).alias("avg_at_k"), F.avg("reward").alias("mean_reward"), F.count(F.lit(1)).alias("total"))
    whole = own.agg(F.lit("overall").alias(dataset), F.avg("avg_at_k").alias("avg_at_k"), F.avg("mean_reward").alias("mean_reward"), F.sum("total").alias("total"))
    return own.unionByName(whole)


def pass_at_k_means(results: DataFrame, k: int) -> DataFrame:
    """Mean clamped pass@k in percent over the samples of each dataset."""
    return attempts(results, ["dataset", "sample"]).groupBy("dataset").agg((F.avg(pass_at_k(F.col("n"), F.col("c"), k)) * 100).alias("pass_at_k"), F.count(F.lit(1)).alias("samples"))


def pass_at_k_suite(results: DataFrame, ks: list[int]) -> DataFrame:
    """Mean pass@k for every k that all samples of a dataset have attempts for."""
    per = attempts(results, ["dataset", "sample"]).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    enough = per.groupBy("dataset", "k").agg(F.min("n").alias("least"), F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"))
    return enough.where("least >= k").drop("least")


def number_attempts(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return results.withColumn("completion_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def latest(runs: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The newest run of each pair, by a combining aggregate."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max(F.struct(stamp, *[c for c in rest if c != stamp])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scoreboard(results: DataFrame, agent: str, task: str, tasks: list[str], metric: Column) -> DataFrame:
    """Agents by tasks. The tasks are stated, so the pivot takes no pass to find them."""
    return results.groupBy(agent).pivot(task, tasks).agg(metric)


def remaining(pairs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.join(done, keys, "left_anti")


def expand_runs(samples: DataFrame, k: int) -> DataFrame:
    """``k`` runs of every sample, ``run_idx`` from 0."""
    return samples.withColumn("run_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
