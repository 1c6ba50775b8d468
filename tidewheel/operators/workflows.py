"""Metrics and rewards of multi-agent workflows: rounds with verdicts, routes, agents' memories, generated tests, spawned sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a failed search says, and what a page that was read begins with.
NOTHING_FOUND, FIRST_PAGE = "No search results are found", ">>>> Page 1 >>>>"


def verdict_of(text: Column) -> Column:
    """The last ``ACCEPT`` or ``REJECT`` of a verifier's answer; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(ACCEPT|REJECT)"), F.lit(1)), F.lit(-1))


def verifier_metrics(rounds: DataFrame, keys: list[str], trajectory: str) -> DataFrame:
    """A row for each of ``keys``, from rounds (``round, verdict``) of trajectories.

    ``accept_rate``: accepted of all rounds with a verdict, null without any; ``approve_rate`` and ``retry_rate``:
    trajectories whose last round is accepted, and the others; ``avg_turns``: rounds a trajectory.
    """
    accepted, told = F.col("verdict") == "ACCEPT", F.col("verdict").isin("ACCEPT", "REJECT")
    last = F.max_by(F.coalesce(accepted, F.lit(False)), "round")
    each = rounds.groupBy(*keys, trajectory).agg(F.count(F.lit(1)).alias("_rounds"), F.count_if(accepted).alias("_accepted"), F.count_if(told).alias("_told"), last.cast("double").alias("_approved"))
    rate = F.sum("_accepted") / F.nullif(F.sum("_told"), F.lit(0))
    return each.groupBy(*keys).agg(rate.alias("accept_rate"), F.avg("_approved").alias("approve_rate"), F.avg(1 - F.col("_approved")).alias("retry_rate"), F.avg("_rounds").alias("avg_turns"))


def memory_stats(records: DataFrame, keys: list[str]) -> DataFrame:
    """What an agent's memory holds (``type, text, input_tokens, output_tokens``): model calls and their tokens, searches and page reads, failed and not."""
    kind = lambda k: F.coalesce(F.col("type") == k, F.lit(False))
    tokens = lambda c: F.sum(F.when(kind("llm_gen"), F.coalesce(F.size(F.col(c)), F.lit(0))).otherwise(0)).cast("long")
    has = lambda mark: F.coalesce(F.contains("text", F.lit(mark)), F.lit(False))
    return records.groupBy(*keys).agg(
        F.count_if(kind("llm_gen")).alias("llm_gens"),
        tokens("input_tokens").alias("input_tokens"),
        tokens("output_tokens").alias("output_tokens"),
        F.count_if(kind("search_results")).alias("searches"),
        F.count_if(kind("search_results") & ~has(NOTHING_FOUND)).alias("searches_ok"),
        F.count_if(kind("search_results") & has(NOTHING_FOUND)).alias("searches_failed"),
        F.count_if(kind("webpage")).alias("pages"),
        F.count_if(kind("webpage") & has(FIRST_PAGE)).alias("pages_ok"),
        F.count_if(kind("webpage") & ~has(FIRST_PAGE)).alias("pages_failed"),
    )


def router_metrics(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Share sent to the smaller model, mean reward, and how often each model is right (``decision, reward, small_right, large_right``)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return routes.groupBy(*keys).agg(share(F.col("decision") == "small").alias("small_route_rate"), F.avg("reward").alias("router_reward"), share(F.col("small_right")).alias("small_right_rate"), share(F.col("large_right")).alias("large_right_rate"))


def testgen_rewards(valid_rate: Column, agrees: Column, final_rate: Column) -> list[Column]:
    """Rewards for generated tests in three forms.

    ``discrete``: half for tests that the reference passes, half if their verdict on the first code is the true one, if
    they are valid; ``continuous``: the share valid for the first half, the other only from 0.99 on; ``coupled``: the
    share of cases that the final code passes, and the share valid.
    """
    rate, same = F.coalesce(valid_rate, F.lit(0.0)), F.coalesce(agrees, F.lit(False))
    half = lambda first, gate: 0.5 * (first + (gate & same).cast("double"))
    return [half((rate >= 1).cast("double"), rate >= 1).alias("discrete"), half(rate, rate >= 0.99).alias("continuous"), (final_rate + rate).alias("coupled")]


def spawn_sequence(prompt: Column, first: Column, results: Column, second: Column, size: Column) -> list[Column]:
    """A main agent's sequence around its spawned agents' results: prompt, first answer, results, second answer.

    ``first`` and ``second`` are arrays of ``id, logprob, version``; only they are learned. Without results the
    sequence ends with the first answer. All arrays have the length of ``input_ids``; one longer than ``size`` is null.
    """
    spawned = F.size(results) > 0
    given = F.when(spawned, results).otherwise(F.slice(results, 1, 0))
    late = F.when(spawned, second).otherwise(F.slice(second, 1, 0))
    fill = lambda c, v: F.transform(c, lambda _: v)
    none = lambda c, name, v: F.transform(c, lambda x: x[name] if v is None else v)
    parts = {
        "input_ids": F.concat(prompt, none(first, "id", None), given, none(late, "id", None)),
        "loss_mask": F.concat(fill(prompt, F.lit(0)), fill(first, F.lit(1)), fill(given, F.lit(0)), fill(late, F.lit(1))),
        "logprobs": F.concat(fill(prompt, F.lit(0.0)), none(first, "logprob", None), fill(given, F.lit(0.0)), none(late, "logprob", None)),
        "versions": F.concat(fill(prompt, F.lit(-1)), none(first, "version", None), fill(given, F.lit(-1)), none(late, "version", None)),
    }
    fits = F.size(parts["input_ids"]) <= size
    return [F.when(fits, c).alias(n) for n, c in parts.items()]
