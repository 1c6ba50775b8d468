"""Token-level tables from aligned arrays: bounds, masked statistics, divergence, advantages and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_bounds(versions: Column) -> tuple[Column, Column]:
    """Least version above 0 (else 0) and greatest of all."""
    return F.coalesce(F.array_min(F.filter(versions, lambda v: v > 0)), F.lit(0)), F.array_max(versions)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def masked_stats(values: Column, mask: Column, prefix: str) -> list[Column]:
    """Mean, least, greatest and sum of the values where the mask is 1; null where it never is."""
    kept = F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    n = F.size(kept)
    return [F.when(n > 0, array_sum(kept) / n).alias(f"{prefix}_avg"), F.array_min(kept).alias(f"{prefix}_min"), F.array_max(kept).alias(f"{prefix}_max"), F.when(n > 0, array_sum(kept)).alias(f"{prefix}_sum")]


def kl(gap: Column, kind: str) -> Column:
    """k1, k2 and k3 estimates of a log-probability gap, clamped to 10."""
    d = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), gap))
    return {"k1": d, "k2": d * d / 2, "k3": F.exp(-d) - 1 + d}[kind]


def ppo_token_loss(ratio: Column, advantage: Column, *, low: float, high: float, dual: float) -> Column:
    """Clipped surrogate loss of a token, with the dual clip for negative advantages."""
    plain, clipped = -advantage * ratio, -advantage * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    worst = F.greatest(plain, clipped)
    return F.when(advantage < 0, F.least(-advantage * dual, worst)).otherwise(worst)


def critic_loss(value: Column, old: Column, target: Column, clip: float) -> Column:
    near = old + F.greatest(F.lit(-clip), F.least(F.lit(clip), value - old))
    return 0.5 * F.greatest((value - target) * (value - target), (near - target) * (near - target))


def sapo_token_loss(ratio: Column, advantage: Column, *, tau_up: float, tau_down: float) -> Column:
    """Soft gate of the ratio by a sigmoid whose temperature depends on the advantage's sign."""
    tau = F.when(advantage > 0, tau_up).otherwise(tau_down)
    return -(4 / tau) / (1 + F.exp(-tau * (ratio - 1))) * advantage


def explode_tokens(rows: DataFrame, *arrays: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a token, with its position."""
    return rows.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_t")).select(*keep, "pos", *[F.col(f"_t.{a}").alias(a) for a in arrays])


def clip_range(tokens: DataFrame, batch: str, gap: str, mask: Column, *, threshold: float) -> DataFrame:
    """The trust region of each batch: squared gaps of masked tokens are dropped from the largest until the rest's mean is below ``threshold``.

    ``low`` and ``high`` are .95 and 20 without masked tokens or with a mean that already is at most ``threshold``;
    they come from the largest gap that stays, or from the least where the rest never gets below. Means are often at
    the threshold to the last bit, so squares are added one by one, from the least on: a product for equal ones is
    another sum. A batch is what a trainer takes in a step.
    """
    m2 = F.when(mask, F.col(gap) * F.col(gap))
    upto_row = Window.partitionBy(batch).orderBy(F.col("m2").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = tokens.select(batch, m2.alias("m2")).withColumns({"_n": F.count("m2").over(upto_row), "_sum": F.sum("m2").over(upto_row)})
    upto = F.col("_sum") / F.col("_n")
    own = values.where("m2 IS NOT NULL").groupBy(batch).agg(F.max_by(upto, "_n").alias("mean"), F.max(F.when(upto < threshold, F.col("m2"))).alias("most"), F.min("m2").alias("least"))
    own = tokens.select(batch).distinct().join(own, batch, "left")
    tau = F.sqrt(F.coalesce("most", "least"))
    free = F.col("mean").isNull() | (F.col("mean") <= threshold)
    low, high = F.when(free, 0.95).otherwise(F.least(1 - F.exp(-tau), F.lit(0.95))), F.when(free, 20.0).otherwise(F.least(F.exp(tau) - 1, F.lit(20.0)))
    return own.select(batch, low.alias("low"), high.alias("high"))


def gae(rows: DataFrame, *, gamma: float, lam: float, out: str = "advantages") -> DataFrame:
    """Advantages by the backward recursion over ``rewards`` and ``values``; masked tokens are skipped, the last starts from 0."""
    return rows.withColumn(out, _backward(F.col("rewards"), F.col("values"), F.col("loss_mask"), F.lit(0.0), gamma, lam))


def _backward(rewards: Column, values: Column, mask: Column, after: Column, gamma: float, lam: float) -> Column:
    """The recursion as one fold over the reversed arrays; ``after`` is the value behind the last token. 0 where masked."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("adv"), after.cast("double").alias("next"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        new = t["r"].cast("double") + gamma * a["next"] - t["v"].cast("double") + gamma * lam * a["adv"]
        on = t["m"] > 0
        return F.struct(F.when(on, new).otherwise(a["adv"]).alias("adv"), F.when(on, t["v"].cast("double")).otherwise(a["next"]).alias("next"), F.concat(a["out"], F.array(F.when(on, new).otherwise(F.lit(0.0)))).alias("out"))

    return F.aggregate(steps, start, step, lambda a: F.reverse(a["out"]))


def shifted(values: Column, last: Column) -> Column:
    """Each position's successor; ``last`` for the end."""
    return F.when(F.size(values) > 0, F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(last))).otherwise(values)


def advantages(rows: DataFrame, *, gamma: float, lam: float, kl_weight: float, kind: str = "k1") -> DataFrame:
    """``kl_rewards, tot_rewards, advantages, returns`` of sequences (``logprobs, ref_logprobs, loss_mask, values, reward``).

    The mask and log-probabilities are those of the token that each position predicts. The divergence from the
    reference is a negative reward of each such token, none at the end, and the sequence's reward is added at the
    last but one; the recursion skips positions outside the mask, where the advantage is 0.
    """
    n = F.size("loss_mask")
    made = rows.withColumn("_mask", shifted(F.col("loss_mask"), F.lit(0)))
    gap = F.zip_with(shifted(F.col("logprobs"), F.lit(0.0)), shifted(F.col("ref_logprobs"), F.lit(0.0)), lambda a, b: a - b)
    made = made.withColumn("kl_rewards", F.transform(F.zip_with(gap, F.col("_mask"), lambda g, m: g * m), lambda g: -kl_weight * kl(g, kind)))
    at = F.greatest(n - 2, F.lit(0))
    made = made.withColumn("tot_rewards", F.transform("kl_rewards", lambda r, i: F.when(i == n - 1, 0.0).otherwise(r) + F.when(i == at, F.col("reward")).otherwise(F.lit(0.0))))
    made = made.withColumn("advantages", _backward(F.col("tot_rewards"), F.col("values"), F.col("_mask"), F.lit(0.0), gamma, lam))
    return made.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v)).drop("_mask")


def build_sequence(prompt: Column, answer: Column, logprobs: Column, versions: Column) -> list[Column]:
    """A prompt and its answer as aligned arrays: the prompt has log-probability 0, mask 0 and version -1."""
    before = lambda x: F.transform(prompt, lambda _: x)
    return [
        F.concat(prompt, answer).alias("input_ids"), F.concat(before(F.lit(0)), F.transform(answer, lambda _: F.lit(1))).alias("loss_mask"), F.concat(before(F.lit(0.0)), logprobs).alias("logprobs"),
        F.concat(before(F.lit(-1)), versions).alias("versions"), F.transform(F.concat(prompt, answer), lambda _: F.lit(True)).alias("attention_mask"),
    ]


def merge_prefix_turns(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``sequences`` of each trajectory, its turns (``input_ids, output_ids, logprobs, versions``) taken in order.

    A turn whose input begins with a sequence so far extends the first such one: what the input has beside it gets
    mask 0, log-probability 0 and version -1. Any other turn begins a sequence. One fold over the trajectory's turns.
    """
    turn = F.struct(order, "input_ids", "output_ids", "logprobs", "versions")
    own = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    start = F.array().cast("array<struct<input_ids:array<int>,loss_mask:array<int>,logprobs:array<double>,versions:array<int>>>")

    def grow(t: Column, old: Column | None) -> Column:
        have = F.size(old["input_ids"]) if old is not None else F.lit(0)
        gap = F.slice(t["input_ids"], have + 1, F.greatest(F.size(t["input_ids"]) - have, F.lit(0)))
        fill = lambda x: F.transform(gap, lambda _: x)
        added = {"loss_mask": [fill(F.lit(0)), F.transform(t["output_ids"], lambda _: F.lit(1))], "logprobs": [fill(F.lit(0.0)), t["logprobs"]], "versions": [fill(F.lit(-1)), t["versions"]]}
        return F.struct(F.concat(t["input_ids"], t["output_ids"]).alias("input_ids"), *[F.concat(*([old[k]] if old is not None else []), *v).alias(k) for k, v in added.items()])

    def merge(done: Column, t: Column) -> Column:
        fits = F.transform(done, lambda s: (F.size(t["input_ids"]) >= F.size(s["input_ids"])) & (F.slice(t["input_ids"], 1, F.size(s["input_ids"])) == s["input_ids"]))
        first = F.array_position(fits, True)
        return F.when(first == 0, F.concat(done, F.array(grow(t, None)))).otherwise(F.transform(done, lambda s, i: F.when(i + 1 == first, grow(t, s)).otherwise(s)))

    return own.select(*keys, F.aggregate("_turns", start, merge).alias("sequences"))


def pad_batch(rows: DataFrame, batch: str, length: str, fill: dict[str, Column]) -> DataFrame:
    """Every array of ``fill`` filled up with its value to the longest of its batch; ``attention_mask`` tells the filling apart."""
    longest = rows.groupBy(batch).agg(F.max(F.size(length)).alias("_most"))
    made = rows.join(longest, batch).withColumn("_n", F.size(length))
    out = [c for c in made.columns if c not in {*fill, "_most", "_n", "attention_mask"}]
    padding = lambda x: F.array_repeat(x, F.col("_most") - F.col("_n"))
    return made.select(*out, *[F.concat(F.col(c), padding(x)).alias(c) for c, x in fill.items()], F.concat(F.transform(F.col(length), lambda _: F.lit(1)), padding(F.lit(0))).alias("attention_mask"))


def pack_batch(rows: DataFrame, batch: str, order: str, arrays: list[str]) -> DataFrame:
    """A batch's arrays one behind the other, and ``cu_seqlens``: where each begins and the last ends. A batch is one micro-batch."""
    own = rows.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, *arrays))).alias("_r"))
    lengths = F.transform(F.col(f"_r.{arrays[0]}"), lambda a: F.size(a))
    sums = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return own.select(batch, sums.alias("cu_seqlens"), *[F.flatten(F.col(f"_r.{c}")).alias(c) for c in arrays])


def route_tokens(rows: DataFrame, models: list[int]) -> DataFrame:
    """A copy of each sequence for every model with tokens in it, whose ``loss_mask`` keeps that model's (``model_ids``).

    Sequences without ``model_ids`` or ``loss_mask`` go to every model as they are.
    """
    each = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    whole = F.col("model_ids").isNull() | F.col("loss_mask").isNull()
    own = F.zip_with("loss_mask", "model_ids", lambda m, i: F.when(i == F.col("model"), m).otherwise(F.lit(0)))
    return each.withColumn("_own", F.when(whole, F.col("loss_mask")).otherwise(own)).where(whole | F.exists("_own", lambda m: m > 0)).withColumn("loss_mask", F.col("_own")).drop("_own")


def policy_loss(rows: DataFrame, sequence: str, *, low: float, high: float, dual: float | None, level: str = "token") -> DataFrame:
    """Token rows (``logprob, old_logprob, advantage, mask`` of a ``sequence``) with ``ratio, loss, clipped, dual_clipped``.

    At the level of sequences the ratio is the geometric mean of a sequence's masked tokens and the advantage their
    mean. Masked tokens have ratio and loss 0 and no flag.
    """
    used, gap, advantage = F.col("mask") > 0, F.col("logprob") - F.col("old_logprob"), F.col("advantage")
    if level == "sequence":
        w = Window.partitionBy(sequence)
        n = F.greatest(F.sum(used.cast("int")).over(w), F.lit(1))
        gap, advantage = F.sum(F.when(used, gap).otherwise(0.0)).over(w) / n, F.sum(F.when(used, advantage).otherwise(0.0)).over(w) / n
    made = rows.withColumn("ratio", F.when(used, F.exp(gap)).otherwise(0.0)).withColumn("_a", advantage)
    plain, cut_ = -F.col("_a") * F.col("ratio"), -F.col("_a") * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), F.col("ratio")))
    made = made.withColumn("_worst", F.greatest(plain, cut_)).withColumn("clipped", used & (plain < cut_))
    bound = F.abs("_a") * dual if dual else F.col("_worst")
    made = made.withColumn("dual_clipped", used & (bound < F.col("_worst")))
    return made.withColumn("loss", F.when(used, F.least(F.col("_worst"), bound)).otherwise(0.0)).drop("_a", "_worst")


def huber(x: Column, y: Column, delta: float = 10.0) -> Column:
    off = F.abs(x - y)
    return F.when(off < delta, 0.5 * off * off).otherwise(delta * (off - 0.5 * delta))


def value_loss(value: Column, old: Column, target: Column, clip: float, kind: str = "mse") -> tuple[Column, Column]:
    """The greater of the losses of a value and of its clipped form, and whether that is the clipped one's."""
    one = huber if kind == "huber" else (lambda x, y: 0.5 * (x - y) * (x - y))
    plain, near = one(value, target), one(old + F.greatest(F.lit(-clip), F.least(F.lit(clip), value - old)), target)
    return F.greatest(plain, near), near > plain
