"""Katz backoff models of any order as stored tables: discounted n-grams and backoff weights, partitioned by history bucket."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.katz import DELTA, K, discounts
from tidewheel.llm.tables import durable, whole_text

BUCKETS = 64
#: Hold white space, so that no word equals them.
_START, _END = " start", " end"


@dataclass
class Model:
    """``grams[k - 1]``: (h, w, c, p) and ``backoff[k - 2]``: (h, alpha), of order k."""

    order: int
    grams: list[DataFrame]
    backoff: list[DataFrame]
    tokens: int
    types: int
    unknown: float


def _tokens(docs: DataFrame, order: int) -> DataFrame:
    """Every token ``w`` of ``text`` with its histories ``h1`` (none) to the last ``order - 1`` words; other columns stay."""
    low = F.translate(whole_text(), string.ascii_uppercase, string.ascii_lowercase)
    ws = F.filter(F.split(low, "[\\x20\\x09-\\x0d]+"), lambda w: w != "")
    padded = F.concat(F.array(*[F.lit(_START)] * (order - 1)), ws, F.array(F.lit(_END))) if order > 1 else F.concat(ws, F.array(F.lit(_END)))
    rest = [c for c in docs.columns if c != "text"]
    at = docs.select(*rest, padded.alias("_ws")).select(*rest, "_ws", F.explode(F.sequence(F.lit(order), F.size("_ws"))).alias("_at"))
    history = lambda k: F.array_join(F.slice("_ws", F.col("_at") - k + 1, F.lit(k - 1)), "\n") if k > 1 else F.lit("")
    return at.select(*rest, F.element_at("_ws", F.col("_at")).alias("w"), *[history(k).alias(f"h{k}") for k in range(1, order + 1)])


def _kept(d: list[float]) -> Column:
    """A count less its discount."""
    low = F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(F.col("c"), F.lit(K)).cast("int"))
    return F.when(F.col("c") <= K, low * F.col("c")).otherwise(F.col("c") - DELTA)


def _stored(table: DataFrame) -> DataFrame:
    bucket = F.pmod(F.xxhash64("h"), F.lit(BUCKETS)).cast("int")
    return durable(table.withColumn("bucket", bucket).repartition("bucket"), partition_by=("bucket",))[0].select(table.columns)


def fit(texts: DataFrame, order: int) -> Model:
    """The model of the words of ``text``, as ``katz.score_corpus`` defines it for order 2; histories start with ``order - 1`` starts."""
    tokens = _tokens(texts.select("text"), order)
    grams, backoff = [], []
    total, types, unknown = 0, 0, 1.0
    for k in range(1, order + 1):
        counts, _ = durable(tokens.groupBy(F.col(f"h{k}").alias("h"), "w").agg(F.count(F.lit(1)).alias("c")))
        of = {r["c"]: float(r["n"]) for r in counts.where(F.col("c") <= K + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most K + 1 rows
        kept = counts.select("h", "w", "c", _kept(discounts([of.get(r, 0.0) for r in range(1, K + 2)]).tolist()).alias("kept"))
        totals = counts.groupBy("h").agg(F.sum("c").alias("total"))
        grams.append(_stored(kept.join(totals, "h").select("h", "w", "c", (F.col("kept") / F.col("total")).alias("p"))))
        if k == 1:
            row = grams[0].agg(F.sum("c"), F.count(F.lit(1)), F.sum("p")).first()
            total, types, unknown = int(row[0] or 0), int(row[1]), 1 - float(row[2] or 0)
        else:
            # a seen n-gram's shorter form was seen as well, so that its probability stands in the table below
            below = grams[-2].select(F.col("h").alias("_h"), "w", F.col("p").alias("q"))
            shorter = F.when(F.instr("h", "\n") > 0, F.regexp_replace("h", "^[^\n]*\n", "")).otherwise(F.lit(""))
            both = grams[-1].withColumn("_h", shorter).join(below, ["_h", "w"])
            backoff.append(_stored(both.groupBy("h").agg(((1 - F.sum("p")) / (1 - F.sum("q"))).alias("alpha"))))
    return Model(order, grams, backoff, total, types, unknown)


def score(model: Model, docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens, n_known, log_counts, score``: each token backs off until its n-gram is stored.

    Any texts, those of the model or others; ``docs`` is written once with a row number, so repeated rows stay apart.
    """
    own, _ = durable(docs.withColumn("_row", F.monotonically_increasing_id()))
    t = _tokens(own.select("_row", "text"), model.order)
    log_p, c = F.lit(0.0), None
    for k in range(1, model.order + 1):
        g = model.grams[k - 1].select(F.col("h").alias(f"h{k}"), "w", F.col("p").alias(f"p{k}"), F.col("c").alias(f"c{k}"))
        t = t.join(g, [f"h{k}", "w"], "left")
        if k == 1:
            log_p, c = F.log10(F.coalesce("p1", F.lit(model.unknown))), F.coalesce("c1", F.lit(0))
        else:
            t = t.join(model.backoff[k - 2].select(F.col("h").alias(f"h{k}"), F.col("alpha").alias(f"a{k}")), f"h{k}", "left")
            log_p = F.when(F.col(f"p{k}").isNotNull(), F.log10(f"p{k}")).otherwise(F.log10(F.coalesce(f"a{k}", F.lit(1.0))) + log_p)
    sums = t.groupBy("_row").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(c > 0).alias("n_known"), F.sum(F.log10(c + 1.0)).alias("log_counts"), F.sum(log_p).alias("score"))
    return own.drop("text").join(sums, "_row").drop("_row")
