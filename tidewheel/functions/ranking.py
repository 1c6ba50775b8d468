"""Places and running values within few, large groups: by buckets that are ordered in parallel, behind what the buckets before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.lineage import cut
from tidewheel.functions.sizes import broadcast_if_small


def _with_bucket(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.withColumn("_bucket", bucket)


def place_within(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, count: str | None = None) -> DataFrame:
    """``name``: each row's place from 0 in its group by ``order``; ``count``: the group's rows, if asked for.

    ``bucket`` must rise with ``order``. Only the counts of buckets are put in order as one group.
    """
    marked = _with_bucket(rows, bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = counts.select(*keys, "_bucket", (F.sum("_n").over(group.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("_all"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    ranked = marked.withColumn("_own", own)
    same = F.lit(True)
    for c in [*keys, "_bucket"]:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    out = ranked.alias("x").join(before.alias("y"), same)
    return out.select("x.*", (F.col("y._before") + F.col("x._own")).alias(name), *([F.col("y._all").alias(count)] if count else [])).drop("_bucket", "_own")


def greatest_before(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the greatest ``value`` of the rows before each in its group; null for the first. ``bucket`` must rise with ``order``."""
    marked = _with_bucket(rows, bucket)
    tops = marked.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    before = tops.select(*keys, "_bucket", F.max("_top").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = marked.withColumn("_own", own)
    same = F.lit(True)
    for c in [*keys, "_bucket"]:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return ranked.alias("x").join(before.alias("y"), same).select("x.*", "y._before").withColumn(name, F.greatest("_before", "_own")).drop("_bucket", "_own", "_before")


#: Values of a bin that may be looked at one by one, and how often bins are cut finer before that.
CLOSE, LEVELS = 1 << 16, 6


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 1024) -> DataFrame:
    """``keys``, ``n``, ``least``, ``most`` and each share's percentile with linear interpolation; nulls don't count.

    Each wanted rank is looked for in a range, at first its group's. Counts of equal parts of the range tell in which
    part it lies, and that part is the next range, until it holds few values or a single one, however uneven the
    values are; only then are the counts of its distinct values put in order. A group without values isn't told of.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    facts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    facts = cut(facts)
    wanted = facts.select(*keys, "n", "least", "most", F.explode(F.array(*[F.struct(F.lit(k).alias("_share"), ((F.col("n") - 1) * F.lit(float(s))).alias("_at")) for k, s in shares.items()])).alias("w"))
    ranks = wanted.select(*keys, "w._share", "w._at", F.explode(F.array(F.floor("w._at"), F.ceil("w._at"))).alias("_rank"), F.col("least").alias("_lo"), F.col("most").alias("_hi"), F.lit(0).cast("long").alias("_before"), F.col("n").alias("_inside")).distinct()
    one = [*keys, "_rank"]
    ranges = ranks.select(*keys, "_rank", "_lo", "_hi", "_before", "_inside").distinct()
    meets = lambda df: known.join(broadcast_if_small(df), keys) if keys else known.join(broadcast_if_small(df))
    for _ in range(LEVELS):
        wide = (F.col("_inside") > CLOSE) & (F.col("_hi") > F.col("_lo"))
        if not ranges.where(wide).limit(1).count():
            break
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
        inside = meets(ranges.where(wide)).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        counts = inside.groupBy(*one, "_before", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*one).orderBy("_part"))
        finer = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n")).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        ranges = cut(ranges.where(~wide).unionByName(finer.select(*keys, "_rank", "_lo", "_hi", F.col("_from").alias("_before"), F.col("_n").alias("_inside"))))
    closer = meets(ranges).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).groupBy(*one, "_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = closer.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*one).orderBy("_v")))
    found = upto.where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n"))).select(*one, "_v")
    low, high = F.min("_v"), F.max("_v")
    value_of = ranks.select(*keys, "_share", "_at", "_rank").join(found, one).groupBy(*keys, "_share", "_at").agg((low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("_p"))
    wide_ = value_of.groupBy(*keys).agg(*[F.max(F.when(F.col("_share") == k, F.col("_p"))).alias(k) for k in shares])
    return facts.join(wide_, keys) if keys else facts.join(F.broadcast(wide_))  # without keys: one row
