"""Session traces: step boundaries and assignment, gaps, quantiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ranking import exact_percentiles, greatest_before, place_within
from tidewheel.functions.sizes import broadcast_if_small


#: Seconds of the buckets in which a rank's times are put in order.
BUCKET_S = 3600


def step_boundaries(sessions: DataFrame, tasks_per_step: int) -> DataFrame:
    """``step, step_end``: when every rank has finished its share of a step; steps that some rank never ends are dropped."""
    ends = sessions.where("status = 'accepted'").groupBy("rank", "task_id").agg(F.max("finalized_ts").alias("task_end"))
    placed = place_within(ends, ["rank"], F.floor(F.col("task_end") / BUCKET_S), [F.col("task_end"), F.col("task_id")], "_place")
    steps = placed.withColumn("step", F.floor(F.col("_place") / tasks_per_step).cast("long")).groupBy("rank", "step").agg(F.max("task_end").alias("end"), F.count(F.lit(1)).alias("n"))
    ranks = sessions.select("rank").distinct().agg(F.count(F.lit(1)).alias("ranks"))
    whole = steps.where(F.col("n") == tasks_per_step).groupBy("step").agg(F.max("end").alias("step_end"), F.count(F.lit(1)).alias("have"))
    return whole.join(F.broadcast(ranks), F.col("have") == F.col("ranks")).select("step", "step_end")  # ranks: one row


#: Sessions of a slot, on average.
SLOT_ROWS = 1 << 16


def assign_steps(sessions: DataFrame, boundaries: DataFrame, slot: float | None = None) -> DataFrame:
    """Each session's first step that ends at or after it; null after the last.

    An as-of join by slots of ``slot`` seconds, or of ``SLOT_ROWS`` sessions on average, however dense they are: in a slot, sessions and step ends are sorted together once, and each
    session takes the next end behind it. One behind its slot's last end takes the first of the next slot that has
    any; for that, the distinct slots alone are put in order, a row each.
    """
    if slot is None:
        n, first, last = sessions.agg(F.count(F.lit(1)), F.min("finalized_ts"), F.max("finalized_ts")).first()
        slot = max(((last or 0.0) - (first or 0.0)) / max(1, n // SLOT_ROWS), 1e-3)
    b = boundaries.select(F.floor(F.col("step_end") / slot).cast("long").alias("slot"), F.col("step_end").alias("_at"), F.col("step").alias("_step"))
    s = sessions.withColumn("slot", F.floor(F.col("finalized_ts") / slot).cast("long")).withColumn("_at", F.col("finalized_ts"))
    both = s.withColumn("_step", F.lit(None).cast("long")).unionByName(b.withColumn("_end", F.lit(True)), allowMissingColumns=True)
    # from the latest on, so that the frame only grows: one that shrinks is gone through again for every row
    behind = Window.partitionBy("slot").orderBy(F.desc("_at"), F.col("_end").desc_nulls_last(), F.desc("_step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_in", F.last("_step", ignorenulls=True).over(behind)).where("_end IS NULL").drop("_end", "_at", "_step")
    slots = s.select("slot").distinct().join(b.groupBy("slot").agg(F.min(F.struct("_at", "_step")).alias("_first")), "slot", "full")
    later = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = slots.select("slot", F.last("_first", ignorenulls=True).over(later)["_step"].alias("_later"))
    return found.join(nxt, "slot", "left").withColumn("step", F.coalesce("_in", "_later")).drop("slot", "_in", "_later")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles, least and greatest value of each group."""
    return exact_percentiles(rows, keys, value, {f"p{round(s * 100)}": s for s in shares}).drop("n")


def anomalies(rows: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """``rows`` with ``anomaly``: whether the value is over its group's percentile; null values aren't."""
    limit = exact_percentiles(rows, keys, value, {"_limit": share}).select(*keys, "_limit")
    return rows.join(broadcast_if_small(limit), keys, "left").withColumn("anomaly", F.coalesce(F.col(value) > F.col("_limit"), F.lit(False))).drop("_limit")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """Counts in bins of the Freedman-Diaconis width, but of at least a thousandth and a 120th of the span; without a spread of quartiles, of 40 to 120 parts of it."""
    facts = exact_percentiles(rows, [], value, {"q1": 0.25, "q3": 0.75}).select("q1", "q3", "n", F.col("least").alias("lo"), F.col("most").alias("hi"))
    span = F.col("hi") - F.col("lo")
    even = span / F.least(F.lit(120), F.greatest(F.lit(40), F.floor(F.col("n") / 2)))
    width = F.when(F.col("q3") > F.col("q1"), 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), F.lit(1 / 3))).otherwise(even)
    width = F.greatest(width, span / 120, F.lit(1e-3))
    facts = facts.select("lo", width.alias("width"))
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(facts)).groupBy(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # facts: one row


def offsets(rows: DataFrame, *columns: str) -> DataFrame:
    """Times less the earliest submit: a one-row aggregate joined back, not a global window."""
    start = rows.agg(F.min("submit_ts").alias("_start"))
    return rows.join(F.broadcast(start)).select(*[c for c in rows.columns if c not in columns], *[(F.col(c) - F.col("_start")).alias(c) for c in columns])


def idle_gaps(rows: DataFrame, keys: list[str], begin: str, end: str, least: float) -> DataFrame:
    """Gaps over ``least`` between what has ended so far and the next begin."""
    ended = greatest_before(rows, keys, F.floor(F.col(begin) / BUCKET_S), [F.col(begin), F.col("session_id")], end, "_ended")
    return ended.withColumn("gap", F.col(begin) - F.col("_ended")).where(F.col("gap") > least).drop("_ended")


def type_key(text: Column, *, negatives_last: bool = False) -> Column:
    """An order of JSON scalars of several types: booleans, whole numbers, other numbers, strings, each in its own order.

    ``negatives_last`` puts whole numbers below 0 behind those from 0 on, the nearest to 0 first.
    """
    t = F.trim(text)
    whole = F.when(t.rlike("^-?[0-9]+$"), t.try_cast("decimal(38,0)"))
    number, quoted = t.try_cast("double"), t.startswith('"')
    behind = (whole < 0) if negatives_last else F.lit(False)
    kind = F.when(t.isin("true", "false"), 0).when(whole.isNotNull() & ~behind, 1).when(whole.isNotNull(), 2).when(~quoted & number.isNotNull(), 3).when(quoted, 4).otherwise(5)
    own = F.when(kind == 0, F.when(t == "true", 1).otherwise(0).cast("decimal(38,0)")).when(behind, -whole).otherwise(whole)
    text_of = F.when(kind == 4, F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]).when(kind == 5, t)
    return F.struct(kind.cast("int").alias("kind"), own.alias("whole"), F.when(kind == 3, number).alias("number"), text_of.alias("text"))


def rank_key(rank: Column) -> Column:
    """An order of ranks given as text: whole numbers first, then others as text; null for a blank one."""
    t = F.trim(rank)
    whole = F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("decimal(38,0)"))
    return F.when(t != "", F.struct(F.when(whole.isNotNull(), 0).otherwise(1).alias("kind"), whole.alias("whole"), F.when(whole.isNull(), t).alias("text")))


def _coarse(key: Column) -> Column:
    """A part of a ``type_key`` that rises with it: keys of one range or of one first letter share it."""
    return F.struct(key["kind"], F.floor(key["whole"] / 65536), F.floor(key["number"] / 65536), F.substring(key["text"], 1, 1))


def process_ids(rows: DataFrame, rank: str = "rank", pid: str = "pid", tid: str = "tid") -> DataFrame:
    """``rows`` with ``new_pid`` and ``new_tid``: dense ids from 1 of (rank, pid), and those of (rank, pid, tid) from ``new_pid`` on.

    Both follow the order of ``rank_key`` and ``type_key``; keys are JSON scalars as text. Rows without a rank or a
    pid get null ids, rows without a tid a null ``new_tid``. Distinct keys are put in order by ranges, so that no task
    has all of them.
    """
    marked = rows.withColumns({"_r": rank_key(F.col(rank)), "_p": type_key(F.col(pid)), "_t": type_key(F.col(tid), negatives_last=True)})
    known = marked.where(F.col("_r").isNotNull() & F.col(pid).isNotNull())
    pids = known.select("_r", "_p").distinct()
    pids = place_within(pids, [], F.struct("_r", _coarse(F.col("_p"))), [F.col("_r"), F.col("_p")], "_n").withColumn("new_pid", (F.col("_n") + 1).cast("int")).drop("_n")
    same = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    tids = known.where(F.col(tid).isNotNull()).select("_r", "_p", "_t").distinct().alias("a").join(pids.alias("b"), same("a", "b", ["_r", "_p"])).select("b.new_pid", "a._t")
    tids = place_within(tids, ["new_pid"], _coarse(F.col("_t")), [F.col("_t")], "_n").withColumn("new_tid", (F.col("_n") + F.col("new_pid")).cast("int")).drop("_n")
    numbered = marked.alias("a").join(pids.alias("b"), same("a", "b", ["_r", "_p"]), "left").select("a.*", "b.new_pid")
    out = numbered.alias("a").join(tids.alias("b"), same("a", "b", ["new_pid", "_t"]), "left").select("a.*", F.when(F.col(f"a.{tid}").isNotNull(), F.col("b.new_tid")).alias("new_tid"))
    return out.drop("_r", "_p", "_t")


def flow_ids(rows: DataFrame, *ids: str, rank: str = "rank") -> DataFrame:
    """``rows`` with ``new_ID`` for each of the columns ``ids``: dense ids from 1 of all (rank, id) that any of them holds."""
    marked = rows.withColumn("_r", rank_key(F.col(rank)))
    keys = marked.where(F.col("_r").isNotNull()).select("_r", F.explode(F.array(*ids)).alias("_v")).where("_v IS NOT NULL").select("_r", type_key(F.col("_v")).alias("_k")).distinct()
    order = place_within(keys, [], F.struct("_r", _coarse(F.col("_k"))), [F.col("_r"), F.col("_k")], "_n").withColumn("_id", (F.col("_n") + 1).cast("int")).drop("_n")
    for c in ids:
        both = marked.withColumn("_k", type_key(F.col(c))).alias("a").join(order.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("_r", "_k")], "left")
        marked = both.select("a.*", "b._id").withColumnRenamed("_id", f"new_{c}").drop("_k")
    return marked.drop("_r")
