"""Structured Streaming forms of ingestion, windows by version, session lifecycles and curation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewheel.operators import curation

ROLLOUT = "prompt_id string, version int, rewards array<double>, ts timestamp"


def read_rollouts(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(ROLLOUT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(rollouts: DataFrame) -> DataFrame:
    """Sequences with their group's statistics; a record holds its whole group, so nothing is kept between batches."""
    n = F.size("rewards")
    mean = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + (x - F.col("g_mean")) * (x - F.col("g_mean")))
    first = F.element_at("rewards", 1)
    stamped = rollouts.where(n > 0).withColumn("g_mean", mean).withColumn("g_std", F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(1.0))
    stamped = stamped.withColumn("zero_adv", F.forall("rewards", lambda x: F.abs(x - first) <= 1e-8 + 1e-5 * F.abs(first)).cast("int"))
    return stamped.select("prompt_id", "version", "ts", "g_mean", "g_std", "zero_adv", F.posexplode("rewards").alias("traj_idx", "reward"))


def drop_stale(sequences: DataFrame, current: int, max_staleness: int) -> DataFrame:
    """The late-data rule: lateness is the gap between weight versions."""
    return sequences.where(F.col("version").isNull() | (F.lit(current) - F.col("version") <= max_staleness))


def version_tallies(rollouts: DataFrame, width: int = 1) -> DataFrame:
    """Counts in tumbling windows of ``width`` versions."""
    return rollouts.groupBy((F.floor(F.col("version") / width) * width).cast("int").alias("version")).agg(F.count(F.lit(1)).alias("rollouts"), F.sum(F.size("rewards")).alias("sequences"))


def periodic_report(rollouts: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Sliding windows of event time; the watermark bounds the state."""
    return rollouts.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("rollouts"), F.avg(F.size("rewards")).alias("mean_group"))


STATE = "streak long, kind string, success double"
DECISION = "prompt_id string, version int, streak long, kind string, success double"


def curate(rollouts: DataFrame, decay: float = 0.9) -> DataFrame:
    """Each prompt's streak of outcomes without signal and its success average, kept in keyed state.

    Rows of a batch are folded in version order; the batch form is ``operators.curation``.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, kind, success = state.get if state.exists else (0, None, 0.0)
        version = None
        rows = pd.concat(list(batches)).sort_values("version")
        for version, rewards in zip(rows["version"], rows["rewards"], strict=True):
            mean = sum(rewards) / len(rewards)
            if max(rewards) - min(rewards) > 1e-8:
                streak, kind = 0, None
            else:
                now = "easy" if mean > 0.5 else "hard"
                streak, kind = (streak + 1 if now == kind else 1), now
            success = decay * success + (1 - decay) * sum(r > 0 for r in rewards) / len(rewards)
        state.update((streak, kind, success))
        yield pd.DataFrame({"prompt_id": [key[0]], "version": [version], "streak": [streak], "kind": [kind], "success": [success]})

    return rollouts.where(F.size("rewards") > 0).groupBy("prompt_id").applyInPandasWithState(fold, DECISION, STATE, "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Session lifecycles by gaps of event time (``session_id, ts, status``)."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"), F.max_by("status", "ts").alias("status"))


def write_counters(rollouts: DataFrame, path: str, checkpoint: str):
    """Counters a batch, keyed by batch id and overwritten, so that a replayed batch counts once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.agg(F.count(F.lit(1)).alias("rollouts"), F.sum(F.size("rewards")).alias("sequences")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rollouts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The table that the batch before ``number`` left under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 1}")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(f"{path}/batch={number - 1}") if number and there else None


def _drop(spark: SparkSession, path: str, number: int) -> None:
    """Deletes what batch ``number`` left, once two later ones stand: a replayed batch reads only the one before it."""
    if number >= 0:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def control(rollouts: DataFrame, path: str, checkpoint: str, **settings):
    """Submission probabilities after each version so far, under ``path``/batch=N/control, steered as ``operators.curation.steer`` does.

    Kept from batch to batch are tallies, a row a version (``/tallies``). Each batch reads those of the one before and
    overwrites its own folder, so a replayed batch counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lows, highs = F.array_min("rewards"), F.array_max("rewards")
        mean = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x) / F.size("rewards")
        kind = F.when(highs - lows <= 1e-8, F.when(mean > 0.5, "easy").otherwise("hard"))
        fresh = curation.shares(batch.where(F.size("rewards") > 0).select("version", kind.alias("kind")))
        old = _before(spark, f"{path}/tallies", number)
        both = fresh if old is None else fresh.unionByName(old)
        tallies = both.groupBy("version").agg(*[F.sum(c).alias(c) for c in ("easy", "hard", "n")])
        tallies.coalesce(1).write.mode("overwrite").parquet(f"{path}/tallies/batch={number}")  # a row a version
        curation.steer(spark.read.parquet(f"{path}/tallies/batch={number}"), **settings).write.mode("overwrite").parquet(f"{path}/control/batch={number}")
        _drop(spark, f"{path}/tallies", number - 2)
        _drop(spark, f"{path}/control", number - 2)

    return rollouts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def smooth_waits(steps: DataFrame, path: str, checkpoint: str, alpha: float = 0.1):
    """Exponential averages of ``wait`` and ``step`` of each ``agent`` in order of ``ts``, a row an agent, under ``path``/batch=N.

    A batch's own average in closed form is added to the one before, aged by the batch's rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _before(spark, path, number)
        rows = batch.select("agent", "ts", "wait", "step").withColumn("first", F.lit(False))
        if old is not None:  # what was known stands as the first value, before all of this batch
            rows = rows.unionByName(old.select("agent", F.lit("1970-01-01").cast("timestamp").alias("ts"), "wait", "step", F.lit(True).alias("first")))
        own = curation.smoothed(rows, ["agent"], [F.desc("first"), "ts"], ["wait", "step"], alpha)
        own.select("agent", "wait", "step", curation.wait_fraction(F.col("wait"), F.col("step")).alias("fraction")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        _drop(spark, path, number - 2)

    return steps.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retain_latest(rows: DataFrame, path: str, checkpoint: str, most: int, order: str = "seq_no"):
    """The ``most`` latest rows so far by ``order``, under ``path``/batch=N: a bounded top of the batch and of what the batch before held."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _before(spark, path, number)
        both = batch if old is None else batch.unionByName(old)
        both.orderBy(F.desc(order)).limit(most).write.mode("overwrite").parquet(f"{path}/batch={number}")
        _drop(spark, path, number - 2)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
