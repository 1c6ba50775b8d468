"""Ranges of whole numbers [start, end): merged, and less what is done, without a row for each number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.lineage import cut as written

#: Ranges are cut at multiples of this, so that the numbers of one key are worked on in pieces.
WIDTH = 1 << 16

RUN = "time struct<timestamp: long, str: string>, index long, output struct<status: string, result: string>"


def parse_runs(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """``keys, index`` of the JSON lines that tell of a finished run; broken lines and those without time, index or output are left out."""
    run = F.from_json(line, RUN, {"mode": "PERMISSIVE"})
    return lines.select(*keys, run.alias("_run")).where("_run.time IS NOT NULL AND _run.index IS NOT NULL AND _run.output IS NOT NULL").select(*keys, F.col("_run.index").alias("index"))


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]


def cut(ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """Ranges in pieces that don't go over a multiple of ``width``, with that multiple as ``block``; empty ones are left out."""
    blocks = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    pieces = ranges.where("end > start").withColumn("block", F.explode(blocks))
    return pieces.withColumns({"start": F.greatest("start", F.col("block") * width), "end": F.least("end", (F.col("block") + 1) * width)})


def _merged_in(pieces: DataFrame, group: list[str]) -> DataFrame:
    """Overlapping or touching ranges of a group as one: a new one begins where all before have ended."""
    order = Window.partitionBy(*group).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = pieces.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = fresh.withColumn("_n", F.sum("_new").over(order))
    return numbered.groupBy(*group, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_n")


def rejoin(pieces: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``keys, start, end``: disjoint pieces of blocks, with those that meet at a block's edge put together again.

    Only pieces at an edge, at most two a block, are put in order for a whole key.
    """
    edge = (F.col("start") == F.col("block") * width) | (F.col("end") == (F.col("block") + 1) * width)
    return pieces.where(~edge).select(*keys, "start", "end").unionByName(_merged_in(pieces.where(edge), keys).select(*keys, "start", "end"))


def merge(ranges: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """The fewest ranges of each key that cover the same numbers."""
    return rejoin(_merged_in(cut(ranges, width), [*keys, "block"]), keys, width)


def subtract(ranges: DataFrame, points: DataFrame, keys: list[str], point: str = "index", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """What is left of ``ranges`` without ``points``, as ``keys, start, end``; and the points that are in no range, ``keys, point``.

    Within a block ranges and points are put in order together: a point belongs to the last range that starts at or
    before it, and what lies between two neighbouring points, or a point and an end of its range, is left. Repeated
    points count once, overlapping ranges as one. The ordered marks are written once: what is left, inside blocks and
    at their edges, and what is outside are all read from them.
    """
    pieces = _merged_in(cut(ranges, width), [*keys, "block"])
    at = points.where(F.col(point).isNotNull()).select(*keys, F.col(point).alias("p")).distinct().withColumn("block", F.floor(F.col("p") / width))
    marks = pieces.select(*keys, "block", F.col("start").alias("p"), F.struct("start", "end").alias("_r")).unionByName(at.withColumn("_r", F.lit(None).cast("struct<start: bigint, end: bigint>")))
    order = Window.partitionBy(*keys, "block").orderBy("p", F.col("_r").isNull())
    held = written(marks.withColumn("_in", F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    outside = held.where("_r IS NULL AND (_in IS NULL OR p >= _in.end)").select(*keys, F.col("p").alias(point))
    # a range's start stands for a point just before it
    inside = held.where("_r IS NOT NULL OR p < _in.end").withColumn("_done", F.when(F.col("_r").isNull(), F.col("p")).otherwise(F.col("p") - 1))
    own = Window.partitionBy(*keys, "block", "_in.start").orderBy("_done")
    gaps = inside.select(*keys, "block", (F.col("_done") + 1).alias("start"), F.coalesce(F.lead("_done").over(own), F.col("_in.end")).alias("end")).where("end > start")
    return rejoin(gaps, keys, width), outside


def remaining(assigned: DataFrame, runs: DataFrame, finished: DataFrame, keys: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Index ranges of each pair that are still to be run, and finished indices that nobody asked for.

    Pairs of ``finished`` have their overall result and are done, whatever their runs say.
    """
    open_ = lambda df: df.alias("x").join(finished.select(*keys).distinct().alias("y"), _same(keys), "left_anti")
    return subtract(open_(assigned), open_(runs), keys, "index", width)
