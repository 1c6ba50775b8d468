"""Steps that must not grow faster than their input, and results that must hold at every size."""

import bisect
import itertools
import math
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import sizes
from tidewheel.jobs import corpora, evaluation, operations, timelines
from tidewheel.operators import graph, intervals, packing, retrieval, tokens, traces


def planned(df):
    return df._jdf.queryExecution().toString()


def test_steps_of_one_dense_slot(spark):
    """Frames only grow: one that ends behind the last row is gone through again for every row."""
    rng = random.Random(11)
    times = [rng.randrange(200_000) / 4 for _ in range(20_000)]
    ends = sorted(rng.sample(range(49_000), 300))
    s = spark.createDataFrame(list(enumerate(times)), "session_id int, finalized_ts double")
    b = spark.createDataFrame([(i, float(t)) for i, t in enumerate(ends)], "step long, step_end double")
    out = traces.assign_steps(s, b)
    assert "unboundedfollowing" not in planned(out).lower()
    want = [bisect.bisect_left(ends, t) for t in times]
    assert {r["session_id"]: r["step"] for r in out.collect()} == {i: w if w < len(ends) else None for i, w in enumerate(want)}


def test_clip_range_adds_row_by_row(spark):
    """Means that are the threshold but for the last bit: a product for equal squares falls on the other side."""
    gaps = [0.6 - 0.5] * 4 + [0.7000000000000001 - 0.5] * 3 + [0.8999999999999999 - 0.5] + [0.4] * 2 + [0.5] * 2
    squares = sorted(g * g for g in gaps)
    upto = [s / (i + 1) for i, s in enumerate(itertools.accumulate(squares))]
    tau = math.sqrt(max(m for m, u in zip(squares, upto) if u < 0.04))
    df = spark.createDataFrame([(0, g, True) for g in gaps] + [(1, 0.5, False)], "batch int, gap double, used boolean").repartition(3)
    got = {r["batch"]: (r["low"], r["high"]) for r in tokens.clip_range(df, "batch", "gap", F.col("used"), threshold=0.04).collect()}
    assert got == {0: (pytest.approx(1 - math.exp(-tau)), pytest.approx(math.exp(tau) - 1)), 1: (0.95, 20.0)}


def recorded(monkeypatch, *modules):
    """Plans of what the modules write, as they are written."""
    plans = []
    for m, name in modules:
        real = getattr(m, name)
        monkeypatch.setattr(m, name, lambda df, real=real: plans.append(planned(df)) or real(df))
    return plans


def test_recipes_do_not_go_through_the_driver(spark, monkeypatch):
    """What is estimated small, but has many rows, isn't broadcast at every level."""
    items = spark.range(1, 300_001).withColumnRenamed("id", "item")
    uses = items.select("item", F.floor(F.col("item") / 1000).cast("long").alias("part"), F.lit(2).cast("long").alias("uses")).where("part > 0")
    targets = spark.createDataFrame([(1, 250_000, 3)], "target long, item long, count long")
    plans = recorded(monkeypatch, (graph, "cut"))
    got = graph.base_materials(targets, items.where("item >= 1000").withColumn("makes", F.lit(1)), uses, items.withColumn("have", F.lit(1))).collect()
    assert [tuple(r) for r in got] == [(1, 250, 3)]
    assert [(r["item"], r["depth"]) for r in graph.recipe_chain(targets, uses).collect()] == [(250_000, 0)]
    assert len(plans) > 4 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_packing_tries_many_multiples():
    """A group for every length, an odd number of them: every even number of groups up to it is tried."""
    t = time.process_time()
    groups = packing.first_fit_decreasing([512] * 1201, 512, 4, 2)
    assert sorted(groups, reverse=True) == [[i] for i in reversed(range(1201))] + [[]]
    assert time.process_time() - t < 10


def test_partition_keeps_only_near_sums():
    """Sums of all runs of a list are its square; those near the mean are few."""
    lengths = [random.Random(3).randrange(1, 51) for _ in range(3000)]
    tracemalloc.start()
    cuts = packing.contiguous_parts(lengths, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cuts) == 8 and cuts[0] == 0 and cuts == sorted(cuts)
    assert peak < 20e6


SMALL = "/root/testdata/sf0.001"


def test_terms_are_found_once_in_many_tasks(spark):
    """A well compressed file of many items isn't read and cut into terms by one task, nor its words found for every run."""
    p = corpora._parts(spark, SMALL)
    assert p._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 1
    assert sizes.spread(spark.range(3 * sizes.SPREAD_ROWS + 1), "id").rdd.getNumPartitions() == 4
    assert "REPARTITION_BY_NUM" in planned(p)


def test_cases_are_dealt_before_they_are_gathered(spark):
    plan = evaluation.testcase_pass_rate(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_postings_are_dealt_by_document(spark, monkeypatch):
    plans = recorded(monkeypatch, (retrieval, "cut"))
    corpora.bm25_search(spark, SMALL)
    assert "REPARTITION_BY_NUM" in plans[0]


def test_steps_read_several_times_are_written_once(spark, monkeypatch):
    plans = recorded(monkeypatch, (intervals, "written"), (timelines, "cut"))
    operations.remaining_ranges(spark, SMALL)
    assert len(plans) == 1
    for query in (timelines.session_timeline, timelines.timeline_sweep):
        del plans[:]
        left = planned(query(spark, SMALL))
        assert len(plans) == 2 and "lineitem" not in left
