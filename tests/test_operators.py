"""Hand-made cases of the operators: buffer order, evaluation numbers, packing, advantages and edge rows."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import catalogue, curation, evaluation, graph, groups, packing, retrieval, scoring, selection, tokens, traces

BUFFER = "seq_no long, min_version int, seq_len int"


def buffer(spark, rows):
    return spark.createDataFrame([(tag, v, 8) for tag, v in rows], BUFFER)


def taken(df):
    return [r["seq_no"] for r in df.collect()]


@pytest.mark.parametrize(
    "policy,rows,n,current,stale,want",
    [
        ("fifo", [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], 5, 4, 9, [0, 1, 2, 3, 4]),
        ("fifo", [(0, 0), (1, 5)], 1, 5, 2, [1]),
        ("fifo", [(0, 0), (1, 1), (2, 2)], 5, 2, 9, []),
        ("edf", [(0, 7), (1, 3), (2, 5)], 3, 7, 9, [1, 2, 0]),
        ("edf", [(0, 2), (1, 2), (2, 2), (3, 2)], 4, 2, 9, [0, 1, 2, 3]),
        ("edf", [(0, 0), (1, None)], 1, 0, 9, [1]),
    ],
)
def test_buffer_order(spark, policy, rows, n, current, stale, want):
    assert sorted(taken(selection.select_batch(buffer(spark, rows), n, current=current, max_staleness=stale, policy=policy))) == sorted(want)


def test_stale_head_is_counted(spark):
    s = selection.consume_stats(buffer(spark, [(0, 0), (1, 5), (2, 0)]), 1, current=5, max_staleness=2, policy="fifo").first()
    assert (s["consumed"], s["skipped_stale"]) == (1, 1)


def test_eviction_agrees_with_a_heap(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(6)) for i in range(40)]
    held = []
    for tag, v in rows:
        if len(held) == 7:
            heapq.heappop(held)
        heapq.heappush(held, (v, tag))
    got = selection.evict_to_capacity(buffer(spark, rows).withColumn("k", F.lit(1)), 7, ["k"])
    assert sorted(taken(got)) == sorted(t for _, t in held)


def test_replay_is_read_before_fresh(spark):
    rows = [(i, 1) for i in range(10)]
    got = selection.mix_batch(buffer(spark, rows[:6]), buffer(spark, rows[6:]), 6, 0.5, current=1, max_staleness=2).collect()
    assert sorted(r["seq_no"] for r in got if r["part"] == "replay") == [7, 8, 9] and len(got) == 6


def test_eval_numbers(spark):
    rows = [("d", 1, i == 0, 0.0) for i in range(4)] + [("d", 2, False, 0.0) for _ in range(4)]
    df = spark.createDataFrame(rows, "dataset string, sample long, correct boolean, reward double")
    assert evaluation.avg_at_k(df).where("dataset = 'overall'").first()["avg_at_k"] == 12.5
    assert evaluation.pass_at_k_means(df, 4).first()["pass_at_k"] == 50.0
    assert [r["k"] for r in evaluation.pass_at_k_suite(df, [1, 4, 5]).orderBy("k").collect()] == [1, 4]


def test_groups(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.5), (3, 0, 0.1), (3, 1, 0.1)], "g int, o int, reward double")
    stats = {r["g"]: r for r in groups.group_reward_stats(df, ["g"]).collect()}
    assert stats[2]["g_std"] == 1.0 and abs(stats[1]["g_std"] - 0.5**0.5) < 1e-12
    assert {r["g"]: r["zero_adv"] for r in groups.zero_advantage(df, ["g"], "o").collect()} == {1: 0, 2: 1, 3: 1}
    loo = {(r["g"], r["o"]): r["normalized"] for r in groups.normalize(df, mean_over=["g"], std_over=None, leave_one_out=True).collect()}
    assert loo[1, 0] == -1.0 and loo[2, 0] == 0.5
    assert groups.normalize(df, mean_over=None, std_over=["g"]).count() == 5


def test_controller_clamps(spark):
    rows = [("a", v, 1.0, 1, 1, "easy") for v in range(3)]
    df = spark.createDataFrame(rows, "prompt_id string, version int, g_mean double, zero_adv int, n_trajs int, kind string")
    got = [(r["version"], round(r["p_easy"], 6), round(r["p_hard"], 6)) for r in curation.controller(df, p0=0.015).collect()]
    assert got == [(0, 0.01, 0.025), (1, 0.01, 0.035), (2, 0.01, 0.045)]


def test_contiguous_parts_by_all_cuts():
    rng = random.Random(8)
    for _ in range(1500):
        n = rng.randrange(1, 11)
        parts = rng.randrange(1, n + 1)
        least = rng.randrange(1, n // parts + 1)
        lengths = [rng.randrange(0, rng.choice([2, 10, 50])) for _ in range(n)]

        def sums(starts):
            return [sum(lengths[a:b]) for a, b in zip(starts, [*starts[1:], n])]

        every = [[0, *c] for c in itertools.combinations(range(1, n), parts - 1)]
        allowed = [c for c in every if all(b - a >= least for a, b in zip(c, [*c[1:], n]))]
        got = packing.contiguous_parts(lengths, parts, least)
        assert got in allowed
        assert max(sums(got)) - min(sums(got)) == min(max(sums(c)) - min(sums(c)) for c in allowed)
    for wrong in (([1, 2], 3, 1), ([1, 2, 3], 2, 2), ([1], 0, 1), ([1, -1], 1, 1), ([], 1, 1)):
        with pytest.raises(ValueError):
            packing.contiguous_parts(*wrong)


def test_packing_uses_each_row_once():
    rng = random.Random(6)
    for _ in range(100):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        packs = packing.first_fit_decreasing(lengths, 64, min_groups=3, divisor=2)
        assert sorted(i for p in packs for i in p) == list(range(len(lengths))) and len(packs) % 2 == 0
        assert all(sum(lengths[i] for i in p) <= 64 for p in packs)
        bins = packing.balanced_bins(lengths, 4)
        assert max(bins.count(b) for b in range(4)) <= -(-len(lengths) // 4)
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([65], 64)


def test_gae(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0], [0.5, 0.4, 0.3], [1, 0, 1]), ([], [], [])], "rewards array<double>, values array<double>, loss_mask array<int>")
    got = tokens.gae(df, gamma=0.9, lam=0.8).collect()[0]["advantages"]
    last = 1.0 - 0.3
    assert got == pytest.approx([0.9 * 0.3 - 0.5 + 0.9 * 0.8 * last, 0.0, last])


def test_scoring(spark):
    df = spark.createDataFrame([("The  Cat, sat!", "cat sat"), ("", "x"), ("paris france", "Paris"), (None, "x")], "p string, g string")
    r = df.select(scoring.exact_match(F.col("p"), F.col("g")).alias("em"), scoring.sub_match(F.col("p"), F.col("g")).alias("sub"), scoring.token_f1(F.col("p"), F.col("g")).alias("f1"), scoring.cover_match(F.col("p"), F.col("g")).alias("c")).collect()
    assert (r[0]["em"], r[0]["sub"], r[2]["em"], r[2]["sub"], r[1]["f1"], r[0]["c"]) == (1, 1, 0, 1, 0.0, 1)
    assert r[2]["f1"] == pytest.approx(2 / 3) and r[3]["em"] is None
    x = spark.createDataFrame([("<answer>a</answer> <answer>b</answer>",), ("none",)], "t string").select(scoring.last_match(F.col("t"), "(?s)<answer>(.*?)</answer>").alias("a"), scoring.balanced_tags(F.col("t"), ["answer"]).alias("ok")).collect()
    assert [tuple(r) for r in x] == [("b", False), (None, True)]


def test_dense_topk_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 16))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(200)], "vec_id long, embedding array<float>").repartition(5)
    got = retrieval.dense_topk(df, df.where("vec_id % 20 = 0"), 7, block=3).collect()
    unit = m.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        want = np.argsort(-np.round(unit @ unit[q], 6), kind="stable")[:7].tolist()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert retrieval.dense_topk(df, df.limit(0), 3).count() == 0


def test_steps_and_prices(spark):
    s = spark.createDataFrame([(i, i, i % 2, float(i), "accepted") for i in range(9)], "session_id long, task_id long, rank int, finalized_ts double, status string")
    b = traces.step_boundaries(s, 2)
    assert [(r["step"], r["step_end"]) for r in b.orderBy("step").collect()] == [(0, 3.0), (1, 7.0)]
    for slot in (2.0, None):
        got = {r["session_id"]: r["step"] for r in traces.assign_steps(s, b, slot).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: None}
    p = spark.createDataFrame([("$1,234.50 - $2",), ("",), ("free",)], "t string").select(catalogue.parse_price(F.col("t"))[0].alias("p")).collect()
    assert [r["p"] for r in p] == [[1234.5, 2.0], [100.0], [100.0]]


def test_depth_stops_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "item string, part string")
    assert {r["item"]: r["depth"] for r in graph.chain_depth(e, 5).collect()} == {"a": 2, "b": 1, "x": 5, "y": 5}
