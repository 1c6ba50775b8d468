"""Ranges less points, balance reports, ids of mixed types, snapshots, game reducers and metrics by hand."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import balance, benchmarks, catalogue, graph, intervals, traces
from tidewheel.sources import files


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_ranges_without_points(spark, width):
    rng = random.Random(width)
    ranges = [(k % 3, None if k % 3 == 2 else "t", a := rng.randrange(0, 200), a + rng.randrange(0, 40)) for k in range(40)]
    points = [(k % 3, None if k % 3 == 2 else "t", rng.randrange(0, 260)) for k in range(150)] + [(0, "t", None), (1, "t", 5), (1, "t", 5), (9, "t", 3)]
    keys = ["agent", "task"]
    left, outside = intervals.subtract(spark.createDataFrame(ranges, "agent long, task string, start long, end long"), spark.createDataFrame(points, "agent long, task string, index long"), keys, width=width)
    wanted, odd = {}, set()
    for a, t, s, e in ranges:
        wanted.setdefault((a, t), set()).update(range(s, e))
    for a, t, i in points:
        if i is not None and i not in wanted.get((a, t), ()):
            odd.add((a, t, i))
    for a, t, i in points:
        wanted.get((a, t), set()).discard(i)
    runs = sorted((str(k), s, e) for k, numbers in wanted.items() for s in numbers if s - 1 not in numbers for e in [next(x for x in range(s, 999) if x not in numbers)])
    assert sorted((str((r["agent"], r["task"])), r["start"], r["end"]) for r in left.collect()) == runs
    assert {(r["agent"], r["task"], r["index"]) for r in outside.collect()} == odd
    merged = intervals.merge(spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 20, 21), ("a", 3, 4), ("b", 7, 7)], "k string, start long, end long"), ["k"], width=4)
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 0, 9), ("a", 20, 21)]


def test_runs_with_broken_lines(spark):
    good = {"index": 3, "time": {"timestamp": 1, "str": "x"}, "output": {"status": "completed", "result": None}}
    lines = [json.dumps(good), json.dumps(good)[:-3], "", "[]", json.dumps(good | {"index": None}), json.dumps({k: v for k, v in good.items() if k != "time"}), json.dumps(good | {"output": None}), json.dumps(good | {"index": 4, "more": 1})]
    got = intervals.parse_runs(spark.createDataFrame([("a", x) for x in lines], "agent string, line string"), ["agent"]).collect()
    assert sorted(r["index"] for r in got) == [3, 4]
    assigned = spark.createDataFrame([("a", 0, 6), ("b", 0, 2)], "agent string, start long, end long")
    left, odd = intervals.remaining(assigned, spark.createDataFrame([("a", 3), ("a", 9), ("b", 0)], "agent string, index long"), spark.createDataFrame([("b",)], "agent string"), ["agent"])
    assert sorted(tuple(r) for r in left.collect()) == [("a", 0, 3), ("a", 4, 6)] and [tuple(r) for r in odd.collect()] == [("a", 9)]


def test_balance_zones(spark):
    """Each zone of waiting at its edges, windows that one side lacks, and shares in whole GPUs."""
    cases = {0: (0.11, 90, 100), 1: (0.10, 90, 100), 2: (0.05, 50, 100), 3: (0.049, 50, 100), 4: (0.99, 1, 1), 5: (0.0, 100, 50), 6: (0.0, 0, 10)}
    made = spark.createDataFrame([("a", w, "i", 200, e) for w, (_, _, e) in cases.items()], "agent string, window int, instance string, produced long, accepted long")
    used = spark.createDataFrame([("a", w, c, 1) for w, (_, c, _) in cases.items()] + [("a", 9, 5, 0)], "agent string, window int, consumed long, stale long")
    steps = spark.createDataFrame([("a", w, f * 10, 10.0) for w, (f, _, _) in cases.items() for _ in range(3)], "agent string, window int, wait_s double, step_s double")
    pool = spark.createDataFrame([("a", "i", 5, False), ("a", "j", 3, True), ("b", "k", 4, False)], "agent string, instance string, gpus long, suspect boolean")
    got = {r["window"]: r for r in balance.report(made, used, steps, pool, ["agent", "window"]).collect()}
    assert {w: (r["branch"], r["target"]) for w, r in got.items()} == {0: ("scale_up", 9), 1: ("hold", 8), 2: ("hold", 8), 3: ("scale_down", 5), 4: ("scale_up", 160), 5: ("scale_down", 8), 6: ("hold", 8), 9: ("hold", 8)}
    assert got[9]["entered"] == 0 and got[9]["wait_fraction"] == 0 and got[4]["wait_fraction"] == 0.95 and got[6]["produce_consume"] is None
    out = balance.layout(made.where("window < 2"), pool.where("instance <> 'i'"), ["agent", "window"]).collect()
    assert sorted((r["window"], r["instance"], r["status"]) for r in out) == [(0, "i", "gone"), (0, "j", "suspect"), (1, "i", "gone"), (1, "j", "suspect")]
    rows = spark.createDataFrame([("x", 10, "a", 1), ("x", 10, "b", 1), ("x", 10, "c", 1), ("y", 7, "a", 0), ("z", 5, "a", 3), ("z", 5, "b", 2)], "k string, total long, i string, w long")
    shares = {(r["k"], r["i"]): r["share"] for r in balance.apportion(rows, ["k"], "total", "w", "i").collect()}
    assert shares == {("x", "a"): 4, ("x", "b"): 3, ("x", "c"): 3, ("y", "a"): 0, ("z", "a"): 3, ("z", "b"): 2}


def test_ids_of_mixed_types(spark):
    """Numbers in order of size before texts, ranks given as numbers before names, and thread ids from the process's own on."""
    rng = random.Random(6)
    values = ["true", "false", "1.5", "-2.5", '"10"', '"9"', '"x"', *[str(k) for k in (*range(-3, 4), 70_000, 10**15)]]
    ranks = ["0", " 2 ", "10", "-1", "node", "b", "", None]
    rows = [(i, rng.choice(ranks), rng.choice([*values, None]), rng.choice([*values, None])) for i in range(700)]

    def kind(v):
        x = json.loads(v)
        return (0, int(x)) if isinstance(x, bool) else (1, x) if isinstance(x, int) else (2, x) if isinstance(x, float) else (3, x)

    def rank(v):
        return (0, int(v)) if v.strip().lstrip("-").isdigit() else (1, v.strip())

    def thread(v):
        k, x = kind(v)
        return (k, x) if k == 0 else (1, x) if k == 1 and x >= 0 else (2, -x) if k == 1 else (k + 1, x)

    known = [r for r in rows if r[1] and r[1].strip() and r[2] is not None]
    pids = {k: n for n, k in enumerate(sorted({(rank(r[1]), kind(r[2])) for r in known}), 1)}
    tids = {}
    for key in sorted({(rank(r[1]), kind(r[2]), thread(r[3])) for r in known if r[3] is not None}):
        own = [t for t in tids if t[:2] == key[:2]]
        tids[key] = pids[key[:2]] + len(own)
    got = traces.process_ids(spark.createDataFrame(rows, "i int, rank string, pid string, tid string").repartition(4)).collect()
    for r in got:
        i, k, p, t = rows[r["i"]]
        new = pids[rank(k), kind(p)] if k and k.strip() and p is not None else None
        assert r["new_pid"] == new and r["new_tid"] == (tids[rank(k), kind(p), thread(t)] if new and t is not None else None)
    flows = traces.flow_ids(spark.createDataFrame([(0, "1", "5", None), (1, "1", None, "5"), (2, "1", '"5"', "4"), (3, None, "5", "5"), (4, "0", "5", None)], "i int, rank string, a string, b string"), "a", "b").collect()
    assert sorted((r["i"], r["new_a"], r["new_b"]) for r in flows) == [(0, 3, None), (1, None, 3), (2, 4, 2), (3, None, None), (4, 1, None)]


def test_snapshots(spark, tmp_path):
    """The last whole generation is read; one without a manifest, or with half of one, isn't."""
    path = f"{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        files.restore_snapshot(spark, path)
    fresh = spark.createDataFrame([(0, 9, 8), (1, 1, 8), (2, 5, 8), (3, None, 8)], "seq_no long, min_version int, seq_len int")
    assert files.write_snapshot(fresh, fresh.where("seq_no = 1"), path, facts={"consumed": 4}) == 0
    back, replay, facts = files.restore_snapshot(spark, path)
    order = lambda df: [r["seq_no"] for r in df.orderBy("priority", "seq_no").collect()]
    assert order(back) == [0, 1, 2, 3] and replay.count() == 1 and facts == {"consumed": 4}
    assert order(files.restore_snapshot(spark, path, "edf")[0]) == [3, 1, 2, 0]
    fresh.limit(1).withColumn("part", F.lit("fresh")).write.partitionBy("part").parquet(f"{path}/entries/1")  # torn: no manifest
    assert files.restore_snapshot(spark, path)[0].count() == 4
    with open(f"{path}/manifests/1", "w") as f:
        f.write('{"generation": 1, "fr')
    assert files.restore_snapshot(spark, path)[0].count() == 4
    assert files.write_snapshot(fresh.limit(2), fresh.limit(0), path) == 2
    back, replay, facts = files.restore_snapshot(spark, path)
    assert back.count() == 2 and replay.count() == 0 and facts == {}
    assert sorted(os.listdir(f"{path}/entries")) == ["0", "1", "2"]


def test_legacy_snapshot_keeps_the_order_of_lines(spark, tmp_path):
    n = 4000
    for part in range(3):
        (tmp_path / f"part{part}.json").write_text("\n".join(json.dumps({"tag": part * n + i, "min_version": i % 7}) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a file is read in several blocks
    try:
        got = files.read_legacy_snapshot(spark, f"{tmp_path}/*.json", "tag long, min_version int")
        assert spark.read.json(f"{tmp_path}/*.json").rdd.getNumPartitions() > 3
        assert all(r["tag"] == r["seq_no"] for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_hidden_roles_and_card_logs(spark):
    beliefs = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 0, 0.2), ("a", 1, 1, -1.0), ("a", 1, 0, 0.5), ("a", 1, 1, 1.0)], "agent string, game int, side int, belief double")
    import math

    r = benchmarks.role_beliefs(beliefs, ["agent", "game"]).first()
    assert r["deduction"] == 3 / 5 and abs(r["cross_entropy"] + sum(map(math.log, (0.9, 0.8, 0.5, 0.5, 0.9999)))) < 1e-9
    me = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 1, 0.25), ("a", 1, 0, 0.9), ("a", 2, 0, 1.0)], "agent string, game int, side int, of_me double")
    assert {r["game"]: r["deception"] for r in benchmarks.role_deception(me, ["agent", "game"]).collect()} == {1: 0.375, 2: None}
    games = spark.createDataFrame([("a", 1, True, True), ("a", 2, False, True), ("a", 3, True, False)], "agent string, game int, completed boolean, won boolean")
    out = benchmarks.hidden_roles(games, [benchmarks.role_beliefs(beliefs, ["agent", "game"]), benchmarks.role_deception(me, ["agent", "game"])], ["agent"], "game").first()
    assert (out["win_rate"], round(out["deduction"], 9), out["deception"]) == (pytest.approx(1 / 3), 0.2, 0.375)
    frames = spark.createDataFrame([("a", 1, f, p, hp) for f, p, hp in [(0, 0, 400), (0, 1, 400), (1, 0, -5), (1, 0, 100), (1, 1, 350), (2, 0, 0)]] + [("a", 2, 0, 0, 1)], "agent string, game int, frame int, player int, hp int")
    errors = spark.createDataFrame([("a", 1, 1, 5, 1), ("a", 1, 1, 2, 0), ("a", 1, 0, 0, 1)], "agent string, game int, frame int, place int, player int")
    tries = spark.createDataFrame([("a", 1, 0, 3), ("a", 1, 0, 4), ("a", 2, 1, 9)], "agent string, game int, player int, try_times int")
    winners = spark.createDataFrame([("a", 1, 1), ("a", 2, 0)], "agent string, game int, winner int")
    got = {r["player"]: tuple(r)[2:] for r in benchmarks.card_logs(frames, errors, tries, winners, ["agent"], "game").collect()}
    # full_play, try_times, takedown, damage, win_round, round_num, test_times
    assert got == {0: (0, 7, 0, 50, 0, 2, 1), 1: (1, 0, 1, 700, 1, 2, 1)}


def test_main_metric_and_statuses(spark):
    cases = [("dcg-std", {"score": 0.5, "win_rate": 0.9}, (0.5, False)), ("Card", {"win_rate": 0.25}, (0.25, True)), ("os-std", {"overall": {"acc": 0.1}}, (0.1, False)), ("m2w", {"step_sr": 40}, (0.4, False)), ("unknown", {"main": 1}, (None, False)), ("webshop", {}, (None, False))]
    df = spark.createDataFrame([(i, t, json.dumps({"custom": c})) for i, (t, c, _) in enumerate(cases)], "i int, task string, result string")
    got = {r["i"]: (r["metric"], r["legacy"]) for r in df.select("i", *benchmarks.main_metric(F.col("task"), F.col("result"))).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    rows = spark.createDataFrame([("a", s) for s in ("COMPLETED", "UNKNOWN", "TASK_ERROR", None)], "agent string, status string")
    assert {r["ending"]: r["share"] for r in benchmarks.status_shares(rows, ["agent"]).collect()} == {"Completed": 0.25, "Task Limit Exceeded": 0.5, "Invalid Format": 0.0, "Invalid Action": 0.0, "Context Limit Exceeded": 0.0}


def test_prices(spark):
    texts = ["$1,234.50", "$5 to $7.25 and $9", "", None, "no price", "10 $3"]
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(*catalogue.parse_price(F.col("t"))).collect()]
    assert got == [([1234.5], "$1234.5"), ([5.0, 7.25], "$5.0 to $7.25"), ([100.0], "$100.0"), ([100.0], "$100.0"), ([100.0], "$100.0"), ([3.0], "$3.0")]


def test_percentiles_of_uneven_values(spark, monkeypatch):
    """Nearly all values in one of the first bins, then in one of its bins, and many equal ones."""
    import numpy as np

    from tidewheel.functions import ranking

    monkeypatch.setattr(ranking, "CLOSE", 20)
    rng = np.random.default_rng(3)
    groups = {"tail": np.concatenate([rng.random(900) * 1e-6, [1e9, -1e9]]), "same": np.full(300, 2.5), "two": np.array([1.0] * 200 + [2.0] * 200), "one": np.array([7.0]), "even": rng.random(500)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("even", None)]
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in ranking.exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", shares, bins=8).collect()}
    for k, values in groups.items():
        assert (got[k]["n"], got[k]["least"], got[k]["most"]) == (len(values), values.min(), values.max())
        for name, s in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(values, s), abs=1e-12), (k, name)


def test_weighted_draws(spark):
    """Draws against the running sums of each key, with heavy, weightless and far apart items."""
    import hashlib

    rng = random.Random(5)
    rows = [("a", i * 7001, rng.choice([0, 1, 1, 2, 5000])) for i in range(500)] + [("b", 1, 3), ("c", 1, 0), ("d", 5, 1), ("d", 6, 1)]
    got = {(r["k"], r["draw"]): r["item"] for r in catalogue.weighted_draws(spark.createDataFrame(rows, "k string, item long, w int"), ["k"], "item", "w", 60, 4).collect()}
    want = {}
    for k in "abd":
        own = [(i, w) for q, i, w in rows if q == k]
        for draw in range(1, 61):
            at = int(hashlib.md5(f"4|{k}|{draw}".encode()).hexdigest()[:8], 16) / 2**32 * sum(w for _, w in own)
            upto = 0
            for i, w in own:
                upto += w
                if at < upto:
                    want[k, draw] = i
                    break
    assert got == want


def test_sets_of_one_type(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in xs], "s string") for xs in (["C1", "C2"], ["C2", "C3"], ["N1"]))
    kind = lambda s: F.substring(s, 1, 1)
    assert [r["s"] for r in graph.one_type(a.intersect(b), a, b, kind=kind).collect()] == ["C2"]
    with pytest.raises(Exception, match="more than one type"):
        graph.one_type(a.union(c), a, c, kind=kind).collect()
