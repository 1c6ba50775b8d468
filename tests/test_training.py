"""Sequences, advantages, packing, clip ranges, purchases and recipes against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import catalogue, datasets, graph, packing, scoring, tokens


def merged(turns):
    out = []
    for ids, gen, lp, v in turns:
        for s in out:
            n = len(s[0])
            if len(ids) >= n and ids[:n] == s[0]:
                gap = len(ids) - n
                s[:] = [ids + gen, s[1] + [0] * gap + [1] * len(gen), s[2] + [0.0] * gap + lp, s[3] + [-1] * gap + v]
                break
        else:
            out.append([ids + gen, [0] * len(ids) + [1] * len(gen), [0.0] * len(ids) + lp, [-1] * len(ids) + v])
    return out


def test_merge_prefix_turns(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(30):
        seen, turns = [[]], []
        for k in range(rng.randrange(1, 7)):
            ids = list(rng.choice(seen)) + [rng.randrange(3) for _ in range(rng.randrange(0, 3))]
            gen = [rng.randrange(3) for _ in range(rng.randrange(0, 3))]
            turns.append((ids, gen, [-0.5 * g for g in gen], [k] * len(gen)))
            seen.append(ids + gen)
            rows.append((t, k, *turns[-1]))
        want[t] = merged(turns)
    df = spark.createDataFrame(rows, "traj int, turn int, input_ids array<int>, output_ids array<int>, logprobs array<double>, versions array<int>").repartition(3)
    got = {r["traj"]: [[list(x) for x in (s["input_ids"], s["loss_mask"], s["logprobs"], s["versions"])] for s in r["sequences"]] for r in tokens.merge_prefix_turns(df, ["traj"], "turn").collect()}
    assert got == want


def test_advantages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(20):
        n = rng.randrange(1, 9)
        rows.append((i, [rng.randrange(2) for _ in range(n)], [-rng.random() for _ in range(n)], [-rng.random() for _ in range(n)], [rng.random() for _ in range(n)], rng.random()))
    rows.append((99, [], [], [], [], 1.0))
    df = spark.createDataFrame(rows, "i int, loss_mask array<int>, logprobs array<double>, ref_logprobs array<double>, values array<double>, reward double")
    got = {r["i"]: r for r in tokens.advantages(df, gamma=0.9, lam=0.8, kl_weight=0.3).collect()}
    for i, mask, lp, ref, values, reward in rows:
        n = len(mask)
        mask, lp, ref = (x[1:] + [0] if x else x for x in (mask, lp, ref))
        kl = [-0.3 * (a - b) * m for a, b, m in zip(lp, ref, mask, strict=True)]
        tot = kl[:-1] + [0.0] if n else []
        if n:
            tot[max(n - 2, 0)] += reward
        adv, run, after = [0.0] * n, 0.0, 0.0
        for t in reversed(range(n)):
            if mask[t]:
                run = tot[t] + 0.9 * after - values[t] + 0.9 * 0.8 * run
                after, adv[t] = values[t], run
        r = got[i]
        assert (r["kl_rewards"], r["tot_rewards"], r["advantages"]) == (pytest.approx(kl), pytest.approx(tot), pytest.approx(adv))
        assert r["returns"] == pytest.approx([a + v for a, v in zip(adv, values, strict=True)])


def clip(gaps, threshold):
    m2 = sorted((g * g for g in gaps), reverse=True)
    if not m2 or sum(m2) / len(m2) <= threshold:
        return 0.95, 20.0
    at = next((k for k in range(len(m2)) if sum(m2[k:]) / len(m2[k:]) < threshold), len(m2) - 1)
    tau = math.sqrt(m2[at])
    return min(1 - math.exp(-tau), 0.95), min(math.exp(tau) - 1, 20.0)


def test_clip_range(spark):
    rng = random.Random(4)
    batches = {0: [], 1: [0.1, 0.1], 2: [5.0, 6.0], 3: [0.1, 0.3, 0.3, 0.3, 2.0], 4: [0.19, 0.19, 9.0, 0.21]}
    batches |= {k: [rng.choice([0.05, 0.1, 0.2, 0.3, 1.5, 4.0]) for _ in range(rng.randrange(1, 30))] for k in range(5, 60)}
    rows = [(b, g, True) for b, own in batches.items() for g in own] + [(b, 3.0, False) for b in batches]
    got = {r["batch"]: (r["low"], r["high"]) for r in tokens.clip_range(spark.createDataFrame(rows, "batch int, gap double, used boolean").repartition(4), "batch", "gap", F.col("used"), threshold=0.04).collect()}
    assert {b: pytest.approx(clip(g, 0.04)) for b, g in batches.items()} == got


def first_fit(lengths, capacity, least, divisor):
    """The rule said plainly: longest first; an empty group while there are too few, else the fitting one of fewest items and then least sum."""
    while True:
        groups = []
        for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
            fit = [g for g in groups if sum(lengths[k] for k in g) + lengths[i] <= capacity]
            if len(groups) < least or not fit:
                groups.append([i])
            else:
                min(fit, key=lambda g: (len(g), sum(lengths[k] for k in g), groups.index(g))).append(i)
        if len(groups) % divisor == 0 or len(lengths) < least:
            return groups
        least += divisor - least % divisor


def test_packing_assigns_exactly(spark):
    rng = random.Random(5)
    rows = [(b, k, rng.randrange(1, 60)) for b in range(12) for k in range(rng.randrange(8, 60))]
    df = spark.createDataFrame(rows, "batch int, k int, n int").repartition(4)
    own = {b: [n for x, _, n in rows if x == b] for b in range(12)}
    got = {b: {} for b in own}
    for r in packing.pack_token_budget(df, "batch", "k", "n", capacity=64, min_groups=3, divisor=4).collect():
        got[r["batch"]].setdefault(r["pack"], []).append(r["k"])
    for b, lengths in own.items():
        assert sorted(sorted(g) for g in got[b].values()) == sorted(sorted(g) for g in first_fit(lengths, 64, 4, 4))
        assert len(got[b]) % 4 == 0 and all(sum(lengths[i] for i in g) <= 64 for g in got[b].values())
    bins = packing.balance_batches(df, "batch", "k", "n", 4).collect()
    for b, lengths in own.items():
        load, count, want = [0] * 4, [0] * 4, {}
        for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
            at = min((x for x in range(4) if count[x] < -(-len(lengths) // 4)), key=lambda x: (load[x], x))
            want[i], load[at], count[at] = at, load[at] + lengths[i], count[at] + 1
        assert {r["k"]: r["bin"] for r in bins if r["batch"] == b} == want
    cut = {}
    for r in packing.contiguous_partition(df, "batch", "k", "n", 3).orderBy("k").collect():
        cut.setdefault(r["batch"], []).append((r["part"], r["n"]))
    for b, found in cut.items():
        x = own[b]
        spread = lambda *parts: max(map(sum, parts)) - min(map(sum, parts))
        assert [n for _, n in found] == x and [p for p, _ in found] == sorted(p for p, _ in found)
        assert spread(*[[n for p, n in found if p == k] for k in range(3)]) == min(spread(x[:i], x[i:j], x[j:]) for i in range(1, len(x)) for j in range(i + 1, len(x)))
    dealt = packing.redistribute_ranks(df.where("batch < 3"), "batch", "k", "n", granularity=2, ranks=3).collect()
    for b in range(3):
        x = own[b]
        sums = [sum(x[i : i + 2]) for i in range(0, len(x), 2)]
        want = {i: g for g, members in enumerate(first_fit(sums, 1 << 62, 3, 1)) for i in members}
        assert {(r["segment"], r["rank"]) for r in dealt if r["batch"] == b} == set(want.items())


def test_purchases(spark):
    same = [("a › b › c", "a › b › c", True), ("a › a › b", "a › b › c", True), ("a › a › d", "a › b › c", False), ("x", "a › b", False)]
    df = spark.createDataFrame(same, "own string, goal string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", catalogue.category_match(F.col("own"), F.col("goal"))).collect())
    assert catalogue.token_set_ratio("blue cotton shirt", "shirt blue") == 100.0 and catalogue.token_set_ratio("abc", "xyz") == 0.0
    rows = [
        ("q", "a › b", ["shirt"], ["tag 0", "tag 1"], ["Title with Tag 2"], ["red"], 5.0, "q", "a › b", ["Shirt"], ["tag 1", "tag 2", "tag 9"], ["red"], 9.0),
        ("q", "x", ["hat"], [], [""], [], 5.0, "p", "y", ["shirt"], ["z"], [], 9.0),
        ("q", "x", [], [], [""], [], 5.0, "p", "y", [], ["z"], [], 0.0),
    ]
    names = "query string, categories string, nouns array<string>, attributes array<string>, texts array<string>, options array<string>, price double"
    goal = "goal_query string, goal_categories string, goal_nouns array<string>, goal_attributes array<string>, goal_options array<string>, goal_price double"
    got = [(r["r_type"], r["attributes_met"], r["options_met"], r["reward"]) for r in catalogue.purchase_reward(spark.createDataFrame(rows, f"{names}, {goal}")).collect()]
    assert got == [(1.0, 2, 1, pytest.approx(0.8)), (0.0, 0, 0, 0.0), (0.5, 0, 0, None)]


def test_recipes_with_cycles_and_stock(spark):
    targets = spark.createDataFrame([("t1", "table", 5), ("t2", "loop", 1), ("t3", "stick", 4), ("t4", "log", 3)], "target string, item string, count int")
    recipes = spark.createDataFrame([("table", 1), ("plank", 4), ("stick", 4), ("loop", 1), ("pool", 1)], "item string, makes int")
    uses = spark.createDataFrame([("table", "plank", 4), ("plank", "log", 1), ("stick", "plank", 2), ("loop", "pool", 1), ("pool", "loop", 1), ("pool", "gem", 2)], "item string, part string, uses int")
    stock = spark.createDataFrame([("plank", 3), ("stick", 9)], "item string, have int")
    got = {(r["target"], r["item"], r["needed"]) for r in graph.base_materials(targets, recipes, uses, stock).collect()}
    assert got == {("t1", "log", 5), ("t2", "gem", 2), ("t4", "log", 3)}
    chain = sorted((r["item"], r["depth"]) for r in graph.recipe_chain(targets.where("target <> 't4'"), uses).where("target IN ('t1', 't2')").collect())
    assert chain == [("loop", 0), ("plank", 1), ("pool", 1), ("table", 0)]


def test_best_over_golds_in_blocks(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    docs = [(i, text(rng.randrange(0, 12))) for i in range(40)] + [(99, None)]
    golds = [(text(rng.randrange(1, 6)),) for _ in range(30)]
    got = {r["i"]: r["best"] for r in scoring.best_over_golds(spark.createDataFrame(docs, "i int, text string"), spark.createDataFrame(golds, "gold string"), block=7).collect()}
    f1 = lambda p, g: 2 * len(p & g) / (len(p) + len(g)) if p & g else 0.0
    assert got == {i: pytest.approx(max(f1(set((t or "").split()), set(g.split())) for (g,) in golds)) for i, t in docs}


def test_cjk_and_positions(spark):
    df = spark.createDataFrame([("答案 是 12", "答案12"), ("The answer", "answer"), ("x 3", "三 3"), ("", "答")], "p string, g string")
    got = [r["f"] for r in df.select(scoring.token_f1_cjk(F.col("p"), F.col("g")).alias("f")).collect()]
    assert got == [pytest.approx(6 / 7), pytest.approx(2 / 3), pytest.approx(0.5), 0.0]
    rows = spark.createDataFrame([(k * 3 % 101,) for k in range(101)] + [(None,)], "k int").repartition(5)
    assert {(r["k"], r["at"]) for r in datasets.numbered(rows, "k", "at", 7).collect()} == {(None, 0)} | {(k, k + 1) for k in range(101)}
    assert datasets.numbered(rows.limit(0), "k", "at").count() == 0


def test_percentiles_and_places_in_buckets(spark):
    import numpy as np

    from tidewheel.functions.ranking import exact_percentiles, greatest_before, place_within
    from tidewheel.operators import curation

    rng = random.Random(8)
    rows = [(k, rng.choice([1.0, 2.0, 2.0, rng.random() * 100, -5.0])) for k in range(4) for _ in range(rng.randrange(1, 200))] + [(9, 3.0), (1, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    shares = {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    for r in exact_percentiles(df, ["k"], "v", shares, bins=7).collect():
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert [r[c] for c in shares] == [pytest.approx(np.quantile(own, s)) for s in shares.values()] and (r["n"], r["least"]) == (len(own), min(own))
    assert exact_percentiles(df.limit(0), [], "v", shares).where("n > 0").count() == 0
    events = spark.createDataFrame([(i % 2, float(i), (i * 37) % 100) for i in range(300)], "g int, t double, e int").repartition(4)
    for r in greatest_before(events, ["g"], F.floor(F.col("t") / 16), [F.col("t")], "e", "top").collect():
        before = [(i * 37) % 100 for i in range(int(r["t"])) if i % 2 == r["g"]]
        assert r["top"] == (max(before) if before else None)
    placed = place_within(events, ["g"], F.floor(F.col("t") / 16), [F.col("t")], "at", "all").collect()
    assert all((r["at"], r["all"]) == (int(r["t"]) // 2, 150) for r in placed)
    said = spark.createDataFrame([(i, i in (3, 20)) for i in range(30)], "prompt_id int, submit boolean").repartition(3)
    assert sorted(r["prompt_id"] for r in curation.force_after(said, "prompt_id", 4).where("submit").collect()) == [3, 8, 13, 18, 20, 25]


def test_ngrams_and_fingerprint(spark):
    df = spark.createDataFrame([("The Red-Lamp of 100 x 1000 watts",)], "t string")
    assert df.select(catalogue.ngrams(F.col("t"), F.array(F.lit("the"), F.lit("of"))).alias("n")).first()["n"] == ["red", "lamp", "1000", "watts", "red lamp", "lamp 1000", "1000 watts"]
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("b"))
    prints = [catalogue.fingerprint(x, [F.col("id").cast("string"), F.col("b").cast("string")]).collect() for x in (rows, rows.orderBy(F.desc("id")).repartition(9))]
    assert prints[0] == prints[1] and prints[0][0]["rows"] == 500
    assert catalogue.fingerprint(rows.where("id < 499"), [F.col("id").cast("string")]).first()["fingerprint"] != prints[0][0]["fingerprint"]


@pytest.mark.parametrize(
    "policy,rows,want",
    [
        ("fifo", [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)], [0, 1, 2, 3, 4]),
        ("edf", [(0, 7), (1, 3), (2, 5)], [1, 2, 0]),
        ("edf", [(0, 2), (1, 2), (2, 2), (3, 2)], [0, 1, 2, 3]),
        ("edf", [(0, 0), (1, None)], [1, 0]),
    ],
)
def test_batches_keep_their_order(spark, policy, rows, want):
    from tidewheel.operators import selection

    df = spark.createDataFrame([(t, v, 8) for t, v in rows], "seq_no long, min_version int, seq_len int").repartition(3)
    got = selection.select_batch(df, len(rows), current=7, max_staleness=9, policy=policy).collect()
    assert [r["seq_no"] for r in sorted(got, key=lambda r: r["ordinal"])] == want and sorted(r["ordinal"] for r in got) == list(range(len(rows)))


def test_controller_waits_for_its_warm_up(spark):
    from tidewheel.operators import curation

    df = spark.createDataFrame([("a", v, 1.0, 1, 1, "easy") for v in range(4)], "prompt_id string, version int, g_mean double, zero_adv int, n_trajs int, kind string")
    got = [(r["version"], round(r["p_easy"], 6)) for r in curation.controller(df, warm_up=3).collect()]
    assert got == [(0, 0.5), (1, 0.5), (2, 0.49), (3, 0.48)]


def test_histogram_widths(spark):
    from tidewheel.operators import traces

    bins = lambda values: {r["bin"]: r["n"] for r in traces.histogram(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").collect()}
    assert bins([5, 5, 5, 5]) == {0: 4} and bins([7]) == {0: 1}
    assert bins([0] * 9 + [40]) == {0: 9, 40: 1}  # equal quartiles: 40 parts
    assert max(bins([i / 1000 for i in range(1000)] + [10_000])) == 120  # a 120th of the span at least
