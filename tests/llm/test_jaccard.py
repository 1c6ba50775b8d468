import random
import re

import pytest

from tidewheel.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    passage = text(30)
    rows = []

    def add(words):
        rows.append((len(rows) * 3 % 1009, " ".join(words)))

    for _ in range(40):
        add(text(rng.randrange(0, 90)))
    for _ in range(30):  # unlike texts that share a passage
        add(text(rng.randrange(1, 40)) + passage + text(rng.randrange(1, 40)))
    for _ in range(8):  # groups of copies with more and fewer edits, chains among them
        base = text(rng.randrange(20, 120))
        for _ in range(rng.randrange(2, 25)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            add(copy)
    parts = [text(12) for _ in range(6)]
    for _ in range(40):  # texts made of frequent parts only
        add(sum(rng.sample(parts, rng.randrange(2, 6)), []))
    for _ in range(6):
        add(["same", "few", "words"])
    return rows


@pytest.mark.parametrize("seed,leaders_only", [(1, False), (2, True)])
def test_matches_brute_force(spark, tmp_path, monkeypatch, seed, leaders_only):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 500)
    if leaders_only:
        monkeypatch.setattr(jaccard, "LEAST_PAIRS", 0)
        monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", 0)
    rows = corpus(seed) + [(5000, None), (5001, ""), (5002, "One"), (5003, "one"), (5003, "one"), (5004, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in jaccard.op10_jaccard_components(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component string")
    assert jaccard.near_duplicates(empty).count() == 0
    rows = jaccard.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, None)], "doc_id long, text string")).collect()
    assert sorted((r[0] or 0, r[1], r[2] or 0) for r in rows) == [(0, 2, 0), (4, 0, 4), (4, 2, 4)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(70, 30)]
    got = {r[0]: r[1] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 61), 70]} | {100 + i: 100 for i in range(40)}


def test_pairs_of_frequent_passages_grow_in_proportion(spark, monkeypatch):
    """Every index list is long and almost nothing links: few pairs are compared, not those of whole lists."""
    compared, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, sets: (compared.append(pairs.count()), verify(pairs, sets))[1])
    totals = []
    for n in (1000, 2000, 4000):
        rng = random.Random(5)
        parts = [[f"p{k}w{j}" for j in range(8)] for k in range(14)]
        rows = [(i, " ".join(sum(rng.sample(parts, 7), []))) for i in range(n)]
        compared.clear()
        jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        totals.append(sum(compared))
    assert totals[1] <= 2.2 * totals[0] and totals[2] <= 2.2 * totals[1] and totals[2] <= 4000


@pytest.mark.parametrize("shared_twice", [False, True])
def test_texts_of_one_passage_do_not_meet(spark, monkeypatch, shared_twice):
    """Texts of a common passage and own words, of which nothing links: rows of the join itself, before its filters, grow with the texts."""
    met, meet = [], jaccard._meet
    monkeypatch.setattr(jaccard, "_meet", lambda seen: [m for m in meet(seen) if met.append(m.count()) is None])
    totals = []
    for n in (500, 2000):
        rng = random.Random(2)
        passage = [f"p{k}" for k in range(172)]
        rows = []
        for i in range(n):
            own = [f"o{i}x{k}" for k in range(28)]
            rows.append((i, " ".join(passage + own)))
            if shared_twice and i % 2 == 0:  # its own words are another text's, too
                rows.append((10_000 + i, " ".join(own + [f"q{rng.randrange(10**9)}" for _ in range(172)])))
        met.clear()
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == len(rows)
        totals.append(sum(met))
    assert totals[1] <= 4 * totals[0] + 100


def test_sets_out_of_reach_do_not_meet(spark):
    """Sets of one size and list, of which half have shingles of their own and so reach smaller sets only, meet none but those."""
    main = [(1, i, 146, 0, 146, 0, 0) for i in range(60)]
    outer = [(1, 100 + i, 146, 0, 134, 100 + i, 0) for i in range(50)]
    small = [(1, 200, 118, 0, 146, 0, 0)]
    seen = spark.createDataFrame(main + outer + small, "key long, id long, n long, at int, reach long, c long, main long")
    met = [r for m in jaccard._meet(seen) for r in m.selectExpr("x.id AS x", "y.id AS y").collect()]
    assert sorted((r["x"], r["y"]) for r in met) == [(100 + i, 200) for i in range(50)]


def test_draws_make_no_rows_for_bands(spark, monkeypatch):
    """Lists of which most sets are drawn: only sets outside a main component are ever dealt to several bands."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", 0)
    dealt, to_meet = [], jaccard._to_meet
    monkeypatch.setattr(jaccard, "_to_meet", lambda seen: (dealt.append((seen.where("c = main").count(), to_meet(seen).count())), to_meet(seen))[1])
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    bases = [text(60) for _ in range(6)]
    for base, other in zip(bases, bases[1:] + bases[:1], strict=True):  # copies that link, and two texts of parts of two groups
        rows += [(len(rows) + k, " ".join([*base[:30], f"x{rng.randrange(10**6)}", *base[30:]])) for k in range(20)]
        rows += [(len(rows) + k, " ".join([*base[: 28 - k], *other[30 - k :]])) for k in range(2)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert not any(main for main, _ in dealt) and sum(made for _, made in dealt) <= 8 * 12 * 20


def test_drawn_sets_are_asked_once_for_a_main_component(spark):
    """Of 200 sets in 5 lists of one main component, those outside it meet drawn sets in one list each."""
    rows = [(key, i, 100, 0, 125, 0 if i < 150 else i, 0, 200, 100, None, None, None) for key in range(5) for i in range(200)]
    seen = spark.createDataFrame(rows, "key long, id long, n long, at int, reach long, c long, main long, m long, common long, sketch array<long>, pivot long, with_pivot long")
    met = jaccard._meet_drawn(seen, 16).selectExpr("x.id AS x", "y.id AS y").collect()
    drawn = {r["x"] for r in met}
    assert 4 <= len(drawn) <= 40 and {r["y"] for r in met} == set(range(150, 200)) and len(met) == 50 * len(drawn)


def test_very_long_text(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:30_000], "x", *long[30_000:]])), (3, " ".join(long[:40_000])), (4, " ".join(long[:9])), (5, " ".join(long[:9]).upper())]
    assert sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)
