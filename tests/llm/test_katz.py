import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewheel.llm import katz


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</end>"]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    uni, pair, hist, follow = Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if not held[i]:
            for h, w in zip(["<start>", *tokens(t)], tokens(t), strict=False):
                uni[w] += 1
                pair[h, w] += 1
                hist[h] += 1
                follow[h].add(w)
    n, v = sum(uni.values()), len(uni)

    def kept(counter):
        of = Counter(counter.values())
        d = katz.discounts([float(of[r]) for r in range(1, katz.K + 2)])
        return lambda c: d[c - 1] * c if c <= katz.K else c - katz.DELTA

    k1, k2 = kept(uni), kept(pair)
    unknown = 1 - sum(k1(c) for c in uni.values()) / n
    p1 = lambda w: k1(uni[w]) / n if w in uni else unknown

    def alpha(h):
        if h not in hist:
            return 1.0
        return (1 - sum(k2(pair[h, w]) for w in follow[h]) / hist[h]) / (1 - sum(p1(w) for w in follow[h]))

    p2 = lambda h, w: k2(pair[h, w]) / hist[h] if (h, w) in pair else alpha(h) * p1(w)
    for h in list(hist)[:20]:
        assert math.isclose(sum(p2(h, w) for w in uni) + p2(h, "never seen"), 1, rel_tol=1e-9)
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        out.append((i, held[i], len(ws), sum(uni[w] > 0 for w in ws), n, base, sum(math.log10(p2(h, w)) for h, w in zip(["<start>", *ws], ws, strict=False))))
    return out


@pytest.mark.parametrize("bucket_tokens,block_bytes", [(1 << 20, 4 << 20), (300, 2000)])
def test_matches_brute_force(spark, tmp_path, monkeypatch, bucket_tokens, block_bytes):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket_tokens)
    monkeypatch.setattr(katz, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Été", "ÉTÉ", "x" * 200, "Mixed"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80)))) for i in range(160)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, rows[5][1]), (1003, rows[5][1]), (1004, "the " * 900), (1005, "un split word")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in katz.op7_katz_scores(spark, str(tmp_path)).collect())
    want = sorted(brute(rows))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_empty_table(spark):
    assert katz.score_corpus(spark.createDataFrame([], "doc_id long, text string, score string")).count() == 0
    row = katz.score_corpus(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert row["doc_id"] is None and row["n_tokens"] == 1


def brute_order(rows, held, order):
    """Probabilities by the recursive definition."""
    grams = [Counter() for _ in range(order)]
    for t in (t for i, t in rows if i not in held):
        ws = ["<start>"] * (order - 1) + tokens(t)
        for at in range(order - 1, len(ws)):
            for k in range(order):
                grams[k][tuple(ws[at - k : at]), ws[at]] += 1
    hist, follow, kept = [Counter() for _ in grams], [defaultdict(set) for _ in grams], []
    for k, g in enumerate(grams):
        of = Counter(g.values())
        kept.append(katz.discounts([float(of[r]) for r in range(1, katz.K + 2)]))
        for (h, w), c in g.items():
            hist[k][h] += c
            follow[k][h].add(w)

    def p(h, w):
        k = len(h)
        c = grams[k][h, w]
        if c:
            return (kept[k][c - 1] * c if c <= katz.K else c - katz.DELTA) / hist[k][h]
        if not k:
            return 1 - sum(p((), x) for x in follow[0][()])
        if h not in hist[k]:
            return p(h[1:], w)
        return (1 - sum(p(h, x) for x in follow[k][h])) / (1 - sum(p(h[1:], x) for x in follow[k][h])) * p(h[1:], w)

    for h in list(hist[-1])[:5]:
        assert math.isclose(sum(p(h, w) for w in follow[0][()]) + p(h, "never seen"), 1, rel_tol=1e-9)
    out = []
    for i, t in rows:
        ws = ["<start>"] * (order - 1) + tokens(t)
        out.append((i, sum(math.log10(p(tuple(ws[at - order + 1 : at]), ws[at])) for at in range(order - 1, len(ws)))))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_model_of_any_order(spark, order):
    from tidewheel.llm import katz_tables

    rng = random.Random(4)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(1.0))}" for _ in range(rng.randrange(0, 25)))) for i in range(40)] + [(50, None), (51, "the the the new"), (52, "a b a b a b a b")]
    held = {3, 9, 51}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = katz_tables.fit(docs.where(~docs.doc_id.isin(*held)), order)
    got = sorted((r["doc_id"], r["score"]) for r in katz_tables.score(model, docs).collect())
    for (i, a), (j, b) in zip(got, brute_order(rows, held, order), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-9)
    whole = katz.score_corpus(docs, held_out=docs.doc_id.isin(*held), order=order)
    if order != 2:
        assert sorted((r["doc_id"], round(r["score"], 6)) for r in whole.collect()) == [(i, round(s, 6)) for i, s in got]


def test_discounts_by_the_formula():
    """d = (r* / r - x) / (1 - x) with r* = (r + 1) n(r + 1) / n(r) and x = (K + 1) n(K + 1) / n(1), where that is between 0 and 1."""
    n = [5000.0, 1800.0, 900.0, 500.0, 320.0, 220.0]
    x = 6 * n[5] / n[0]
    want = [((r + 1) * n[r] / n[r - 1] / r - x) / (1 - x) for r in range(1, 6)]
    assert all(0 < d < 1 for d in want) and katz.discounts(n).tolist() == pytest.approx(want)
    # counts of counts that rise give no discount below 1: half an event goes
    assert katz.discounts([1.0, 9.0, 9.0, 9.0, 9.0, 9.0]).tolist() == pytest.approx([0.5, 0.75, 2.5 / 3, 0.875, 0.9])
    assert katz.discounts([0.0] * 6).tolist() == pytest.approx([0.5, 0.75, 2.5 / 3, 0.875, 0.9])
