import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidewheel.llm import quality


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    first = re.findall("[^\x20\x09-\x0d]+", low)
    second = re.findall("[a-z0-9\u0080-\U0010ffff]+", low)
    again = sum(a == b for a, b in zip(second, second[1:], strict=False))
    pairs = {("b", a, b) for a, b in zip(first, first[1:], strict=False)}
    return {("w", w) for w in first} | pairs | {("p", w) for w in second} | {("r", k) for k in range(1, 5) if again > 1 and again << k > len(second)}


def shrunk(raw, target, share):
    """log(target share / raw share) times the probability that the shares differ, by the beta function."""

    def log_beta(a, b):
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    other = log_beta(target + share, raw - target + 1 - share) - log_beta(share, 1 - share)
    same = target * math.log(share) + (raw - target) * math.log(1 - share)
    sure = 1 / (1 + (1 - quality.TELLING) / quality.TELLING * math.exp(min(500, max(-500, same - other))))
    return round(sure * math.log((target + share) / ((raw + 1) * share)) * quality.STEPS) / quality.STEPS


def brute(docs, labels, k=None, seed=29, temperature=quality.TEMPERATURE):
    """Kept (id, weight): a model for each fold of the labels of the others, the threshold between two held-out texts, noise by id, and the k greatest keys."""
    good = {}
    for i, q, t in labels:
        if i is not None and q is not None and t is not None:
            good[i] = min(good.get(i, 1), int(q == 1 and t == 0))
    rows = [(i, t, zlib.crc32((t or "").encode()) % quality.FOLDS, features(t)) for i, t in docs]
    learned = [r for r in rows if r[0] in good and r[1] is not None]
    ratios = []
    for f in range(quality.FOLDS):
        raw, target = Counter(), Counter()
        for i, _, fold, own in learned:
            if fold != f:
                raw.update(own)
                target.update(own if good[i] else ())
        share = sum(target.values()) / max(1, sum(raw.values()))
        ratios.append({x: shrunk(n, target[x], share) for x, n in raw.items()} if 0 < share < 1 else {})
    unseen = []
    for f in range(quality.FOLDS):  # what no labelled row of the other folds has
        total = Counter()
        for i, _, fold, own in learned:
            if fold != f:
                total.update({True: len(own) * good[i], False: len(own)})
        share = total[True] / max(1, total[False])
        unseen.append(shrunk(0, 0, share) if 0 < share < 1 else 0.0)
    means = [sum(ratios[f].get(x, unseen[f]) for x in own) / max(1, len(own)) for _, _, f, own in rows]
    held = [(m, r[0], len(r[3])) for m, r in zip(means, rows, strict=True) if r[0] in good and r[3]]
    scale = sum(n for _, _, n in held) / len(held) if held else 1.0
    scored = []
    for m, (i, text, _, _) in zip(means, rows, strict=True):
        u = (int(hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        scored.append((m * scale - temperature * math.log(-math.log(u)), hashlib.md5((text or "").encode()).hexdigest(), i, m * scale))
    if k is None:
        least = {}
        for m, i, _ in held:
            least[i] = min(least.get(i, m), m)
        seen = sorted(((m * scale, good[i]) for i, m in least.items()), reverse=True)
        n_good = sum(g for _, g in seen)
        edge = -math.inf
        if 0 < n_good < len(seen):
            best, up, down = -math.inf, 0, 0
            for j, (w, g) in enumerate(seen):
                up, down = up + g, down + 1 - g
                if j + 1 < len(seen) and seen[j + 1][0] == w:
                    continue
                gain = up / n_good - down / (len(seen) - n_good)
                if gain > best + 1e-12:
                    best, edge = gain, w if j + 1 == len(seen) else (w + seen[j + 1][0]) / 2
        k = sum(w >= edge for _, _, _, w in scored)
    return [(i, w) for _, _, i, w in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def corpus():
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(700):
        text = [f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Idiot,", "trash!!", "idiot"])
        if i % 7 == 0:
            text = [w for w in text for _ in range(4)]
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(i % 7 != 0), int(bad)))
    return docs + [(1000, None), (1001, ""), (None, "no id at all")], labels


def same(got, want):
    """Kept ids, and their weights but for rounding and the few features that share a bucket."""
    key = lambda i: -1 if i is None else i
    got, want = sorted((key(i), w) for i, w in got), sorted((key(i), w) for i, w in want)
    assert [i for i, _ in got] == [i for i, _ in want]
    off = [abs(x - y) for (_, x), (_, y) in zip(got, want, strict=True)]
    assert sum(x <= 1e-3 for x in off) >= 0.9 * len(off) and max(off) < 0.5, (sum(x > 1e-3 for x in off), len(off), max(off))


def test_matches_brute_force(spark, tmp_path):
    """The registered query, over null, empty, repeated and very long texts, null ids, and labels that are null or repeat."""
    docs, labels = corpus()
    docs = docs + [docs[3], docs[3], (1002, " ".join(f"w{k % 900}" for k in range(60_000))), (1003, None), (None, None)]
    labels = labels + [(3, None, None), (4, 1, None), (7, 1, 0), (7, 0, 0), (None, 1, 0), (9999, 1, 0), (1002, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r["doc_id"], r["log_weight"]) for r in quality.op9_quality_resample(spark, str(tmp_path)).collect()]
    same(got, brute(docs, labels))
    kept = {i for i, _ in got}
    bad = [i for i, t in docs if t and re.search("idiot|trash", t, re.I)]
    clean = [i for i, t in docs if i is not None and i < 1000 and i not in bad and i % 7]
    assert sum(i in kept for i in bad) < 0.2 * len(bad) and sum(i in kept for i in clean) > 0.9 * len(clean)


def test_other_columns_and_fixed_k(spark):
    docs, labels = corpus()
    a = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in docs], "doc_id long, text string, log_weight string, fold int, _md5 int")
    out = quality.classify(a, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=200, temperature=1.0)
    assert set(out.columns) == {"doc_id", "text", "log_weight", "fold", "_md5"}
    rows = out.collect()
    same([(r["doc_id"], r["log_weight"]) for r in rows], brute(docs, labels, k=200, temperature=1.0))
    assert {(r["fold"], r["_md5"]) for r in rows} == {(5, 6)}


def test_no_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).count() == 50
    assert quality.classify(docs, none, k=7).count() == 7
    assert quality.classify(docs.limit(0), none).count() == 0
    good = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r["log_weight"] for r in quality.classify(docs, good).collect()} == {0.0}


def test_label_bound(spark):
    docs, labels = corpus()
    a = spark.createDataFrame(docs, "doc_id long, text string")
    most = sorted({i for i, _, _ in labels}, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:100]
    got = quality.classify(a, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_labels=100).collect()
    same([(r["doc_id"], r["log_weight"]) for r in got], brute(docs, [x for x in labels if x[0] in most]))


def test_rare_words_and_pairs_count(spark):
    """Ten labelled rows of a bad word, and of a bad pair of common words, are enough; weights may be positive."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        text = [f"w{rng.randrange(400)}" for _ in range(40)]
        kind = i % 60 if i % 60 < 2 else 2
        if kind == 0:
            text[7] = "vile"
        text[20:22] = ["red", "hot"] if kind == 1 else ["red", "w7"]
        text += ["w9", "hot"] if i % 4 < 2 else []
        docs.append((i, " ".join(text)))
        if i % 2 == 0 or kind == 1:
            labels.append((i, 1, int(kind < 2)))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["log_weight"] for r in quality.classify(a, b, temperature=0.0).collect()}
    assert not any(i in kept for i in range(0, 600, 60)) and not any(i in kept for i in range(1, 600, 60))
    assert len(kept) > 0.97 * 580 and max(kept.values()) > 0


def test_shrunk_ratios():
    import numpy as np

    raw = np.array([1, 5, 5, 10, 1000, 8])
    target = np.array([0, 0, 4, 0, 0, 6])
    got = quality.shrunk_ratios(raw, target, 0.75)
    for r, t, x in zip(raw, target, got, strict=True):
        beta = lambda a, b: math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        odds = quality.TELLING / (1 - quality.TELLING) * beta(t + 0.75, r - t + 0.25) / beta(0.75, 0.25) / (0.75**t * 0.25 ** (r - t)) if r < 1000 else math.inf
        assert math.isclose(x, (1 if odds == math.inf else odds / (1 + odds)) * math.log((t + 0.75) / ((r + 1) * 0.75)), rel_tol=1e-9)
    assert all(got[[0, 1, 3]] < 0) and quality.best_threshold(np.array([3.0, 2, 1, 0]), np.array([True, True, False, False])) == 1.5


def test_k_is_exact_with_repeated_rows(spark):
    rows = [(i, f"good words {i % 3}") for i in range(6)] + [(7, "again and again")] * 5 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for k in range(len(rows) + 2):
        assert quality.classify(docs, labels, k=k).count() == min(k, len(rows))
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 / 40000.0).alias("key"))
    got = sorted((r["key"], r["doc_id"]) for r in quality.top_k(scored, 777).collect())
    assert got == sorted(sorted(((i % 97 / 40000.0, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))[:777])
