"""The pipeline as a whole against plain Python (and SQL for the mix) on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
from fixtures import sql
from test_jaccard import brute as components
from test_quality import brute as resample
from test_quality import corpus as labelled

from tidewheel.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus():
    rng = random.Random(8)
    texts, labels = labelled()
    rows = []
    for i, t in texts:
        source = rng.choice(["src0", "src0", "src1", "src5", "web", None])
        rows.append((i, t if t is None or rng.random() < 0.5 else f"{t}\nall rights reserved by us", rng.choice(["en", "de", None]), source, 0))
    base = " ".join(f"u{k}" for k in range(60))
    rows += [(2000 + k, f"{base} extra{k}", "en", "src1", 0) for k in range(6)] + [(2100, base, "en", "src0", 0), (2100, base, "en", "src0", 0)]
    rows += [(3000, "x y z " + " ".join(f"q{k}" for k in range(12)), "en", "src0", 0)]
    return rows, labels, [(1, " ".join(f"q{k}" for k in range(12))), (2, "never found anywhere")]


def drop_lines(rows):
    pages, counts = Counter(r[3] for r in rows if r[3] is not None), Counter()
    for _, text, _, source, _ in rows:
        if source is not None and text is not None:
            counts.update({(source, line.strip(" ")) for line in text.split("\n")} - {(source, "")})
    bad = {k for k, n in counts.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    out = []
    for i, text, lang, source, _ in rows:
        if text is not None:
            text = "\n".join(line for line in text.split("\n") if line.strip(" ") == "" or (source, line.strip(" ")) not in bad)
        out.append((i, text, lang, source, None if text is None else len(text)))
    return out


def one_of_each(rows):
    named = [r for r in rows if r[0] is not None]
    own = {(d, n): c for d, n, c in components([(r[0], r[1]) for r in named])}

    def stays(r):
        ws = re.findall("[^\x20\x09-\x0d]+", (r[1] or "").lower())
        n = len({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}) if ws else 0
        return own[r[0], n] == r[0]

    return list(dict.fromkeys(r for r in named if stays(r))) + [r for r in rows if r[0] is None]


def clean(rows, items):
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    windows = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(max(1, len(words(t)) - 9))}
    return [r for r in rows if not any(tuple(words(r[1])[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words(r[1])) - n + 1))]


def test_stages_and_run(spark, tmp_path):
    rows, labels, items = small_corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: repr(tuple(r))
    ids = Counter(i for i, _ in resample([(r[0], r[1]) for r in rows], labels))
    want = []
    for r in rows:
        if ids[r[0]]:
            ids[r[0]] -= 1
            want.append(r)
    steps = [want]
    for step in (drop_lines, one_of_each, lambda x: clean(x, items)):
        steps.append(step(steps[-1]))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, expected in enumerate(steps):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}.parquet")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(expected, key=key)
    assert len(steps[0]) < len(rows) and len(steps[2]) < len(steps[1]) and len(steps[3]) == len(steps[2]) - 1
    final = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted((tuple(r[n] for n in ("copies", "doc_id", "domain", "lang", "n_tokens", "source")) for r in final.collect()), key=repr)
    assert got == sql(tmp_path, mixing.oracle("stage3"), "stage3")


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
