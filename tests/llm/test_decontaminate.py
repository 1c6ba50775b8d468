import random

import pytest
from fixtures import documents, rows_of, sql

from tidewheel.llm import decontaminate as d

QUESTION = "What is the Capital, of the country where the river Seine meets the sea?"
EXTRA = [
    (400, f"before {QUESTION.upper()} after", "en", "s", 1),
    (401, "ünïcode — the capital of the country where the river seine meets the sea and more", "en", "s", 1),
    (402, "short answer: PARIS! paris", "en", "s", 1),
    (403, "what is the capital of the country where the", "en", "s", 1),
    (404, "a b c d e f g h i j k l m n", "en", "s", 1),
    (405, " ".join(["x"] * 40), "en", "s", 1),
]
ITEMS = [(1, QUESTION), (2, "Paris"), (10, "a b c d e f g h i j"), (9, "e f g h i j k l m n"), (3, None), (4, " ,;"), (5, "x x x x x x x x x x x"), (5, "x x x x x x x x x x x"), (6, "Paris")]


@pytest.mark.parametrize("shard", [1 << 18, 40])
def test_against_sql(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(d.decontaminate, "__kwdefaults__", d.decontaminate.__kwdefaults__ | {"shard_bytes": shard})
    documents(spark, tmp_path, EXTRA)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = d.op3_decontaminate(spark, str(tmp_path))
    # SQL joins by doc_id: ids that are repeated with one text, and null ids without hits, agree
    assert sorted(set(rows_of(got.where("doc_id IS NOT NULL"))), key=repr) == sorted({r for r in sql(tmp_path, d.ORACLE, "documents", "benchmark") if r[1] is not None}, key=repr)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[400]["n_hit"] == 14 and by[402]["n_items"] == 2 and by[403]["n_hit"] == 0 and by[405]["n_hit"] == 40
    assert by[404]["items_sha256"] == d.items_digest(["10", "9"])


def test_offsets_and_empty(spark):
    docs = spark.createDataFrame([(1, f'é "{QUESTION}" end', "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = d.decontaminate(docs, bench).first()
    span = row["spans"][0]
    assert row["items"] == ["1"] and f'é "{QUESTION}" end'[span["start"] : span["end"]] == QUESTION[:-1]
    assert d.decontaminate(docs, bench.limit(0)).first()["n_hit"] == 0
    assert d.decontaminate(docs.limit(0), bench).count() == 0


def test_null_item_id_hits_without_a_name(spark, tmp_path):
    spark.createDataFrame(EXTRA, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, QUESTION), (None, "Paris"), (6, "Paris")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = d.op3_decontaminate(spark, str(tmp_path)).where("n_hit > 0")
    assert rows_of(got) == [r for r in sql(tmp_path, d.ORACLE, "documents", "benchmark") if r[0]]
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in got.collect()} == {400: (14, 1, d.items_digest([])), 401: (12, 1, d.items_digest([])), 402: (2, 2, d.items_digest(["6"]))}


def test_index_of_megabytes_against_all_windows():
    """Against a set of all windows, over items that share phrases, in one automaton."""
    rng = random.Random(9)
    vocabulary = [f"w{rng.randrange(4000)}".encode() for _ in range(5000)]
    phrase = rng.choices(vocabulary, k=12)
    items = []
    for i in range(4000):
        words = rng.choices(vocabulary, k=rng.choice([1, 4, 9, 10, 11, 60, 300]))
        items.append((str(i), b" ".join(words[:5] + phrase * (i % 3 == 0) + words[5:]).decode()))
    index = d._Index(items)
    windows = {}
    for i, t in items:
        w = d.normalised(t)
        for k in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(w) for w in windows}
    for _ in range(60):
        source = d.normalised(rng.choice(items)[1])
        k = rng.randrange(len(source))
        words = rng.choices(vocabulary, k=rng.randrange(0, 40)) + source[k : k + rng.randrange(3, 40)] + rng.choices(vocabulary, k=9)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[i : i + n]))) and n == len(words[i : i + n]):
                    hit.update(range(i, i + n))
                    names |= found
        spans, got = index.scan(words)
        assert got == names and {p for a, b in spans for p in range(a, b)} == hit
