import hashlib
import math
import random
from collections import Counter

import pytest
from fixtures import rows_of, sql

from tidewheel.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    cuts = [k * dim // parts for k in range(parts + 1)]
    ints = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    cut = [[v[a:b] for v in ints] for a, b in zip(cuts, cuts[1:])]
    books = [[list(m) for m in members[:entries]] for members in cut]

    def nearest(book, m):
        return min((sum((x - y) ** 2 for x, y in zip(m, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for book, members in zip(books, cut):
            at = [nearest(book, m)[1] for m in members]
            for k in range(len(book)):
                own = [m for m, a in zip(members, at) if a == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(book, m) for book, m in zip(books, parts_of)] for parts_of in zip(*cut)]
    errors, total = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, lab), e in zip(kept, errors):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors)), key=repr)


def vectors(n=300, dim=16, seed=4):
    import numpy as np

    rng = random.Random(seed)
    real = lambda x: float(np.float32(x))
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    same = [real(rng.gauss(0, 1)) for _ in range(dim)]
    rows = []
    for i in range(n):  # a third of all rows are copies of one vector
        v = same if i % 3 == 0 else [real(c + rng.gauss(0, 0.4)) for c in rng.choice(centres)]
        rows.append((i * 7 % 997, v, [None, 1, 2, 2][i % 4]))
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] + same[1:], 1), (2003, [float("nan")] + same[1:], 2), (2004, [float("inf")] + same[1:], 2), (2005, [0.0] * dim, None), (2006, same[:5], 3)]
    return rows + [rows[4], rows[4], (None, same, 1), (2007, [-x for x in same], 9)]


@pytest.mark.parametrize("owner_rows", [1 << 16, 20])
def test_matches_brute_force(spark, tmp_path, monkeypatch, owner_rows):
    monkeypatch.setattr(vector_codes, "OWNER_ROWS", owner_rows)
    rows = vectors()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op12_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidewheel_")]


def test_sql_agrees(spark, tmp_path):
    rows = [(i, v, lab) for i, (_, v, lab) in enumerate(vectors(seed=5)) if not v or len(v) == 16]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(vector_codes.op12_vector_codes(spark, str(tmp_path))) == sql(tmp_path, vector_codes.ORACLE, "embeddings")


def test_few_rows_odd_lengths_and_large_values(spark):
    rows = [(3, [1.0, 2.0, 3.0], 1), (1, [5.0, -1.0, 0.5], 1), (2, [1.0, 2.0, 3.0], None)]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=8)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, parts=3)
    rows = [(i, [float((i * k) % 11) for k in range(21)], 1) for i in range(40)]
    assert sorted(map(tuple, vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)
    rows = [(i, [1000.0 * ((i * k) % 7 - 3) for k in range(8)], 1) for i in range(60)]
    assert sorted(map(tuple, vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)
    huge = vector_codes.compress(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in huge) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]


def test_empty_table_and_other_columns(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    odd = spark.createDataFrame([("x", 1, [1.0] * 8, 2, "y", "z")], "code string, vec_id long, embedding array<double>, label int, owner string, _of string")
    assert [tuple(r) for r in vector_codes.compress(odd).collect()] == brute([(1, [1.0] * 8, 2)])


def test_only_movers_are_shuffled(spark, monkeypatch):
    """A round's plan reads the residents in their buckets; its one exchange has the parts that move."""
    plans, house = [], vector_codes._house
    monkeypatch.setattr(vector_codes, "_house", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), house(df))[1])
    vector_codes.compress(spark.createDataFrame(vectors(), SCHEMA)).count()
    assert len(plans) > 2
    for plan in plans[1:]:
        assert plan.count("Exchange hashpartitioning(owner") == 1 and "Bucketed: true" in plan
