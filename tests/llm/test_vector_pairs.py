import numpy as np
import pytest
from fixtures import rows_of, sql

from tidewheel.llm import vector_pairs

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.95):
    good = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=1)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good]).reshape(-1, width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    top = list(range(len(good)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in np.argwhere(np.triu(near, 1)):
        top[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(good):
        least[find(k)] = min(least.get(find(k), i), i)
    out = [(i, int(near[k].sum()) - 1, least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(good)]
    taken = {id(v) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out += [(i, 0, i, True) for i, v, *_ in rows if i is None or id(v) not in taken]
    return sorted(out, key=repr)


def turned(rng, v, cosine):
    z = rng.normal(size=len(v))
    z -= z @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def vectors(seed=1, dim=24, far=0.93, close=0.999):
    """Single vectors, copies, tight and wide groups, chains, and pairs on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []

    def add(v):
        rows.append((len(rows) * 7 % 4999, [float(x) for x in v], len(rows) % 3))

    for _ in range(300):
        add(rng.normal(size=dim))
    for m, low in ((200, close), (60, 0.985), (60, 0.97), (30, far)):
        centre = rng.normal(size=dim)
        for _ in range(m):
            add(turned(rng, centre, rng.uniform(low, 1)) * rng.uniform(0.1, 9))
    same = rng.normal(size=dim)
    for _ in range(50):
        add(same)
    v = rng.normal(size=dim)
    for _ in range(12):
        add(v)
        v = turned(rng, v, 0.97)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, tmp_path, seed):
    rows = vectors(seed)
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1), (9003, [None] * 24, 1), (9004, [float("nan")] * 24, 1), (9005, rows[400][1][:23], 1), rows[310], rows[310], (None, rows[310][1], 1), (rows[0][0], rows[320][1], 2), (9006, [1e300 * x for x in rows[310][1]], 1), (9007, [1e-300 * x for x in rows[310][1]], 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_pairs.op13_near_vectors(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    scaled = [(i, v if i not in (9006, 9007) else rows[310][1], lab) for i, v, lab in rows]
    want = brute(scaled)
    got = sorted(map(tuple, got.collect()), key=repr)
    linked = sum(r[1] for r in want)
    assert len(got) == len(want) and 0.998 * linked <= sum(r[1] for r in got) <= linked
    assert sum(x == y for x, y in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_recall_at_the_threshold(spark):
    """Pairs a little above the threshold only, none of which has another way to meet."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        v = rng.normal(size=64)
        rows += [(2 * i, [float(x) for x in v], 0), (2 * i + 1, [float(x) for x in turned(rng, v, 0.9501)], 0)]
        if i % 3 == 0:
            rows.append((100_000 + i, [float(x) for x in turned(rng, v, 0.9499)], 0))
    got = {r["vec_id"]: r["n_links"] for r in vector_pairs.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * sum(want.values())


def test_dense_groups_are_not_compared_by_pairs(spark, monkeypatch):
    """A tight group twice as large makes about twice as many comparisons."""
    compared, measured = [], vector_pairs._measured
    monkeypatch.setattr(vector_pairs, "_measured", lambda pairs, dim: (compared.append(pairs.count()), measured(pairs, dim))[1])
    totals = []
    for m in (1000, 2000):
        rng = np.random.default_rng(3)
        centre = rng.normal(size=32)
        rows = [(i, [float(x) for x in turned(rng, centre, 0.9995)], 0) for i in range(m)] + [(5000 + i, [float(x) for x in rng.normal(size=32)], 0) for i in range(200)]
        compared.clear()
        got = vector_pairs.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
        assert all(r["n_links"] == m - 1 and r["component_id"] == 0 for r in got if r["vec_id"] < m)
        totals.append(sum(compared))
    assert totals[1] <= 2.5 * totals[0] and totals[1] < 20 * 2000


def test_sql_agrees(spark, tmp_path):
    rows = [(k, v, lab) for k, (_, v, lab) in enumerate(vectors(far=0.99)[:600])] + [(800, None, 1), (801, [0.0] * 24, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(vector_pairs.op13_near_vectors(spark, str(tmp_path))) == sql(tmp_path, vector_pairs.ORACLE, "embeddings")


def test_empty_and_other_columns(spark):
    assert vector_pairs.link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in vector_pairs.link_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()] == [(1, 0, 1, True)]
    odd = spark.createDataFrame([(1, [1.0, 2.0], "a", "b"), (2, [2.0, 4.0], "a", "b")], "vec_id long, embedding array<float>, id string, p1 string")
    assert sorted(map(tuple, vector_pairs.link_vectors(odd).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
