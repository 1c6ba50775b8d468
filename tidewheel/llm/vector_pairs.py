"""Near-duplicate vectors by cosine: cross-polytope hashing with multiprobe buckets, and exact checks of what meets."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.jaccard import components
from tidewheel.llm.tables import discard, durable
from tidewheel.llm.vector_codes import usable

THRESHOLD = 0.95
#: Of pairs exactly at the threshold, tables are added until so few are expected to be missed; closer pairs are missed less.
MISS = 1e-3
#: Unlike vectors that a bucket has on average, at most; decides how many hashes name a bucket.
BUCKET_ROWS = 8
#: Coordinates of a rotation that may stand in for the largest one.
CHOICES = 4
#: Bits of a sketch, and the standard deviations that a linked pair's differing bits may lie above their mean.
SKETCH, DEVIATIONS = 128, 6.0
#: Angles are told apart with this margin; closer calls are decided by the cosine itself.
MARGIN = 1e-7
SEED = 20250301


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform: nearly a random rotation, in ``n log n`` steps."""
    n, width = x.shape
    for s in signs:
        x = x * s
        step = 1
        while step < width:
            halves = x.reshape(n, width // (2 * step), 2, step)
            x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
            step *= 2
    return x


class Hashes:
    """``tables`` of buckets that ``k`` cross-polytope hashes name, with the ``probes`` next best buckets, and sign sketches."""

    def __init__(self, dim: int, k: int, tables: int, probes: int):
        self.width = max(16, 1 << (dim - 1).bit_length())
        self.k, self.tables = k, tables
        rng = np.random.default_rng(SEED)
        self.sketch_signs = rng.choice([-1.0, 1.0], size=(-(-SKETCH // self.width), 3, self.width))
        self.signs = rng.choice([-1.0, 1.0], size=(tables, k, 3, self.width))
        self.combos = np.array(list(itertools.product(range(CHOICES), repeat=k)))
        self.buckets = 1 + min(probes, len(self.combos) - 1)

    def padded(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        return np.pad(unit, ((0, 0), (0, self.width - x.shape[1])))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket keys (row, table, own bucket first, then probes by what they lose on the largest coordinates)."""
        out = np.empty((len(unit), self.tables, self.buckets), np.int64)
        for t in range(self.tables):
            loss = np.zeros((len(unit), len(self.combos)))
            every = np.full(loss.shape, t, np.int64)
            for j in range(self.k):
                x = rotated(unit, self.signs[t, j])
                size = np.abs(x)
                top = np.argsort(-size, axis=1, kind="stable")[:, :CHOICES]
                values = np.take_along_axis(size, top, 1)
                vertex = 2 * top + (np.take_along_axis(x, top, 1) < 0)
                loss += ((values[:, :1] - values) ** 2)[:, self.combos[:, j]]
                every = every * (2 * self.width) + vertex[:, self.combos[:, j]]  # wraps for huge widths: such keys meet by chance only
            order = np.argsort(loss, axis=1, kind="stable")[:, : self.buckets]
            out[:, t] = np.take_along_axis(every, order, 1)
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        bits = np.concatenate([rotated(unit, s) < 0 for s in self.sketch_signs], axis=1)[:, :SKETCH]
        return np.packbits(bits, axis=1).view(np.int64)


def plan(dim: int, n: int, threshold: float) -> Hashes:
    """Hashes a bucket by the number of vectors, and as many tables as a fixed trial of random pairs at the threshold asks for."""
    width = max(16, 1 << (dim - 1).bit_length())
    k = max(1, math.ceil(math.log(max(1.0, n / BUCKET_ROWS)) / math.log(2 * width)))
    probes = 3 if k <= 2 else 7
    rng = np.random.default_rng(SEED)
    x, z = rng.normal(size=(2, 4000, dim))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
    one = Hashes(dim, k, 1, probes)
    a, b = (one.keys(one.padded(v))[:, 0] for v in (x, threshold * x + math.sqrt(1 - threshold**2) * z))
    met = float(((a == b[:, :1]) | (b == a[:, :1])).any(axis=1).mean())
    tables = math.ceil(math.log(MISS) / math.log(1 - min(max(met, 0.05), 0.999)))
    return Hashes(dim, k, max(2, tables), probes)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``column``; zeros follow a shorter one."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; rows are scaled first, so that no square is lost or overflows."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    x, y = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (x, y))
    return 2 * np.arctan2(np.sqrt(((x - y) ** 2).sum(1)), np.sqrt(((x + y) ** 2).sum(1)))


def _measured(pairs: DataFrame, dim: int) -> DataFrame:
    """``pairs`` with ``cosine`` and ``angle`` in place of the vectors ``x`` and ``y``."""
    kept = [f for f in pairs.schema if f.name not in ("x", "y")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "cosine double", "angle double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(c), dim) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(cosines(x, y)), pa.array(_angles(x, y))], [*(f.name for f in kept), "cosine", "angle"])

    return pairs.mapInArrow(run, schema)


def _hashed(vectors: DataFrame, hashes: Hashes, dim: int) -> DataFrame:
    """``id, copies, x`` with its own buckets, all its buckets and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                unit = hashes.padded(_matrix(part.column("x"), dim))
                keys, sketch = hashes.keys(unit), hashes.sketch(unit)
                own = pa.array(list(keys[:, :, 0]), pa.list_(pa.int64()))
                every = pa.array(list(keys.reshape(len(part), -1)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "x")), own, every, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["id", "copies", "x", "own", "keys", "s1", "s2"])

    return vectors.mapInArrow(run, "id long, copies long, x array<double>, own array<long>, keys array<long>, s1 long, s2 long")


def _may_link(angle: Column) -> Column:
    """Whether two sketches differ in no more bits than vectors at ``angle`` do, but for a chance of one in 10**9."""
    share = F.least(angle / math.pi, F.lit(1.0))
    differ = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    return differ <= SKETCH * share + DEVIATIONS * F.sqrt(SKETCH * share * (1 - share))


def link_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every vector: links are pairs of cosine ``threshold`` or more.

    Equal vectors are one with a number of copies. Each is rotated and hashed: the largest coordinate and its sign
    name a vertex of the cross-polytope, ``k`` of them a bucket, in as many tables as the threshold needs; two vectors
    meet where one's bucket is among those that the other probes. Every pair that meets is decided by its cosine in
    double precision, so no link is false, and of links at the threshold itself one in a thousand may be missed.

    Large groups are not compared pair by pair. Vectors that share their buckets in two tables and are within half
    the threshold's angle of the least of them are a ball, in which all are linked. Buckets hold balls: two that
    meet are wholly linked or wholly apart by their centres' angle and radii, or else one's vectors are compared with
    the other's centre, and only those still open with its vectors. Counts of links are sums of ball sizes, and
    components are those of balls.

    Null vectors, empty ones, zeros and vectors with a null or non-finite component link with nothing, and so do rows
    with a null id, whose component is null; they are kept. Repeated rows are vectors of their own. Zeros follow a
    shorter vector. Ids are long; other columns are left out. An empty table gives no rows.
    """
    spark = rows.sparkSession
    theta = math.acos(threshold)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    good = F.col("id").isNotNull() & usable(F.col("x")) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    # 128 bits name a vector; a number of its own, fixed by the write, stands for it, as an id may repeat with other vectors
    named = own.withColumns({"good": good, "p1": F.when(good, F.xxhash64(F.lit(1), "x")), "p2": F.when(good, F.xxhash64(F.lit(2), "x"))})
    equal = named.where("good").groupBy("p1", "p2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    vectors, vectors_path = durable(equal.withColumn("id", F.monotonically_increasing_id()))
    paths = [vectors_path]
    n, dim = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    hashes = plan(dim, n, threshold)
    hashed, p = durable(_hashed(vectors.select("id", "copies", "x"), hashes, dim))
    paths.append(p)
    balls, p = _balls(hashed, dim, theta)
    paths += p
    centres, p = durable(balls.groupBy("ball").agg(F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius")).join(hashed.select(F.col("id").alias("ball"), "x", "s1", "s2"), "ball"))
    paths.append(p)
    meets, p = durable(_meetings(hashed, balls, centres, theta))
    paths.append(p)
    counts, edges, p = _decided(meets, balls, centres, dim, threshold, theta)
    paths += p
    more = counts.where("whole").groupBy("id").agg(F.sum("n").alias("more")).withColumnRenamed("id", "ball")
    found = components(edges).withColumnRenamed("id", "ball")
    base = F.col("weight") - 1 + F.coalesce("more", F.lit(0))
    of_ball, p = durable(centres.select("ball", "weight").join(more, "ball", "left").join(found, "ball", "left").select("ball", base.alias("base"), F.coalesce("component", "ball").alias("component")))
    paths.append(p)
    singly = counts.where("NOT whole").groupBy("id").agg(F.sum("n").alias("own"))
    links = F.col("base") + F.coalesce("own", F.lit(0))
    each, p = durable(balls.select("id", "ball").join(of_ball, "ball").join(singly, "id", "left").join(vectors.select("id", "least", "p1", "p2"), "id").select("least", F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), links.alias("n_links"), "component"))
    paths.append(p)
    roots, p = durable(each.groupBy("component").agg(F.min("least").alias("root")))
    paths.append(p)
    by_name, _ = durable(each.join(roots, "component").select("_p1", "_p2", "n_links", F.col("root").alias("component")))
    discard(spark, *paths)
    joined = named.select("id", "p1", "p2").join(by_name, (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _balls(hashed: DataFrame, dim: int, theta: float) -> tuple[DataFrame, list[str]]:
    """``id, copies, x, ball, angle``: vectors near the least one with the same buckets in two tables are of its ball; others are balls of their own."""
    key = [F.get("own", F.lit(k)).alias(f"k{k}") for k in (0, 1)]
    marked = hashed.select("id", "copies", "x", *key)
    shared = marked.groupBy("k0", "k1").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    centred, p = durable(shared.join(hashed.select(F.col("id").alias("centre"), F.col("x").alias("y")), "centre"))
    near = _measured(marked.select("id", "k0", "k1", "x").join(centred, ["k0", "k1"]).select("id", "centre", "x", "y"), dim)
    near, p2 = durable(near.where(F.col("angle") <= theta / 2 - MARGIN).select(F.col("id").alias("_id"), "centre", "angle"))
    out, p3 = durable(hashed.select("id", "copies", "x").join(near, F.col("id") == F.col("_id"), "left").select("id", "copies", "x", F.coalesce("centre", "id").alias("ball"), F.when(F.col("centre") == F.col("id"), 0.0).otherwise(F.coalesce("angle", F.lit(0.0))).alias("angle")))
    return out, [p, p2, p3]


def _meetings(hashed: DataFrame, balls: DataFrame, centres: DataFrame, theta: float) -> DataFrame:
    """Distinct pairs ``a < b`` of balls of which a vector of one is in a bucket that a vector of the other probes."""
    of = hashed.select("id", "own", "keys").join(balls.select("id", "ball"), "id")
    traits = centres.select("ball", "s1", "s2", "radius")
    same = [F.min(c).alias(c) for c in ("s1", "s2", "radius")]
    in_bucket, probing = (of.join(traits, "ball").select("ball", "s1", "s2", "radius", F.explode(c).alias("key")).groupBy("key", "ball").agg(*same) for c in ("own", "keys"))
    may = _may_link(theta + F.col("x.radius") + F.col("y.radius"))
    pairs = in_bucket.alias("x").join(probing.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.ball") != F.col("y.ball")) & may)
    return pairs.select(F.least("x.ball", "y.ball").alias("a"), F.greatest("x.ball", "y.ball").alias("b")).distinct()


def _decided(meets: DataFrame, balls: DataFrame, centres: DataFrame, dim: int, threshold: float, theta: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """What links between balls add, ``id, n, whole`` (to all of a ball, or to one vector), and the linked balls ``a, b``."""
    side = lambda k, v: centres.select(F.col("ball").alias(k), F.col("x").alias(v), F.col("radius").alias(f"r{k}"), F.col("size").alias(f"m{k}"), F.col("weight").alias(f"w{k}"))
    first, p1 = durable(_measured(meets.join(side("a", "x"), "a").join(side("b", "y"), "b"), dim))
    single = (F.col("ma") == 1) & (F.col("mb") == 1)
    reach = F.col("angle") + F.col("ra") + F.col("rb")
    all_ = F.when(single, F.col("cosine") >= threshold).otherwise(reach <= theta - MARGIN)
    none = F.when(single, F.col("cosine") < threshold).otherwise(F.col("angle") - F.col("ra") - F.col("rb") > theta + MARGIN)
    linked = first.where(all_)
    # the larger ball's vectors against the other's centre
    swap = F.col("ma") >= F.col("mb")
    open_ = first.where(~all_ & ~none).select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"))
    members = balls.select(F.col("ball").alias("big"), "id", "copies", "x")
    centre = centres.select(F.col("ball").alias("small"), F.col("x").alias("y"), F.col("radius").alias("r"), F.col("size").alias("m"), F.col("weight").alias("w"))
    second, p2 = durable(_measured(open_.join(members, "big").join(centre, "small"), dim))
    one = F.col("m") == 1
    all2 = F.when(one, F.col("cosine") >= threshold).otherwise(F.col("angle") + F.col("r") <= theta - MARGIN)
    none2 = F.when(one, F.col("cosine") < threshold).otherwise(F.col("angle") - F.col("r") > theta + MARGIN)
    touched = second.where(all2)
    rest = second.where(~all2 & ~none2).select("big", "small", "id", "copies")
    others = balls.select(F.col("ball").alias("small"), F.col("id").alias("other"), F.col("copies").alias("others"), F.col("x").alias("y"))
    third, p3 = durable(_measured(rest.join(balls.select("id", "x"), "id").join(others, "small"), dim).where(F.col("cosine") >= threshold).select("big", "small", "id", "copies", "other", "others"))
    add = lambda df, who, n, whole: df.select(F.col(who).alias("id"), F.col(n).alias("n"), F.lit(whole).alias("whole"))
    counts = add(linked, "a", "wb", True).unionByName(add(linked, "b", "wa", True)).unionByName(add(touched, "id", "w", False)).unionByName(add(touched, "small", "copies", True)).unionByName(add(third, "id", "others", False)).unionByName(add(third, "other", "copies", False))
    edges = linked.select("a", "b").unionByName(touched.select(F.col("big").alias("a"), F.col("small").alias("b"))).unionByName(third.select(F.col("big").alias("a"), F.col("small").alias("b"))).distinct()
    return counts, edges, [p1, p2, p3]


def op13_near_vectors(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE k AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM k),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
c AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT links.y, c.root FROM c JOIN links ON links.x = c.id)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY 1) n ON n.x = e.vec_id
JOIN (SELECT id, min(root) AS component_id FROM c GROUP BY 1) m ON m.id = e.vec_id
"""
