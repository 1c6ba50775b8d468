"""Product codes of vectors: exact integer codebooks by Lloyd rounds over members that stay where their entry lives."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.blocks import pack, unpack
from tidewheel.llm.tables import broadcast_if_small, discard, durable, shared_folder

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Members of one position that an owner has, about, whichever entry they are in.
OWNER_ROWS = 1 << 16

_MEMBERS = "owner long, body binary"
_RESIDENTS = "owner long, position int, entry int, n long, sums array<long>, body binary"


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """``floor(4096 x)`` of all components, a row a vector. Beyond what keeps all sums of squares in 64 bits, values stop at that bound."""
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    bound = float(2 ** ((61 - (dim - 1).bit_length()) // 2))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -bound, bound).astype(np.int64)


class Codebooks:
    """Entries of each part position, as integers."""

    def __init__(self, entries: np.ndarray, parts: int):
        cuts = [k * entries.shape[1] // parts for k in range(parts + 1)]
        self.spans = list(zip(cuts, cuts[1:], strict=False))
        self.books = [entries[:, a:b].copy() for a, b in self.spans]

    def nearest(self, position: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of a tie), and the squared distance."""
        book = self.books[position]
        index, distance = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
        if max(np.abs(members).max(initial=0), np.abs(book).max(initial=0)) < 1 << 21 and book.shape[1] <= 256:
            # all terms are integers below 2**53, so floating point says them exactly
            x, c = members.astype(np.float64), book.astype(np.float64)
            every = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
            index = every.argmin(1)
            return index, every[np.arange(len(x)), index].astype(np.int64)
        for k, entry in enumerate(book):
            d = ((members - entry) ** 2).sum(1)
            closer = d < distance if k else np.ones(len(d), bool)
            index[closer], distance[closer] = k, d[closer]
        return index, distance

    def text(self) -> str:
        return ",".join(str(int(x)) for book in self.books for entry in book for x in entry)


class _Owners:
    """(position, entry, salt) as one number."""

    def __init__(self, entries: int, salts: int):
        self.entries, self.salts = entries, salts

    def of(self, position: int, entry: int, salt: int) -> int:
        return (position * self.entries + entry) * self.salts + salt

    def split(self, owner: int) -> tuple[int, int, int]:
        return owner // self.salts // self.entries, owner // self.salts % self.entries, owner % self.salts


def _members(owners: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([pack(p.astype(np.int32).ravel()) for p in parts], pa.binary())], ["owner", "body"])


def _opened(bodies: list[bytes], width: int) -> np.ndarray:
    parts = [unpack(b)[0].reshape(-1, width).astype(np.int64) for b in bodies]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)


def _deal(books: Codebooks, owners: _Owners, dim: int):
    """All parts to the owners of their nearest entries; the salt goes round with the batches, so that equal rows spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), 4096):
                x = scaled(batch.column("vector").slice(at, 4096), dim)
                to, parts = [], []
                for position, (a, b) in enumerate(books.spans):
                    index, _ = books.nearest(position, x[:, a:b])
                    for entry in np.unique(index).tolist():
                        to.append(owners.of(position, entry, turn % owners.salts))
                        parts.append(x[index == entry, a:b])
                turn += 1
                yield _members(to, parts)

    return run


def _leave(books: Codebooks, owners: _Owners):
    """Resident members whose nearest entry is another one now, packed for its owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, body in zip(batch.column("owner").to_pylist(), batch.column("body").to_pylist(), strict=True):
                position, entry, salt = owners.split(owner)
                members = _opened([body], books.books[position].shape[1])
                index, _ = books.nearest(position, members)
                away = [k for k in np.unique(index).tolist() if k != entry]
                if away:
                    yield _members([owners.of(position, k, salt) for k in away], [members[index == k] for k in away])

    return run


def _settle(books: Codebooks, owners: _Owners):
    """An owner's members: residents that stay and parts that came, with their number and sums."""

    def run(residents: pa.Table, came: pa.Table) -> pa.Table:
        owner = (residents if residents.num_rows else came).column("owner")[0].as_py()
        position, entry, _ = owners.split(owner)
        width = books.books[position].shape[1]
        stay = _opened(residents.column("body").to_pylist(), width)
        stay = stay[books.nearest(position, stay)[0] == entry]
        members = np.concatenate([stay, _opened(came.column("body").to_pylist(), width)])
        keep = slice(0, 1 if len(members) else 0)
        return pa.table(
            {
                "owner": pa.array([owner], pa.int64())[keep],
                "position": pa.array([position], pa.int32())[keep],
                "entry": pa.array([entry], pa.int32())[keep],
                "n": pa.array([len(members)], pa.int64())[keep],
                "sums": pa.array([members.sum(0).tolist()], pa.list_(pa.int64()))[keep],
                "body": pa.array([pack(members.astype(np.int32).ravel())], pa.binary())[keep],
            }
        )

    return run


def _house(residents: DataFrame) -> tuple[str, str]:
    """Residents as a table bucketed by owner in the shared folder, its name and path: later rounds read them where they are, without a shuffle."""
    spark, name = residents.sparkSession, f"tidewheel_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents.write.option("path", path).bucketBy(n, "owner").sortBy("owner").saveAsTable(name)
    return name, path


def _leave_house(spark, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard(spark, path)


def _means(residents: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry's members' means, rounded down; an entry without members stays. Owners' sums are added by Spark; a row an entry comes back."""
    width = max(b.shape[1] for b in books.books)
    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    new = Codebooks(np.concatenate(books.books, axis=1), len(books.books))
    for r in residents.groupBy("position", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        w = new.books[r["position"]].shape[1]
        new.books[r["position"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(w)]
    return new


def learn(vectors: DataFrame, first: np.ndarray, n: int, *, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``vectors`` (``vector``: usable ones of one length, ``n`` of them) from the entries ``first``.

    Parts are rows of owners (position, entry, salt): as many salts as keep an owner's members near ``OWNER_ROWS``
    even if all of a position's parts share an entry. In each round owners sum their residents, and only parts whose
    nearest entry has changed are shuffled to their new owners; the others stay in a table bucketed by owner. Rounds
    end early when no entry moves, as nothing would change after that.
    """
    spark = vectors.sparkSession
    dim = first.shape[1]
    books, owners = Codebooks(first, parts), _Owners(len(first), -(-n // OWNER_ROWS))
    came = vectors.select("vector").mapInArrow(_deal(books, owners, dim), _MEMBERS)
    settle = _settle(books, owners)
    nobody = pa.table({"owner": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
    house = _house(came.groupBy("owner").applyInArrow(lambda t: settle(nobody, t), _RESIDENTS))
    for k in range(rounds):
        new = _means(spark.table(house[0]), books)
        still = all((a == b).all() for a, b in zip(new.books, books.books, strict=True))
        books = new
        if still or k + 1 == rounds:
            break
        residents = spark.table(house[0]).select("owner", "body")
        moved = residents.mapInArrow(_leave(books, owners), _MEMBERS)
        new_house = _house(residents.groupBy("owner").cogroup(moved.groupBy("owner")).applyInArrow(_settle(books, owners), _RESIDENTS))
        _leave_house(spark, *house)
        house = new_house
    _leave_house(spark, *house)
    return books


def _coded(books: Codebooks, dim: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch.column("vector"), dim)
            error, code = np.zeros(len(x), np.int64), np.zeros((len(x), len(books.spans)), np.uint8)
            for position, (a, b) in enumerate(books.spans):
                index, d = books.nearest(position, x[:, a:b])
                code[:, position], error = index, error + d
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], [*kept, "code", "error"])

    return run


def compress(rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every usable vector.

    Components are ``floor(4096 x)``; each position's codebook starts as that part of the ``entries`` (256 at most)
    vectors of least id, and is learned by ``learn`` over all rows. A code has two hex digits for each part; ``error``
    sums the squared distances to the coded entries, ``label_error`` those of all rows of a label, null ones together.

    Vectors that are null, empty or hold a null or non-finite component are dropped, and so are those of another length
    than the one of least id. A length that ``parts`` doesn't divide gives parts of lengths that differ by one, a shorter one a part a component. Values
    beyond 2**27 (of 64 components) after scaling count as that bound. Of equal ids the lesser vector gives an
    entry first, null ids come last; every row of a repeated id is coded. Other columns are left out. An empty table
    gives no rows.
    """
    spark = rows.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    types = f"_id {dict(rows.dtypes)[id_col]}, _label {dict(rows.dtypes)[label] if label else 'int'}"
    own = rows.select(F.col(id_col).alias("_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("_label"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    order = [F.asc_nulls_last("_id"), F.asc("vector")]
    least = own.orderBy(*order).select(F.size("vector")).head(1)
    dim = least[0][0] if least else parts
    own, parts = own.where(F.size("vector") == dim), min(parts, dim)
    names = {"_id": id_col, "code": "code", "error": "error", "label_error": "label_error", "codebooks_sha256": "codebooks_sha256"}
    if not least:
        return own.select(F.col("_id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    first = pa.array([r["vector"] for r in own.orderBy(*order).select("vector").head(entries)], pa.list_(pa.float64()))
    books = learn(own, scaled(first, dim), own.count(), parts=parts, rounds=rounds)
    coded, _ = durable(own.mapInArrow(_coded(books, dim, ["_id", "_label"]), f"{types}, code string, error long"))
    totals = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    joined = coded.join(broadcast_if_small(totals), F.col("_label").eqNullSafe(F.col("_of")))
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    return joined.withColumn("codebooks_sha256", F.lit(digest)).select(*[F.col(c).alias(n) for c, n in names.items()])


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The rounds written out one after the other; ``best`` is the distance times 16 and the entry, so its least is the nearest, lower entry."""
    rounds = []
    for r in range(1, ROUNDS + 2):
        near = f"""a{r} AS MATERIALIZED (SELECT p.vec_id, p.p, any_value(m) AS m, min(list_sum(list_transform(range(1, len(m) + 1), lambda i: (m[i] - c[i]) * (m[i] - c[i])))::BIGINT * {ENTRIES} + e) AS best FROM p JOIN c{r - 1} c ON c.p = p.p GROUP BY 1, 2)"""
        mean = f"""s{r} AS (SELECT p, best % {ENTRIES} AS e, i, (sum(m[i]) - ((sum(m[i]) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM a{r}, unnest(range(1, len(m) + 1)) t(i) GROUP BY 1, 2, 3),
c{r} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{r - 1} c LEFT JOIN (SELECT p, e, list(v::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY 1, 2) n USING (p, e))"""
        rounds += [near] + [mean] * (r <= ROUNDS)
    last = ROUNDS + 1
    return f"""
WITH k AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, p, list_transform(v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})], lambda x: floor({SCALE} * x)::BIGINT) AS m FROM k, unnest(range({PARTS})) t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {ENTRIES}),
c0 AS MATERIALIZED (SELECT p, e, m AS c FROM f JOIN p USING (vec_id)),
{", ".join(rounds)},
o AS (SELECT vec_id, string_agg(printf('%02x', (best % {ENTRIES})::INT), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a{last} GROUP BY 1),
d AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), d
"""


ORACLE = _oracle()
