"""Exact set-similarity join of documents on word shingles, with set-relation skipping."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import words
from tidewheel.llm.blocks import ask, gaps, in_blocks, pack, unpack
from tidewheel.llm.tables import broadcast_if_small, discard, durable, whole_text

WIDTH = 5
BLOCK_BYTES = 4 << 20
#: Shingles that a frequency bucket gets, about.
BUCKET_SHINGLES = 1 << 20
#: Sets are drawn while these halve the comparisons left and these are more than so many for each index entry (or in all).
PAIRS_PER_ENTRY, LEAST_PAIRS = 4, 0
#: Sets of a list that are drawn at first, about, and by how much more with each round.
ASKED, MORE = 16, 16
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Sizes meet in bands of this ratio.
BAND = 1.06

SETS = "doc_id long, carried string, n_shingles long, print binary, common long, sketch array<long>, shingles array<long>, keys array<long>, at array<int>"


class _Sets:
    """The shingle sets of a block; equal sets are kept once, for the least id."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        sets = words.shingle_sets(*words.word_hashes(*words.text_bytes(table.column("text"))), WIDTH)
        self.sizes = [len(s) for s in sets]
        self.prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        best: dict[bytes, int] = {}
        for i, p in enumerate(self.prints):
            if p is not None and self.ids[i] is not None and (p not in best or self.ids[i] < self.ids[best[p]]):
                best[p] = i
        self.rows = sorted(best.values())
        self.sets = [sets[i] for i in self.rows]
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.types, self.type, self.counts = np.unique(every, return_inverse=True, return_counts=True)


def _send(bits: int):
    def send(table: pa.Table):
        s = _Sets(table)
        top = (s.types >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s.types), np.int64)
        low = ((s.types << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(top)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(top)], strict=True):
            if b > a:
                yield int(top[a]), pack(gaps(low[a:b]), np.minimum(s.counts[a:b], 65535).astype(np.uint16))

    return send


def _answer(bodies: list[bytes]) -> list[bytes]:
    """In how many sets each shingle is, over all blocks. Shingles are told apart by 32 bits within a bucket: what collides is only ranked later."""
    parts = [unpack(b) for b in bodies]
    _, inverse = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint32) for k, _ in parts]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.uint32)[inverse]
    return [pack(x) for x in np.split(total, np.cumsum([len(k) for k, _ in parts])[:-1])]


def _sketch(values: np.ndarray) -> np.ndarray:
    """For each of ``64 * SKETCH`` classes of shingles whether a set has an odd number: two sketches differ in at most as many bits as the sets differ in shingles."""
    odd = np.bincount((values & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def prefix_length(n):
    """Entries of a set of ``n`` that must share one with any set at a similarity of 0.8: all but the last ceil(0.8 n) - 1."""
    return n - (4 * n + 4) // 5 + 1


def _finish(_: int, table: pa.Table, replies: list[tuple[int, bytes]]) -> pa.Table:
    s = _Sets(table)
    found = np.concatenate([unpack(body)[0] for _, body in replies]) if replies else np.zeros(0, np.uint32)
    count = found[s.type] if len(found) else found
    n = len(s.ids)
    shingles, keys, at, sketch, common = [None] * n, [None] * n, [None] * n, [None] * n, [None] * n
    end = 0
    for row, values in zip(s.rows, s.sets, strict=True):
        begin, end = end, end + len(values)
        frequency = count[begin:end]
        order = np.lexsort((values, frequency))[: prefix_length(len(values))]
        shared = np.flatnonzero(frequency[order] > 1)
        # a shingle of one set joins nothing, and nor does a set of which less than 0.8 is in any other
        if len(shared) and 5 * int((frequency > 1).sum()) >= 4 * len(values):
            shingles[row], keys[row], at[row] = values.view(np.int64), values[order[shared]].view(np.int64), shared.astype(np.int32)
            sketch[row], common[row] = _sketch(values), int((frequency > 1).sum())
    return pa.table({"doc_id": pa.array(s.ids, pa.int64()), "carried": table.column("carried"), "n_shingles": pa.array(s.sizes, pa.int64()), "print": pa.array(s.prints, pa.binary()), "common": pa.array(common, pa.int64()), "sketch": pa.array(sketch, pa.list_(pa.int64())), "shingles": pa.array(shingles, pa.list_(pa.int64())), "keys": pa.array(keys, pa.list_(pa.int64())), "at": pa.array(at, pa.list_(pa.int32()))})


def _similar_enough(n1: str, n2: str, at1: str, at2: str) -> Column:
    """What sizes and positions allow: if the shared entry is the first that both have, enough is left behind it."""
    need = F.ceil((F.col(n1) + F.col(n2)) * 4 / 9)
    left = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))
    return (F.col(n1) * 5 >= F.col(n2) * 4) & (F.col(n2) * 5 >= F.col(n1) * 4) & (left >= need)


def _reach() -> Column:
    """The size of the largest set that can be similar to an entry's by this entry.

    It and all entries that both have lie behind it or are among those that any other set has; with these ``u``,
    ``9 u >= 4 (n + other)`` must hold, and sizes differ by 5 : 4 at most. Of two sets each must be within the other's
    reach, so one of them reaches its own size.
    """
    u = F.least(F.col("n") - F.col("at"), F.col("common"))
    return F.least(F.floor(9 * u / 4) - F.col("n"), F.floor(5 * F.col("n") / 4))


def _verify(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b, shared``: the exact overlap of each distinct pair of set ids. ``sets`` gives the sets of a table of ids."""
    pairs = pairs.select("a", "b")
    few = broadcast_if_small(pairs, 100_000)
    a, b = (F.broadcast(x) if few is not pairs else x for x in (pairs.select(F.col(c).alias("id")) for c in ("a", "b")))
    first = sets(a).select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")).join(few, "a")
    # the other sides are few (leaders) or as many as the pairs; adaptive execution splits a leader that many pairs name
    second = sets(b).select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = first.join(second, "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))


def _checked(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    fresh, first = durable(pairs)
    more, second = durable(_verify(fresh, sets))
    return more, [first, second]


def _linked(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * 80).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the least id reachable) for every id in ``links`` (``a, b``), by large and small stars.

    Each round links a node's larger neighbours, and then its smaller ones, to the least of them, until every node
    has one edge and no centre has any. A node's least neighbour is a combining aggregate to which its edges are
    joined, so no group is gathered in one task.
    """
    edges, path = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        degrees = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if not degrees.where("out > 1 OR (out > 0 AND in > 0)").limit(1).count():
            stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small, new = durable(small)
        discard(links.sparkSession, path)
        edges, path = small, new


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``: which documents reach each other by links of similarity 0.8 or more.

    Sets are distinct 5-word shingles of the lower-cased words (all words of a shorter text as one), kept as
    64-bit hashes. Equal sets are one set, of the least id. Blocks ask in how many sets each shingle is, and index
    the rarest entries of a set that any partner must share (those in one set only are dropped), with positions.

    Every list has a leader, its least set; each set is compared first with the leader that most of its lists name,
    its pivot, and is then known to be linked or to share so much with it. A list is left out whole once its sets are
    one component, or once none of those that reach their own size can meet another component. While many comparisons
    are left, sets outside a list's main component meet a few of its sets, drawn by a hash of their ids, and more as
    long as that halves what is left: a set that many of a component are linked with finds one of them early, and is
    in it when the rest meet. At last sets outside a list's main component meet those of other components in bands of
    sizes. A pair leaves these joins only if nothing proves the answer: positions; the entries that any other set has;
    that x shares with y at most what both share with a pivot and what each has beside it; and parity sketches, whose
    distance is never more than that of the sets. So the pairs that are compared exactly are few more than those
    linked, however long a list is.

    Null ids form no links and get a null component; null and wordless texts have 0 shingles and their own id as
    component; repeated rows are equal sets. Other columns are left out, but for a string column named by ``carry``.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"), (F.col(carry) if carry else F.lit(None)).cast("string").alias("carried"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size) // (6 * BUCKET_SHINGLES)).bit_length())
    table, sets_path = durable(ask(in_blocks(own, BLOCK_BYTES), _send(bits), _answer, _finish, SETS))
    paths = [sets_path]
    prints = table.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("id"))
    rows = table.where("shingles IS NOT NULL").select(F.col("print").alias("_print"), "doc_id", F.col("n_shingles").alias("n"), "common", "sketch", "shingles", "keys", "at")

    def sets_of(some: DataFrame) -> DataFrame:
        # one row a set, but for repeated rows in several blocks: their links and components are the same
        return some.join(prints, (F.col("_print") == F.col("print")) & (F.col("doc_id") == F.col("id"))).select("id", "n", "common", "sketch", "shingles", "keys", "at")

    def named(ids: DataFrame) -> DataFrame:
        # the rows named come first, so that few shingles are shuffled
        return sets_of(rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi"))

    sets = sets_of(rows)
    exploded = sets.select("id", "n", "common", F.explode(F.arrays_zip("keys", "at")).alias("e")).select("id", "n", "common", F.col("e.keys").alias("key"), F.col("e.at").alias("at"))
    entries, p = durable(exploded.select("id", "n", "key", "at", _reach().alias("reach")).where("5 * reach >= 4 * n"))
    paths.append(p)
    traits = sets.select("id", "common", "sketch")
    lists = entries.groupBy("key").agg(F.min(F.struct("id", "n", "at")).alias("lead"), F.count(F.lit(1)).alias("m"), F.max(F.col("reach") >= F.col("n")).alias("any")).where("m > 1 AND any")
    lists = lists.select("key", "m", F.col("lead.id").alias("leader"), F.col("lead.n").alias("ln"), F.col("lead.at").alias("lat"))
    entries, p = durable(entries.join(lists, "key"))
    paths.append(p)
    votes = entries.where((F.col("id") != F.col("leader")) & _similar_enough("n", "ln", "at", "lat")).groupBy("id", "leader").agg(F.count(F.lit(1)).alias("votes"))
    pairs = votes.groupBy("id").agg(F.max(F.struct("votes", -F.col("leader"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.col2")).alias("b"))
    verified, p = _checked(pairs, named)
    paths += p
    traits, p = durable(traits.join(verified.select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.col("shared").alias("with_pivot")), "id", "left"))
    paths.append(p)
    total, asked, before = entries.count(), ASKED, None
    while True:
        found, p = durable(components(_linked(verified)))
        paths.append(p)
        known = entries.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component", "m")
        main, p = durable(_open_lists(known))
        paths.append(p)
        work, longest = (int(x or 0) for x in main.agg(F.sum("work"), F.max("m")).first())
        if not work:
            break
        open_ = known.join(main, "key")
        if work > max(PAIRS_PER_ENTRY * total, LEAST_PAIRS) and asked < longest and (before is None or 2 * work <= before):
            more, p = _checked(_asked(open_, verified, traits, asked), named)
            paths += p
            verified, asked, before = verified.unionByName(more), asked * MORE, work
            continue
        more, p = _checked(_across(open_, verified, traits), named)
        paths += p
        if _linked(more).limit(1).count():
            found, p = durable(components(_linked(verified.unionByName(more))))
            paths.append(p)
        break
    # a table of its own, so that the join below has plain shuffles on both sides and a hot print can be split
    classes, p = durable(prints.join(found, "id", "left").select("print", F.coalesce("component", "id").alias("component")))
    paths.append(p)
    members = table.select("doc_id", "carried", "n_shingles", F.col("print").alias("_print")).join(classes, F.col("_print") == F.col("print"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    carried = [F.col("carried").alias(carry)] if carry else []
    result, _ = durable(members.select("doc_id", "n_shingles", component.alias("component_id"), *carried))
    discard(spark, *paths)
    return result


def _open_lists(known: DataFrame) -> DataFrame:
    """``key, main, m, work``: lists in which two components can meet, their main component, sets and the pairs that can.

    Of two sets that meet one reaches its own size: one outside the main component meets all, the others only such of it.
    """
    sizes = known.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("reach") >= F.col("n")).cast("long")).alias("far"))
    lists = sizes.groupBy("key").agg(F.max(F.struct("k", "c", "far")).alias("top"), F.sum("k").alias("m"), F.sum("far").alias("far"))
    far, others = F.col("far") - F.col("top.far"), F.col("m") - F.col("top.k")
    return lists.select("key", F.col("top.c").alias("main"), "m", (far * F.col("m") + (others - far) * F.col("top.far")).alias("work")).where("work > 0")


MEETING = ["key", "id", "n", "at", "reach", "c", "main", "m", "common", "sketch", "pivot", "with_pivot"]


def _across(entries: DataFrame, verified: DataFrame, traits: DataFrame) -> DataFrame:
    """Distinct pairs of one list and two components, one of them outside the main one, that nothing known decides.

    A pair that meets leaves the join only where each is within the other's reach, and the shingles that other sets
    have at all, what both share with the same pivot, and the sketches all allow a similarity of 0.8.
    """
    seen = entries.join(traits, "id").select(*MEETING)
    return _new(reduce(DataFrame.unionByName, [_undecided(m) for m in _meet(seen)]).distinct(), verified)


def _asked(entries: DataFrame, verified: DataFrame, traits: DataFrame, asked: int) -> DataFrame:
    """Pairs, as ``_across`` has them, of sets with about ``asked`` of a longer list."""
    seen = entries.where(F.col("m") > asked).join(traits, "id").select(*MEETING)
    return _new(_undecided(_meet_drawn(seen, asked)).distinct(), verified)


def _undecided(met: DataFrame) -> DataFrame:
    """``a, b`` of those pairs ``x, y`` that may be similar."""
    need = 4 * (F.col("x.n") + F.col("y.n"))
    beside = F.least(F.col("x.common") - F.col("x.with_pivot"), F.col("y.common") - F.col("y.with_pivot"))
    by_pivot = F.least("x.with_pivot", "y.with_pivot") + F.greatest(beside, F.lit(0))
    same_pivot = F.coalesce((F.col("x.pivot") == F.col("y.pivot")) & (9 * by_pivot < need), F.lit(False))
    differ = sum((F.bit_count(F.col("x.sketch")[k].bitwiseXOR(F.col("y.sketch")[k])) for k in range(SKETCH)), F.lit(0))
    within = (F.col("x.c") != F.col("y.c")) & (F.col("y.n") <= F.col("x.reach")) & (F.col("x.n") <= F.col("y.reach"))
    may = within & _similar_enough("x.n", "y.n", "x.at", "y.at") & (9 * F.least("x.common", "y.common") >= need) & ~same_pivot & (9 * differ <= F.col("x.n") + F.col("y.n"))
    return met.where(may).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def _band(n: Column) -> Column:
    return F.floor(F.log(BAND, n))


def _to_meet(seen: DataFrame) -> DataFrame:
    """``seen`` once for each band of sizes that a set similar to it by its entry can have."""
    least = F.floor((4 * F.col("n") + 4) / 5)
    return seen.withColumn("band", F.explode(F.sequence(_band(least), _band(F.col("reach")))))


def _meet(seen: DataFrame) -> list[DataFrame]:
    """Sets of a list, ``x`` and ``y``, of which ``y`` has a size that ``x`` may be similar to: one outside the main component, one that reaches its own size.

    Sets that reach less far never meet each other, so a list of those makes no pair, however long it is.
    """
    banded = seen.withColumn("band", _band(F.col("n")))
    far, outer = F.col("reach") >= F.col("n"), F.col("c") != F.col("main")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band"))
    # far ones outside the main component meet all others; of two such the lesser id comes first
    once = same & ((F.col("y.c") == F.col("y.main")) | (F.col("y.reach") < F.col("y.n")) | (F.col("x.id") < F.col("y.id")))
    first = _to_meet(seen.where(far & outer)).alias("x").join(banded.alias("y"), once)
    rest = _to_meet(seen.where(~far & outer)).alias("x").join(banded.where(far & ~outer).alias("y"), same)
    return [first, rest]


def _meet_drawn(seen: DataFrame, asked: int) -> DataFrame:
    """About ``asked`` sets of each list, ``x``, and those outside its main component, ``y``, each in one list for a main component.

    A set is drawn in most of its lists or in none, so ``y`` would meet the same ones in its other lists of that component.
    """
    drawn = seen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) * F.col("m") < (asked << 31))
    outer = seen.where("c <> main")
    once = outer.groupBy("id", "main").agg(F.max(F.struct("m", "key")).alias("longest")).select("id", F.col("longest.key").alias("key"))
    return drawn.alias("x").join(outer.join(once.distinct(), ["id", "key"]).alias("y"), F.col("x.key") == F.col("y.key"))


def _new(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    done = verified.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def op10_jaccard_components(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
c AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT links.y, c.root FROM c JOIN links ON links.x = c.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM c GROUP BY 1) m ON m.id = w.doc_id
"""
