"""Cross-tokenizer alignment: groups of tokens with common ends, and corpus-wide counts of the id pairs that end together."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.blocks import gaps, pack, unpack
from tidewheel.llm.tables import discard, durable, whole_text
from tidewheel.llm.tokens import load_tokenizer, tokenizer_path

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents are encoded and their records sorted in blocks of about so many bytes of text.
BLOCK_BYTES = 4 << 20
#: Pieces of texts, and characters of them, after which a worker starts to remember anew.
KNOWN, KNOWN_CHARS = 1 << 19, 16 << 20
#: Radix of the partition by side-B id; a power of two.
BUCKETS = 64
#: Records of a run's frame, bytes of runs that one task merges, and runs that a later merge takes.
FRAME, TASK_BYTES, FAN = 1 << 14, 16 << 20, 256
#: Ids of both sides have so many bits at most.
ID_BITS = 16

_WRITTEN = "kind string, block long, bucket int, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, body binary"
_COLUMNS = _WRITTEN.replace(" long", "").replace(" int", "").replace(" string", "").replace(" binary", "").split(", ")
#: A single blank: no token of either side goes from before it to behind it (side B: checked when its pieces are read), and a blank comes before each text.
_BLANK = re.compile(r"(?<=\S) (?=\S)")


class _Sides:
    """Both tokenizers, the bytes of each id, and each id's decimal text with what may follow it."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = load_tokenizer(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        n_a, n_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        if max(n_a, n_b) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        plain = [self.a.id_to_token(i) or "" for i in range(n_a)]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in plain]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]
        self.b_names = 2 * n_a

    def pieces(self, text: str) -> list[str]:
        """Parts of ``text`` between single blanks. Both sides encode a blank and a part alike, alone or in the text, and both end a token with it."""
        return _BLANK.split(text) if self.cuttable else [text]

    def align(self, pieces: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each piece ``whole, n_a, n_b, n_groups``; its groups as text; and the pairs of all groups, piece after piece."""
        facts, texts = np.zeros((len(pieces), 4), np.int64), [""] * len(pieces)
        a_ids = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False)]
        b_ids = self.b.encode(pieces, num_threads=1)
        whole = range(len(pieces)) if self._whole(pieces, a_ids, b_ids) else [i for i, p in enumerate(pieces) if self._whole([p], [a_ids[i]], [b_ids[i]])]
        if not whole:
            return facts, texts, np.zeros(0, np.int64)
        a, b = (np.fromiter(chain.from_iterable(x[i] for i in whole), np.int32) for x in (a_ids, b_ids))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # all pieces one after the other: a piece's end is a common one
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[at] == ends_a
        last_b = np.zeros(len(b), bool)
        last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        before_b = np.searchsorted(group_b, np.arange(n + 1))
        upto_a = np.searchsorted(group_a, np.arange(1, n + 1))
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + before_b[group_a]] = 2 * a.astype(np.int64) + last_a
        names[np.arange(len(b)) + upto_a[group_b]] = self.b_names + 2 * b.astype(np.int64) + last_b
        cut_a, cut_b = (np.cumsum([0, *(len(x[i]) for i in whole)]) for x in (a_ids, b_ids))
        facts[whole] = np.stack([np.ones(len(whole), np.int64), np.diff(cut_a), np.diff(cut_b), np.diff(group_a[cut_a[1:] - 1], prepend=-1)], axis=1)
        cuts, said = (cut_a + cut_b).tolist(), names.tolist()
        for k, i in enumerate(whole):
            texts[i] = "".join(map(self.names.__getitem__, said[cuts[k] : cuts[k + 1]]))
        return facts, texts, b[at[last_a]].astype(np.int64) << ID_BITS | a[last_a]

    def _whole(self, pieces: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> bool:
        """Whether both sides' bytes are a blank and the text for every piece: none lost, none changed."""
        wanted = [b" " + p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes, text = list(map(len, wanted)), b"".join(wanted)
        for of, size, ids in ((self.bytes_a, self.size_a, a_ids), (self.bytes_b, self.size_b, b_ids)):
            flat = list(chain.from_iterable(ids))
            if b"".join(map(of.__getitem__, flat)) != text:
                return False
            upto = np.concatenate([[0], np.cumsum(size[flat])])
            cuts = np.cumsum([0, *map(len, ids)])
            if (np.diff(upto[cuts]) != sizes).any():
                return False
        return True


class _Known:
    """Alignments of pieces seen so far: facts, texts, and pairs one piece after the other."""

    def __init__(self, sides: _Sides):
        self.sides, self.index, self.chars = sides, {}, 0
        self.facts, self.texts = np.zeros((0, 4), np.int64), []
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece; what isn't known is aligned first."""
        if len(self.index) > KNOWN or self.chars > KNOWN_CHARS:
            self.__init__(self.sides)
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.index]
        if fresh:
            facts, texts, pairs = self.sides.align(fresh)
            for p in fresh:
                self.index[p] = len(self.index)
                self.chars += len(p)
            self.facts, self.pairs = np.concatenate([self.facts, facts]), np.concatenate([self.pairs, pairs])
            self.texts += texts
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(facts[:, 3])])
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=1)
def _known(a_path: str, b_path: str) -> _Known:
    """The worker's own, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Known(_Sides(a_path, b_path))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs given by their starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Block:
    """Documents of a block: a row each, and the sorted (pair, place) records of their links."""

    def __init__(self, known: _Known, number: int):
        self.known, self.number, self.size = known, number, 0
        self.rows: list[tuple] = []
        self.records: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str]) -> None:
        known, place = self.known, len(self.rows)
        cut = [known.sides.pieces(t) if t else [] for t in texts]
        at = known.look_up([p for pieces in cut for p in pieces])
        ends = np.cumsum([0, *map(len, cut)])
        facts = known.facts[at]
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(facts, axis=0)])
        of_text = sums[ends[1:]] - sums[ends[:-1]]
        whole = (of_text[:, 0] == np.diff(ends)) & (np.diff(ends) > 0)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        used = at[whole[owner]]
        pairs = known.pairs[_runs(known.starts[used], known.facts[used, 3])]
        self.records.append(pairs << 32 | np.repeat(place + owner[whole[owner]], known.facts[used, 3]))
        said = at.tolist()
        for i, (ok, (_, n_a, n_b, groups)) in enumerate(zip(whole.tolist(), of_text.tolist(), strict=True)):
            text = "".join(map(known.texts.__getitem__, said[ends[i] : ends[i + 1]])) if ok else ""
            self.rows.append((place + i, ids[i], n_a, n_b, groups, groups, hashlib.sha256(text[:-1].encode()).hexdigest()) if ok else (place + i, ids[i], 0, 0, 0, 0, ""))
        self.size += sum(map(len, texts))

    def written(self, buckets: int) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*self.rows, strict=True))
        n = len(self.rows)
        yield _batch(n, kind=["doc"] * n, block=[self.number] * n, **dict(zip(("place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True)))
        if not self.records:
            return
        keys, counts = np.unique(np.concatenate(self.records), return_counts=True)
        bucket = (keys >> (32 + ID_BITS)) & (buckets - 1)
        order = np.argsort(bucket.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        made = [(k, _run(keys[own := order[x:y]] >> 32, (keys[own] & 0xFFFFFFFF).astype(np.uint32), counts[own].astype(np.uint32))) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        yield _batch(len(made), kind=["run"] * len(made), block=[self.number] * len(made), bucket=[k for k, _ in made], body=[x for _, x in made])


_SCHEMA = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in _WRITTEN.split(", "))])


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _run(pairs: np.ndarray, *rest: np.ndarray) -> bytes:
    """A zstd run: frames of at most ``FRAME`` records in order of the pair, each behind its length."""
    out = []
    for at in range(0, len(pairs), FRAME):
        part = pairs[at : at + FRAME]
        body = pack(part[:1].astype(np.int64), gaps(part - part[0]).astype(np.uint32), *(x[at : at + FRAME] for x in rest))
        out += [len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def _frames(run: bytes) -> Iterator[list[np.ndarray]]:
    """The frames of a run: pairs, and what stands beside them."""
    at = 0
    while at < len(run):
        size = int.from_bytes(run[at : at + 4], "little")
        first, steps, *rest = unpack(run[at + 4 : at + 4 + size])
        yield [first[0] + np.cumsum(steps, dtype=np.int64), *rest]
        at += 4 + size


def _merge(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of all runs in order, and the sums of their last columns: a heap merge that holds one frame a run.

    One heap has each run's next pair, the other the last pair of its frame. All that is not above the least of the
    last pairs is complete, and is summed at once.
    """
    sources = [_frames(r) for r in runs]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heads: list[tuple[int, int]] = []
    lasts: list[tuple[int, int]] = []

    def load(k: int) -> bool:
        frame = next(sources[k], None)
        if frame is None:
            held.pop(k, None)
            return False
        held[k] = frame[0], frame[-1].astype(np.int64)
        heapq.heappush(lasts, (int(frame[0][-1]), k))
        return True

    for k in range(len(runs)):
        if load(k):
            heapq.heappush(heads, (int(held[k][0][0]), k))
    while heads:
        bound = lasts[0][0]
        parts = []
        while heads and heads[0][0] <= bound:
            _, k = heapq.heappop(heads)
            pairs, counts = held[k]
            to = int(np.searchsorted(pairs, bound, "right"))
            parts.append((pairs[:to], counts[:to]))
            if to < len(pairs):
                held[k] = pairs[to:], counts[to:]
            elif not load(k):
                continue
            heapq.heappush(heads, (int(held[k][0][0]), k))
        while lasts and lasts[0][0] <= bound:
            heapq.heappop(lasts)
        pairs, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        starts = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
        yield pairs[starts], np.add.reduceat(counts, starts)


def _bests(merged: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs, counts, and whether a count is the highest of its side-B id; pairs come B-major, so only the last id is held back."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def told():
        starts = np.flatnonzero(np.diff(pairs >> ID_BITS, prepend=-1))
        most = np.repeat(np.maximum.reduceat(counts, starts), np.diff([*starts, len(pairs)]))
        return starts, counts == most

    for more, n in merged:
        pairs, counts = np.concatenate([pairs, more]), np.concatenate([counts, n])
        starts, best = told()
        if to := int(starts[-1]):
            yield pairs[:to], counts[:to], best[:to]
            pairs, counts = pairs[to:], counts[to:]
    if len(pairs):
        yield pairs, counts, told()[1]


def _joined(parts: Iterator[tuple[np.ndarray, ...]]) -> bytes:
    return b"".join(_run(*p) for p in parts)


def _summed(table: pa.Table) -> pa.Table:
    body = _joined(_merge(table.column("body").to_pylist()))
    return pa.table({"bucket": table.column("bucket")[:1], "part": table.column("part")[:1], "body": pa.array([body], pa.binary())})


def _ranked(table: pa.Table) -> pa.Table:
    body = _joined((p, n, b.astype(np.uint8)) for p, n, b in _bests(_merge(table.column("body").to_pylist())))
    return pa.table({"bucket": table.column("bucket")[:1], "body": pa.array([body], pa.binary())})


def _returned(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the links of a run add to each of its block's documents: run after run against the bucket's counts."""
    blocks, bodies = [], []
    if runs.num_rows:
        frames = [f for c in counts.column("body").to_pylist() for f in _frames(c)]
        pairs, n, best = (np.concatenate([f[i] for f in frames]) for i in range(3))
        for block, body in zip(runs.column("block").to_pylist(), runs.column("body").to_pylist(), strict=True):
            own = [np.concatenate(x) for x in zip(*_frames(body), strict=True)]
            at = np.searchsorted(pairs, own[0])
            times = own[2].astype(np.int64)
            blocks.append(block)
            bodies.append(pack(*_by_place(own[1].astype(np.int64), times * best[at], times * n[at])))
    return pa.table({"block": pa.array(blocks, pa.int64()), "body": pa.array(bodies, pa.binary())})


def _by_place(place: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    return [place[starts], *(np.add.reduceat(v[order], starts) for v in values)]


def _added(table: pa.Table) -> pa.Table:
    parts = [unpack(b) for b in table.column("body").to_pylist()]
    place, best, total = _by_place(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
    return pa.table({"block": pa.array(np.full(len(place), table.column("block")[0].as_py())), "place": pa.array(place.astype(np.int32)), "n_best": pa.array(best), "count_sum": pa.array(total)})


def _part(parts: list[int]) -> Column:
    """Which of its bucket's tasks takes a block's run."""
    return F.pmod(F.xxhash64("block"), F.element_at(F.lit(parts), F.col("bucket") + 1)).cast("int")


def _encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text: str) -> tuple[DataFrame, str]:
    most, buckets = BLOCK_BYTES, BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = _known(a_path, b_path), TaskContext.get().partitionId() << 24
        block = _Block(known, number)
        for batch in batches:
            ids, texts, size, begin = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= most // 16 or i - begin >= 255 or i + 1 == len(texts):
                    block.add(ids[begin : i + 1], texts[begin : i + 1])
                    size, begin = 0, i + 1
                    if block.size >= most:
                        yield from block.written(buckets)
                        number += 1
                        block = _Block(known, number)
        if block.rows:
            yield from block.written(buckets)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return durable(own.mapInArrow(run, _WRITTEN), partition_by=("kind",))


def _counted(runs: DataFrame) -> tuple[DataFrame, str, list[int]]:
    """``bucket, body``: each bucket's pairs with their corpus-wide counts and bests; its path; the tasks of each bucket's runs."""
    sizes = dict(runs.groupBy("bucket").agg(F.sum(F.octet_length("body"))).collect())  # a row a bucket
    parts = at = [max(1, -(-int(sizes.get(k, 0)) // TASK_BYTES)) for k in range(BUCKETS)]
    level = runs.select("bucket", _part(parts).alias("part"), "body")
    while max(at) > 1:
        level = level.groupBy("bucket", "part").applyInArrow(_summed, "bucket int, part int, body binary")
        at = [-(-n // FAN) for n in at]
        level = level.withColumn("part", F.col("part") % F.element_at(F.lit(at), F.col("bucket") + 1))
    counts, path = durable(level.groupBy("bucket").applyInArrow(_ranked, "bucket int, body binary"))
    return counts, path, parts


def pair_counts(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b, n, best``: in how many links of the corpus each pair of ids is, and whether that is the most of its side-B id."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                for pairs, n, best in _frames(body):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs & ((1 << ID_BITS) - 1)), pa.array(pairs >> ID_BITS), pa.array(n.astype(np.int64)), pa.array(best.astype(bool))], ["a", "b", "n", "best"])

    table, path = _encoded(docs, a_path, b_path, id_col, text)
    counts, _, _ = _counted(table.where("kind = 'run'"))
    discard(docs.sparkSession, path)
    return counts.select("body").mapInArrow(opened, "a long, b long, n long, best boolean")


def align(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: how two tokenizers cut a blank and the text, and how usual the id pairs that end together are.

    Ids are ``doc_id``; groups are cut where tokens of both sides end, and each group's last two tokens are a link.
    ``n_best`` counts links whose pair is the most frequent one of its side-B id in the corpus, ties included;
    ``count_sum`` sums the pairs' counts over the links.

    Texts are cut at single blanks, which no token of either side goes over, and each piece is aligned once a worker as
    long as it is remembered. A text is whole if all its pieces are. Every block of documents writes its (pair, document) records once, sorted and radix-partitioned by the low bits of
    the side-B id, as zstd runs. A bucket's runs are dealt to tasks of bounded size by block, counted there by heap
    merges, and those counts merged again, at most ``FAN`` at once, until each bucket has one list in B-major order,
    which gives the maxima. The lists, bounded by the two vocabularies, go back to the tasks that have the runs, and
    what these add to each document returns to its block. An id with a third of all records spreads over its tasks.

    Null and empty texts, and texts whose bytes a side doesn't give back, have zeros and an empty hash, and add no
    records. Null and repeated ids are rows of their own. Other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table, table_path = _encoded(docs, a_path, b_path, id_col, text)
    runs = table.where("kind = 'run'").select("block", "bucket", "body")
    counts, counts_path, parts = _counted(runs)
    dealt = runs.withColumn("part", _part(parts))
    spread = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(F.lit(parts), F.col("bucket") + 1) - 1)))
    sent = dealt.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part")).applyInArrow(_returned, "block long, body binary")
    sums, sums_path = durable(sent.groupBy("block").applyInArrow(_added, "block long, place int, n_best long, count_sum long"))
    rows = table.where("kind = 'doc'").join(sums, ["block", "place"], "left")
    result, _ = durable(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"))
    discard(spark, table_path, counts_path, sums_path)
    return result


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, a_path=tokenizer_path(TOKENIZER_A), b_path=tokenizer_path(TOKENIZER_B))
