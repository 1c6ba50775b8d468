"""Benchmark decontamination: one automaton over normalised test items, one scan of each text, offsets of the original."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of bytes of a-z, 0-9 and all beyond ASCII, once A-Z are a-z.
_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TABLE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c + 32
_TABLE = bytes(_TABLE)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

WIDTH = 10
#: The automaton holds fragments of so many words, one at every so many words of an item: each window has one of them whole.
FRAGMENT, EVERY = 4, 7
#: Bytes of test items in one index, which takes about 20 times as much memory; a larger benchmark is scanned for in shards.
SHARD_BYTES = 32 << 20


def normalised(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Index:
    """The items' words as numbers, an automaton over fragments of them, and their windows by hash.

    A word is three letters of the automaton's text, of three alphabets, so that words only match as wholes.
    """

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        self.short: list[tuple[int, list[int]]] = []
        number = self.vocabulary.setdefault
        parts, starts, owners, at, patterns, short = [], [], [], 0, set(), {}
        for name, text in items:
            own = np.array([number(w, len(self.vocabulary) + 1) for w in normalised(text)], np.int64)
            if not len(own):
                continue
            self.names.append(name)
            owner = len(self.names) - 1
            if len(own) < WIDTH:
                short.setdefault(own.tobytes(), (own, []))[1].append(owner)
                continue
            patterns.update(own[i : i + FRAGMENT].tobytes() for i in range(0, len(own) - FRAGMENT + 1, EVERY))
            parts.append(own)
            starts.append(np.arange(at, at + len(own) - WIDTH + 1))
            owners.append(np.full(len(own) - WIDTH + 1, owner))
            at += len(own)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        start, owner = (np.concatenate(starts), np.concatenate(owners)) if parts else (np.zeros(0, np.int64),) * 2
        hashes = self._hashes(self.words, start)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.start, self.owner = hashes[order], start[order], owner[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern in patterns:
            self.automaton.add_word(self._letters(np.frombuffer(pattern, np.int64)), 0)
        for own, ids in short.values():
            self.short.append((len(own), ids))
            word = self._letters(own)
            # a short item may be a fragment too: bit 0 tells that it is not one
            self.automaton.add_word(word, 2 * len(self.short) + (own.tobytes() not in patterns))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _hashes(words: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for k in range(WIDTH):
            out = (out + words[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    @staticmethod
    def _letters(numbers: np.ndarray) -> str:
        return np.stack([numbers & 255, (numbers >> 8 & 255) + 256, (numbers >> 16) + 512], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans [first, last) of words inside occurring windows, joined where they overlap or touch, and the items."""
        if not len(self.automaton) or not words:
            return [], set()
        text = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        found = list(self.automaton.iter(self._letters(text)))
        if not found:
            return [], set()
        edge, items, fragments = np.zeros(len(words) + 1, np.int64), set(), []
        for end, value in found:
            last = end // 3 + 1
            if value > 1:
                n, ids = self.short[(value >> 1) - 1]
                edge[last - n] += 1
                edge[last] -= 1
                items.update(ids)
            if not value & 1:
                fragments.append(last - FRAGMENT)
        if fragments:
            begin = np.unique((np.array(fragments)[:, None] - np.arange(WIDTH - FRAGMENT + 1)).ravel())
            begin = begin[(begin >= 0) & (begin + WIDTH <= len(words))]
            hashes = self._hashes(text, begin)
            low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
            for k in np.flatnonzero(high > low).tolist():
                at = self.start[low[k] : high[k]]
                same = (self.words[at[:, None] + np.arange(WIDTH)] == text[begin[k] : begin[k] + WIDTH]).all(axis=1)
                if same.any():
                    edge[begin[k]] += 1
                    edge[begin[k] + WIDTH] -= 1
                    items.update(self.owner[low[k] : high[k]][same].tolist())
        inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        turns = np.flatnonzero(np.diff(inside.astype(np.int8)))
        return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), {self.names[i] for i in items}


_built: dict[str, _Index] = {}


def _index(key: str, items) -> _Index:
    """The index of a shard, built once in each worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = _Index(items.value)
    return _built[key]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points of the text as it was."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text or "")]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("text",), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``spans`` (code points, ends exclusive).

    A window is ``WIDTH`` consecutive words of an item text, or all words of a shorter one. Each worker builds one
    automaton over fragments of the items, of which every window has one, and scans each text once; the windows
    around a fragment are then looked up whole, so nothing is shuffled. The items are collected in shards of a checked
    number of bytes: a benchmark of up to ``shard_bytes`` is one, a larger one takes a pass of the texts for each.
    Null and empty texts have no words and no hits; repeated rows are scanned alike, repeated items count once, an
    empty benchmark hits nothing. Items with a null id hit words and count as one item without a name, listed first
    as null. Columns of the added names are replaced.
    """
    added = ["n_words", "n_hit", "items", "spans", "_words"]
    pieces = F.explode(F.array(*[F.col(c) for c in item_texts]))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), pieces.alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_bytes))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    out = docs.drop(*added)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    schema = f"{own}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    state = f"{schema}, _words array<struct<start:long,end:long>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    for shard in range(shards):
        rows = [tuple(r) for r in items.where(F.col("shard") == shard).select("item", "text").distinct().collect()]
        sent, key, final = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex, shard == shards - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key, first=shard == 0, final=final) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent)
            for whole in batches:
                for at in range(0, len(whole), 512):
                    batch = whole.slice(at, 512)
                    texts, cols = batch.column(text).to_pylist(), [[], [], [], [], []]
                    before = [[]] * len(texts) if first else batch.column("_words").to_pylist()
                    known = [[]] * len(texts) if first else batch.column("items").to_pylist()
                    for body, spans, ids in zip(texts, before, known, strict=True):
                        words = normalised(body)
                        new, more = index.scan(words)
                        spans = _merge([(s["start"], s["end"]) for s in spans] + new) if spans else new
                        struct = [{"start": a, "end": b} for a, b in spans]
                        chars = [{"start": a, "end": b} for a, b in original_spans(body, spans)] if final else []
                        for c, x in zip(cols, (len(words), sum(b - a for a, b in spans), sorted({*ids, *more}, key=lambda i: (i is not None, i)), chars, struct), strict=True):
                            c.append(x)
                    made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.string()), span, span), strict=True)]
                    names = [n for n in batch.schema.names if n not in added]
                    count = 4 if final else 5
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made[:count]], [*names, *added[:count]])

        out = out.mapInArrow(run, schema if final else state)
    return out


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.win = win.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
