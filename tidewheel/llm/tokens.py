"""Token counts of whole texts, with overlapping chunks of huge documents spliced where they provably agree."""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.tables import whole_text

TOKENIZER = "byte_bpe_50k.json"
#: Documents of more characters are encoded in chunks.
HUGE = 1 << 15
CHUNK, OVERLAP = 1 << 14, 256
#: Pieces of texts, and characters of them, after which a worker starts to remember anew.
KNOWN, KNOWN_CHARS = 1 << 19, 16 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Characters that every version of Unicode counts as letters, digits or neither.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT = "0-9"
_OTHER = r'!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\u3001\u3002\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f'
#: A single blank.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_STABLE = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=[{_LETTER}])(?=[{_DIGIT}{_OTHER}'])|(?<=[{_DIGIT}])(?=[{_LETTER}{_OTHER}'])|(?<=[{_OTHER}])(?=[{_LETTER}{_DIGIT}])")


def stable(text: str, p: int) -> bool:
    """Whether every reading that sees the characters around ``p`` splits there, whatever came before.

    No class of characters that the byte-level pre-tokenizer matches has white space behind anything else, or two of
    letters, digits and others in it, but for an apostrophe before letters. So a piece always begins at white space
    behind another character and where such a class changes, and merges never cross pieces. Only an added token
    can go over such a place; both readings see all of it if they see its length on both sides.
    """
    return _STABLE.match(text, p) is not None


def _starts(tokenizer, text: str, a: int, b: int) -> list[int]:
    return [a + s for s, _ in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]


def _cuts(text: str, chunk: int, overlap: int, margin: int) -> list[tuple[int, int]]:
    """Where each next chunk begins, and the first stable position that both it and the one before it see well."""
    cuts, begin = [], 0
    while found := _STABLE.search(text, begin + chunk + margin):
        begin = max(begin + chunk, found.start() - max(overlap, margin))
        cuts.append((begin, found.start()))
    return cuts


def count_in_chunks(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from encodings of overlapping chunks.

    Neighbours are spliced at a position in their overlap where both have a token start and the text is
    ``stable``; the overlap reaches to such a position, however far it is. Where the encodings don't agree there, the
    left chunk is encoded again up to a later one, over one more chunk at first and then twice as many each time, so
    that all encodings together stay in proportion to the text.
    """
    margin = max([1, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    cuts = _cuts(text, chunk, overlap, margin)

    def seen(k: int) -> int:
        return min(len(text), cuts[k][1] + max(overlap, margin)) if k < len(cuts) else len(text)

    total, left, done, k, wide = 0, 0, 0, 0, 1
    current = _starts(tokenizer, text, left, seen(0))
    while k < len(cuts):
        begin, p = cuts[k]
        following = _starts(tokenizer, text, begin, seen(k + 1))
        at = _common(text, current, following, max(p, done), max(p, seen(k) - margin) + 1)
        if at is None:
            k, wide = k + wide, 2 * wide
            current = _starts(tokenizer, text, left, seen(k))
            continue
        total += bisect_left(current, at) - bisect_left(current, done)
        left, current, done, k, wide = begin, following, at, k + 1, 1
    return total + len(current) - bisect_left(current, done)


def _common(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """The first stable position in [low, high) at which a token of both encodings starts."""
    i, j = bisect_left(left, low), bisect_left(right, low)
    while i < len(left) and j < len(right) and left[i] < high and right[j] < high:
        if left[i] == right[j]:
            if stable(text, left[i]):
                return left[i]
            i, j = i + 1, j + 1
        elif left[i] < right[j]:
            i += 1
        else:
            j += 1
    return None


class _Counts:
    """Token counts of whole texts from those of their pieces between single blanks, of which most were seen before.

    A blank between two other characters is ``stable`` and goes with what follows, so a piece has the same tokens alone
    as in its text. A text with the string of an added token, which may reach over blanks, is one piece.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.chars = tokenizer, {}, 0
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.cuttable = tokenizer.normalizer is None

    def pieces(self, text: str) -> tuple[list, set]:
        """Keys of a text's pieces, and those not known: a string comes behind a blank and has no white space at its ends; others are pairs of what comes before and the piece."""
        if not self.cuttable or any(t in text for t in self.added):
            keys = [("", text)]
            return keys, set(keys).difference(self.known)
        # known strings were looked at before, so only fresh ones can show a blank beside other white space
        first, *keys = text.split(" ")
        fresh = set(keys).difference(self.known)
        if keys and (not first or first[-1].isspace() or any(not _clean(p) for p in fresh)):
            first, *rest = _BLANK.split(text)
            keys = [p if _clean(p) else (" ", p) for p in rest]
            fresh = set(keys).difference(self.known)
        keys.append(("", first))
        if keys[-1] not in self.known:
            fresh.add(keys[-1])
        return keys, fresh

    def of(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN or self.chars > KNOWN_CHARS:
            self.known, self.chars = {}, 0
        cut = [self.pieces(t) for t in texts]
        fresh = list(set().union(*(f for _, f in cut)))
        strings = [f" {p}" if isinstance(p, str) else "".join(p) for p in fresh]
        self.known.update(zip(fresh, map(len, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)), strict=True))
        self.chars += sum(map(len, strings))
        return [sum(map(self.known.__getitem__, keys)) for keys, _ in cut]


def _clean(piece: str) -> bool:
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


@lru_cache(maxsize=1)
def _counts(path: str) -> _Counts:
    """The worker's own, kept from task to task."""
    return _Counts(load_tokenizer(path))


def count_tokens(docs: DataFrame, *, path: str, text: str = "text", huge: int = HUGE) -> DataFrame:
    """``docs`` with ``n_tokens`` in place of ``text``, as the library counts them without begin, end or padding.

    Null texts count as empty, an empty text has 0 tokens; rows are independent. A column named ``n_tokens`` is
    replaced, others stay.
    """
    rest = docs.drop("n_tokens")
    own = [f for f in rest.schema if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(text).to_pylist()]
                counts = np.zeros(len(texts), np.int64)
                short = [i for i, t in enumerate(texts) if len(t) <= huge]
                counts[short] = known.of([texts[i] for i in short])
                for i, t in enumerate(texts):
                    if len(t) > huge:
                        counts[i] = count_in_chunks(known.tokenizer, t)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in own), pa.array(counts)], [*(f.name for f in own), "n_tokens"])

    return rest.mapInArrow(run, schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), "text")
    return count_tokens(docs, path=tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
