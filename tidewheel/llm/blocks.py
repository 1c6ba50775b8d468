"""Work on blocks of documents: packing arrays into shuffled bytes, and lookups that return to the block that asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import words

_HEAD = np.dtype([("kind", "S4"), ("length", "<i8"), ("bytes", "<i8")])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the first bytes of all values, then the second, and so on, so that small or sorted values compress."""
    parts = []
    press = zstandard.ZstdCompressor(level=1)
    for x in arrays:
        x = np.ascontiguousarray(x)
        body = press.compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
        parts.append(np.array([(x.dtype.str[1:].encode(), len(x), len(body))], _HEAD).tobytes() + body)
    return b"".join(parts)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    press = zstandard.ZstdDecompressor()
    while at < len(body):
        kind, length, size = np.frombuffer(body, _HEAD, 1, at)[0]
        at += _HEAD.itemsize
        dtype = np.dtype("<" + kind.decode())
        raw = press.decompress(body[at : at + int(size)], max_output_size=max(1, int(length) * dtype.itemsize))
        out.append(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).reshape(-1) if length else np.zeros(0, dtype))
        at += int(size)
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def in_blocks(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """``docs`` in blocks of about ``most`` bytes of text: ``block`` and its rows, packed and compressed.

    A block is made where its rows are read, and is what the lookups below shuffle; ``open_block`` gives its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 24, [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                for part in held:
                    writer.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])

        for batch in batches:
            for part in words.slices(batch, text, most):
                # a copy, so that the block doesn't hold on to the whole batch
                held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema))
                size += part.column(text).nbytes
                if size >= most:
                    yield packed()
                    block, held, size = block + 1, [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "block long, body binary")


def open_block(table: pa.Table) -> tuple[int, pa.Table]:
    return table.column("block")[0].as_py(), pa.ipc.open_stream(table.column("body")[0].as_buffer()).read_all()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash; it rises with the hash, so sorted keys fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run of equal values."""
    if not len(sorted_buckets):
        return []
    cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
    at = [0, *cuts.tolist(), len(sorted_buckets)]
    return [(int(sorted_buckets[a]), a, b) for a, b in zip(at, at[1:], strict=False)]


def ask(blocks: DataFrame, send: Callable, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """A lookup of every block's keys in statistics over all blocks, returned to the block.

    ``send(rows)`` gives (bucket, bytes) of a block's keys; ``answer(list of bytes)`` gets what all blocks sent to a
    bucket and gives a reply to each; ``finish(block, rows, [(bucket, reply)])`` goes on. Blocks are shuffled once
    and read twice; keys and replies move as packed arrays, at most once for each block.
    """

    def sent(table: pa.Table) -> pa.Table:
        block, rows = open_block(table)
        made = list(send(rows))
        return pa.table({"bucket": pa.array([b for b, _ in made], pa.int64()), "block": pa.array([block] * len(made), pa.int64()), "body": pa.array([x for _, x in made], pa.binary())})

    def answered(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        replies = answer(table.column("body").to_pylist())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "body": pa.array(replies, pa.binary())})

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        return finish(*open_block(left), list(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True)))

    questions = blocks.groupBy("block").applyInArrow(sent, "bucket long, block long, body binary")
    replies = questions.groupBy("bucket").applyInArrow(answered, "block long, bucket long, body binary")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finished, schema)
