"""Media columns: texts as 8-bit audio, and features of the stored audio as fixed-shape tensors with time spans."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.tables import durable, whole_text

BLOCK = 64
SOURCE_RATE = 12_000
RATE = 8_000
FRAME, HOP, MELS = 256, 128, 16
#: Frames of one tensor, and so its fixed shape with ``MELS``.
PATCH = 64
#: Input samples of one step: a long recording is read in steps and never held whole as numbers.
STEP = 1 << 18
#: Energy in dB of full scale at which a segment begins, and below which it ends.
BEGIN_DB, END_DB = -12.0, -15.0


def payload(text: str = "text") -> Column:
    """UTF-8 bytes and zeros up to a positive multiple of ``BLOCK``."""
    raw = F.encode(whole_text(text), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / BLOCK)) * BLOCK
    return F.rpad(raw, size.cast("int"), F.lit(b"\0"))


def wav(samples: Column, rate: int = SOURCE_RATE) -> Column:
    """A mono WAV file of unsigned 8-bit samples."""

    def u32(x: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))

    size = F.octet_length(samples).cast("long")
    fixed = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data")
    return F.concat(F.lit(b"RIFF"), u32(size + 36), F.lit(b"WAVE"), F.lit(fixed), u32(size), samples)


def read_wav(media: bytes) -> tuple[int, memoryview]:
    """Sample rate and samples of a mono 8-bit WAV file."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


@lru_cache
def _polyphase(up: int, down: int, taps: int = 12) -> np.ndarray:
    """A windowed-sinc low-pass filter, one row of taps for each output phase, newest sample first."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * np.hamming(len(n)) * up
    rows = np.array([h[p::up] for p in range(up)])
    return (rows / rows.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, begin: int, end: int, up: int, down: int) -> np.ndarray:
    """Output samples [begin, end) of the polyphase filter over unsigned 8-bit ``samples``; silence lies beyond."""
    filters = _polyphase(up, down)
    taps = filters.shape[1]
    out = np.zeros(end - begin, np.float32)
    low, high = begin * down // up - taps + 1, (end - 1) * down // up + 1
    x = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(samples))
    if b > a:
        x[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    for first in range(begin, min(begin + up, end)):
        at, phase = first * down // up, first * down % up
        count = (end - first + up - 1) // up
        windows = np.lib.stride_tricks.sliding_window_view(x, taps)[at - taps + 1 - low :: down][:count]
        out[first - begin :: up] = windows @ filters[phase][::-1].copy()
    return out


@lru_cache
def _mel_bank(rate: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1) * FRAME / rate
    bins = np.arange(FRAME // 2 + 1)
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray, source_rate: int, rate: int = RATE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-mel rows and energies in dB of overlapping frames, some frames at a time; at least one frame."""
    common = int(np.gcd(source_rate, rate))
    up, down = rate // common, source_rate // common
    length = max(1, -(-len(samples) * up // down))
    frames = 1 + max(0, -(-(length - FRAME) // HOP))
    window, bank = np.hanning(FRAME).astype(np.float32), _mel_bank(rate)
    step = max(1, STEP // HOP)
    for f in range(0, frames, step):
        g = min(frames, f + step)
        x = resample(samples, f * HOP, (g - 1) * HOP + FRAME, up, down)
        rows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(rows * window, axis=1)).astype(np.float32) ** 2
        energy = 10 * np.log10((rows**2).mean(1) + 1e-9)
        yield np.log(power @ bank + 1e-6).astype(np.float32), energy


def segments(energies: Iterator[np.ndarray]) -> list[tuple[int, int]]:
    """Frame spans [first, last) that begin at ``BEGIN_DB`` and last until the energy falls below ``END_DB``."""
    energy = np.concatenate(list(energies))
    state = np.where(energy >= BEGIN_DB, 1, np.where(energy < END_DB, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[known], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensor_table(mel: np.ndarray, rate: int = RATE) -> pa.RecordBatch:
    """Log-mel patches as a fixed-shape tensor column with their spans in seconds; the last is filled with silence."""
    count = -(-len(mel) // PATCH)
    full = np.full((count * PATCH, MELS), np.float32(np.log(1e-6)))
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "mel"))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), PATCH * MELS)
    first = np.arange(count) * PATCH
    start, end = first * HOP / rate, ((np.minimum(first + PATCH, len(mel)) - 1) * HOP + FRAME) / rate
    return pa.record_batch([pa.ExtensionArray.from_storage(kind, storage), pa.array(start), pa.array(end)], ["log_mel", "start_s", "end_s"])


def tensors_to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_from_bytes(body: bytes) -> pa.Table:
    """The tensor column and time spans that ``audio_features`` stored."""
    return pa.ipc.open_stream(body).read_all()


def stored_features(body: bytes | pa.Buffer) -> tuple[int, list[float]]:
    """Frames and mean log-mel row of stored tensors; the silence after the last span's end isn't counted."""
    table = tensors_from_bytes(body)
    frames = round((table.column("end_s")[-1].as_py() * RATE - FRAME) / HOP) + 1
    mel = table.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, MELS)
    return frames, mel[:frames].mean(0, dtype=np.float64).astype(np.float32).tolist()


def read_tensors(stored: DataFrame) -> DataFrame:
    """``stored`` with ``stored_frames`` and ``stored_log_mel`` of its ``tensors`` in place of them; null where there are none."""
    rest = stored.drop("stored_frames", "stored_log_mel")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "tensors"), "stored_frames long, stored_log_mel array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stored_features(body.as_buffer()) if body.is_valid else (None, None) for body in batch.column("tensors")]
            own = [n for n in batch.schema.names if n != "tensors"]
            made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *made], [*own, "stored_frames", "stored_log_mel"])

    return rest.mapInArrow(run, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, segments array<struct<start_s:double,end_s:double>>, mean_log_mel array<float>, tensors binary"


def _features_of(media: bytes, keep: bool) -> tuple:
    rate, view = read_wav(media)
    samples = np.frombuffer(view, np.uint8)
    parts, energies = [], []
    total, n = np.zeros(MELS), 0
    for mel, energy in log_mel(samples, rate):
        energies.append(energy)
        total += mel.sum(0, dtype=np.float64)
        n += len(mel)
        if keep:
            parts.append(mel)
    spans = [(a * HOP / RATE, ((b - 1) * HOP + FRAME) / RATE) for a, b in segments(iter(energies))]
    body = tensors_to_bytes(tensor_table(np.concatenate(parts))) if keep else None
    return len(samples), hashlib.sha256(view).hexdigest(), zlib.crc32(view[-BLOCK:]), n, [{"start_s": a, "end_s": b} for a, b in spans], (total / n).astype(np.float32).tolist(), body


def audio_features(media: DataFrame, *, column: str = "media", keep_tensors: bool = True) -> DataFrame:
    """``media`` with what its stored audio says: payload digests, frames, energy segments and log-mel tensors.

    ``tensors`` is an Arrow stream of fixed-shape (``PATCH``, ``MELS``) tensors with their time spans; see
    ``tensors_from_bytes``. Rows are independent: repeated rows give equal features, a null recording gives nulls.
    Features of the names in ``FEATURES`` replace columns of those names.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")]
    rest = media.drop(*names)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema if f.name != column or keep_tensors)}, {FEATURES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = [_features_of(m.as_buffer(), keep_tensors) if m.is_valid else (None,) * len(names) for m in part.column(column)]
                kinds = kinds or [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.list_(pa.float32()), pa.binary()]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                own = [n for n in part.schema.names if n != column or keep_tensors]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in own), *made], [*own, *names])

    return rest.mapInArrow(run, schema)


def op2_media_features(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), wav(payload()).alias("media"))
    stored = docs.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    tensors, _ = durable(audio_features(stored).drop("media", "mean_log_mel", "n_frames"))
    found = read_tensors(tensors)
    mels = F.array_join(F.transform("stored_log_mel", lambda x: F.format_string("%.3f", x)), ",")
    spans = F.array_join(F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"])), ",")
    feature = F.concat(F.lit("frames="), F.col("stored_frames").cast("string"), F.lit(";mel="), mels, F.lit(";segments="), spans)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
