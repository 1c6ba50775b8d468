import hashlib
import zlib

import numpy as np
import pytest
from fixtures import documents

from tidewheel.llm import media
from tidewheel.llm.tables import durable


def test_round_trip(spark, tmp_path):
    rows = documents(spark, tmp_path, [(200, "é" * 32, "en", "s", 1), (201, "x" * 64, "en", "s", 1), (202, "x" * 65, "en", "s", 1), (203, "x" * 64, "en", "s", 1)])
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.op2_media_features(spark, str(tmp_path)).collect()}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        r = got[doc, len(raw)]
        body = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(body) + 44)
    assert got[201, 64]["feature"] == got[203, 64]["feature"] and got[201, 64]["media_sha256"] == got[203, 64]["media_sha256"]


def test_wav_is_readable_elsewhere(spark, tmp_path):
    import io
    import wave

    df = spark.createDataFrame([("hello",)], "text string")
    body = bytes(df.select(media.wav(media.payload()).alias("m")).first()["m"])
    with wave.open(io.BytesIO(body)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.SOURCE_RATE)
        assert w.readframes(w.getnframes()) == b"hello" + b"\0" * 59


def direct(samples, up, down):
    """Resampling by the definition: zeros between samples, one long filter, every ``down``-th value."""
    rows = media._polyphase(up, down)
    h = np.zeros(rows.size)
    for p in range(up):
        h[p::up] = rows[p]
    x = np.zeros(len(samples) * up)
    x[::up] = (samples.astype(float) - 128) / 128
    return np.convolve(x, h)[::down]


@pytest.mark.parametrize("up,down", [(2, 3), (1, 2), (3, 2), (1, 1)])
def test_resampling(up, down):
    samples = np.random.default_rng(1).integers(0, 256, 999).astype(np.uint8)
    n = 999 * up // down
    assert np.allclose(media.resample(samples, 0, n, up, down), direct(samples, up, down)[:n], atol=1e-5)
    parts = [media.resample(samples, a, min(a + 37, n), up, down) for a in range(0, n, 37)]
    assert np.allclose(np.concatenate(parts), direct(samples, up, down)[:n], atol=1e-5)


def test_steps_change_nothing(monkeypatch):
    samples = np.random.default_rng(2).integers(0, 256, 20_000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*media.log_mel(samples, 12_000), strict=True)]
    monkeypatch.setattr(media, "STEP", 700)
    parts = [np.concatenate(x) for x in zip(*media.log_mel(samples, 12_000), strict=True)]
    assert np.allclose(whole[0], parts[0], atol=1e-4) and np.allclose(whole[1], parts[1], atol=1e-4)


def test_hysteresis():
    energy = np.array([-30, -13, -11, -14, -14, -16, -13, -12, -20, -11.0])
    on, want = False, []
    for e in energy:
        on = e >= media.BEGIN_DB or (on and e >= media.END_DB)
        want.append(on)
    spans = media.segments(iter([energy[:4], energy[4:]]))
    assert [any(a <= i < b for a, b in spans) for i in range(len(energy))] == want


def test_tensors(spark):
    df = spark.createDataFrame([(1, "speech " * 3000, "mine"), (2, None, "x")], "doc_id long, text string, segments string").select("doc_id", "segments", media.wav(media.payload()).alias("media"))
    found = media.audio_features(df)
    row = found.where("doc_id = 1").first()
    table = media.tensors_from_bytes(bytes(row["tensors"]))
    assert table.column("log_mel").combine_chunks().to_numpy_ndarray().shape == (-(-row["n_frames"] // media.PATCH), media.PATCH, media.MELS)
    assert table.column("start_s")[1].as_py() == media.PATCH * media.HOP / media.RATE
    assert media.audio_features(df.limit(0)).count() == 0
    null = media.audio_features(df.selectExpr("doc_id", "cast(null AS binary) AS media")).first()
    assert null["n_frames"] is None


def test_query_reads_stored_tensors(spark, tmp_path, monkeypatch):
    """The query's table holds every document's tensors, and its feature is what they say."""
    documents(spark, tmp_path)
    tables = []
    monkeypatch.setattr(media, "durable", lambda df: tables.append(durable(df)) or tables[-1])
    got = media.op2_media_features(spark, str(tmp_path)).collect()
    stored = tables[0][0].select("doc_id", "payload_sha256", "tensors").collect()
    assert len(got) == len(stored) and all(r["tensors"] is not None for r in stored)
    of = {(r["doc_id"], r["payload_sha256"]): media.stored_features(bytes(r["tensors"])) for r in stored}
    plain = media.audio_features(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", media.wav(media.payload()).alias("media")), keep_tensors=False)
    for r in plain.collect():
        frames, mel = of[r["doc_id"], r["payload_sha256"]]
        assert frames == r["n_frames"] and np.allclose(mel, r["mean_log_mel"], atol=1e-5)
    for r in got:
        frames, mel = of[r["doc_id"], r["payload_sha256"]]
        assert r["feature"].startswith(f"frames={frames};mel=" + ",".join(f"{m:.3f}" for m in mel)[:20])
    nothing = spark.createDataFrame([(1, None)], "doc_id long, tensors binary")
    assert media.read_tensors(nothing).first()["stored_frames"] is None


def test_log_mel_by_the_definition():
    """Frames of 256 samples of 8 kHz, Hann window, discrete Fourier sum, triangles on the mel scale."""
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 256, 1500).astype(np.uint8)
    mel, energy = (np.concatenate(x) for x in zip(*media.log_mel(samples, 12_000), strict=True))
    x = direct(samples, 2, 3)[:1000]
    frames = 1 + -(-(1000 - 256) // 128)
    x = np.concatenate([media.resample(samples, 0, (frames - 1) * 128 + 256, 2, 3)]).astype(float)
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(0, to_mel(4000), 18))
    hz = np.arange(129) * 8000 / 256
    assert mel.shape == (frames, 16)
    for f in range(frames):
        part = x[f * 128 : f * 128 + 256]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
        spectrum = np.array([abs(np.sum(part * window * np.exp(-2j * np.pi * k * np.arange(256) / 256))) ** 2 for k in range(129)])
        for m in range(16):
            low, middle, high = edges[m : m + 3]
            weight = np.clip(np.minimum((hz - low) / (middle - low), (high - hz) / (high - middle)), 0, None)
            assert mel[f, m] == pytest.approx(np.log(spectrum @ weight + 1e-6), abs=1e-3)
        assert energy[f] == pytest.approx(10 * np.log10(np.mean(part**2) + 1e-9), abs=1e-3)


def test_query_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert media.op2_media_features(spark, str(tmp_path)).count() == 0
