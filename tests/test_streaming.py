import datetime as dt
import json
import os

from pyspark.sql import functions as F

from tidewheel.operators import curation
from tidewheel.streaming import jobs

ROWS = [("a", 1, [1.0, 1.0]), ("a", 2, [1.0, 1.0]), ("b", 1, [0.0, 0.0]), ("b", 2, [0.0, 1.0]), ("c", 1, [0.0]), ("a", 3, [0.0, 0.0]), ("c", 2, [0.0]), ("c", 3, [0.0]), ("d", 3, [])]


def write(tmp_path):
    start = dt.datetime(2024, 1, 1)
    for i in range(0, len(ROWS), 3):
        lines = [json.dumps({"prompt_id": p, "version": v, "rewards": r, "ts": (start + dt.timedelta(minutes=4 * (i + j))).isoformat()}) for j, (p, v, r) in enumerate(ROWS[i : i + 3])]
        (tmp_path / f"{i}.json").write_text("\n".join(lines))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order
    return str(tmp_path)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_ingest_matches_group_statistics(spark, tmp_path):
    got = {(r["prompt_id"], r["version"], r["traj_idx"]): r for r in run(jobs.ingest(jobs.read_rollouts(spark, write(tmp_path))), "ingested", "append").collect()}
    assert len(got) == sum(len(r) for _, _, r in ROWS)
    assert got["b", 2, 1]["zero_adv"] == 0 and got["a", 1, 0]["zero_adv"] == 1 and got["c", 1, 0]["g_std"] == 1.0
    assert abs(got["b", 2, 0]["g_std"] - 0.5**0.5) < 1e-12


def test_curation_agrees_with_batch(spark, tmp_path):
    table = run(jobs.curate(jobs.read_rollouts(spark, write(tmp_path))), "curated", "update")
    last = {r["prompt_id"]: r for r in table.groupBy("prompt_id").agg(F.max_by(F.struct("streak", "kind", "success"), "version").alias("s")).select("prompt_id", "s.*").collect()}
    rows = [(p, v, x, i) for p, v, r in ROWS for i, x in enumerate(r)]
    batch = curation.rounds(spark.createDataFrame(rows, "prompt_id string, version int, reward double, seq_no int"))
    streak = {r["prompt_id"]: r["streak"] for r in curation.streaks(batch).collect()}
    mean = {r["prompt_id"]: r["success"] for r in curation.success_average(batch, 0.9).collect()}
    assert {k: v["streak"] for k, v in last.items()} == streak == {"a": 1, "b": 0, "c": 3}
    assert {k: round(v["success"], 9) for k, v in last.items()} == {k: round(v, 9) for k, v in mean.items()}


def test_windows(spark, tmp_path):
    stream = jobs.read_rollouts(spark, write(tmp_path))
    tallies = {r["version"]: r["rollouts"] for r in run(jobs.version_tallies(stream), "tallies", "complete").collect()}
    assert tallies == {1: 3, 2: 3, 3: 3}
    assert run(jobs.periodic_report(stream), "report", "complete").agg(F.sum("rollouts")).first()[0] == 2 * len(ROWS)
    assert run(jobs.drop_stale(jobs.ingest(stream), 3, 1), "kept", "append").where("version < 2").count() == 0


def test_counters_are_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = jobs.read_rollouts(spark, write(tmp_path / "in"))
    for _ in range(2):
        jobs.write_counters(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("rollouts")).first()[0] == len(ROWS)


def latest(spark, path):
    last = max(int(d.split("=")[1]) for d in os.listdir(path) if d.startswith("batch="))
    return spark.read.parquet(f"{path}/batch={last}")


def test_controller_agrees_with_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = jobs.read_rollouts(spark, write(tmp_path / "in"))
    jobs.control(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", warm_up=4).awaitTermination()
    rows = [(p, v, x, i) for p, v, r in ROWS for i, x in enumerate(r)]
    batch = curation.controller(curation.rounds(spark.createDataFrame(rows, "prompt_id string, version int, reward double, seq_no int")), warm_up=4)
    key = lambda r: (r["version"], round(r["p_easy"], 9), round(r["p_hard"], 9))
    got = sorted(map(key, latest(spark, f"{tmp_path}/out/control").collect()))
    assert got == sorted(map(key, batch.collect())) and got[0][1:] == (0.5, 0.5) and got[-1][1:] != (0.5, 0.5)


def test_waits_and_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    start = dt.datetime(2024, 1, 1)
    rows = [{"agent": "ab"[i % 2], "ts": (start + dt.timedelta(seconds=i)).isoformat(), "wait": float(i % 5), "step": float(3 + i % 7), "seq_no": i} for i in range(23)]
    for i in range(0, 23, 5):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i : i + 5]))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("agent string, ts timestamp, wait double, step double, seq_no long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    jobs.smooth_waits(stream, f"{tmp_path}/waits", f"{tmp_path}/c1", alpha=0.3).awaitTermination()
    got = {r["agent"]: (r["wait"], r["step"], r["fraction"]) for r in latest(spark, f"{tmp_path}/waits").collect()}
    for agent in "ab":
        wait = step = None
        for r in (r for r in rows if r["agent"] == agent):
            wait = r["wait"] if wait is None else 0.3 * r["wait"] + 0.7 * wait
            step = r["step"] if step is None else 0.3 * r["step"] + 0.7 * step
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[agent], (wait, step, min(wait / step, 0.95)), strict=True))
    jobs.retain_latest(stream, f"{tmp_path}/replay", f"{tmp_path}/c2", 7).awaitTermination()
    assert sorted(r["seq_no"] for r in latest(spark, f"{tmp_path}/replay").collect()) == list(range(16, 23))
    assert len([d for d in os.listdir(tmp_path / "replay") if d.startswith("batch=")]) == 2


def test_sessions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    start = dt.datetime(2024, 1, 1)
    rows = [("s", 0, "begin"), ("s", 5, "run"), ("s", 9, "done"), ("s", 40, "begin"), ("t", 3, "begin")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"session_id": s, "ts": (start + dt.timedelta(minutes=m)).isoformat(), "status": x}) for s, m, x in rows))
    stream = spark.readStream.schema("session_id string, ts timestamp, status string").json(str(tmp_path / "in"))
    got = run(jobs.sessions(stream), "sessions", "complete").collect()
    assert sorted((r["session_id"], r["events"], r["status"]) for r in got) == [("s", 1, "begin"), ("s", 3, "done"), ("t", 1, "begin")]
