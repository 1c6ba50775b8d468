"""Session lifecycles: batch forms by an event-by-event reading in plain Python, and the stream by its batch form."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import lifecycle
from tidewheel.streaming import lifecycle as streams

EVENTS = "session_id long, ts double, seq int, event string, status string, reason string"
PHASES = lifecycle.PHASES


def made_events(seed, sessions=60):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        t, n = 1e6 + 1000.0 * s, 0
        steps = [("submit", None, None)] if rng.random() < 0.95 else []
        for _ in range(rng.randrange(0, 14)):
            steps.append((f"{rng.choice(PHASES)}_{rng.choice(['start', 'end'])}", None, None))
        if rng.random() < 0.2:
            steps.insert(rng.randrange(len(steps) + 1), ("finalized", None, rng.choice([None, "note"])))
        if rng.random() < 0.7:
            steps.insert(rng.randrange(len(steps) // 2, len(steps) + 1), ("finalized", rng.choice(lifecycle.TERMINAL), rng.choice([None, "why"])))
        for event, status, reason in steps:
            t += rng.choice([0.0, 0.5, 1.0, 7.25])
            n += 1
            rows.append((s, t, n, event, status, reason))
    return rows


def by_event(rows, several=True):
    """What a tracer would hold after all events: (record, spans) of each session that was submitted."""
    out = {}
    for s, t, n, event, status, reason in sorted(rows):
        if s not in out:
            if event == "submit":
                out[s] = {"status": "pending", "reason": None, "submit": t, "final": None, "last": t, "spans": {}, "active": {}, "over": False}
            continue
        r = out[s]
        if r["over"]:
            continue
        r["last"] = t
        if event == "finalized":
            r["final"], r["status"], r["reason"] = t, status or r["status"], reason or r["reason"]
            r["over"] = status in lifecycle.TERMINAL
        elif event != "submit":
            phase, role = event.rsplit("_", 1)
            spans, active = r["spans"].setdefault(phase, []), r["active"].get(phase)
            if role == "start":
                if active is not None and not several:
                    active[1] = t
                spans.append([t, None, n])
                r["active"][phase] = spans[-1]
            else:
                if active is None:
                    spans.append([t, t, n])
                else:
                    active[1] = t
                r["active"][phase] = None
    return out


@pytest.mark.parametrize("several", [True, False])
def test_records_and_spans(spark, several):
    rows = made_events(3)
    alive = lifecycle.lived(spark.createDataFrame(rows, EVENTS).repartition(5))
    found = lifecycle.spans(alive, several=several)
    want = by_event(rows, several)
    assert sorted((r["session_id"], r["phase"], r["seq"], r["start_ts"], r["end_ts"]) for r in found.collect()) == sorted((s, p, n, a, b) for s, r in want.items() for p, spans in r["spans"].items() for a, b, n in spans)
    got = {r["session_id"]: r for r in lifecycle.records(alive, found).collect()}
    assert got.keys() == want.keys()
    for s, r in want.items():
        g = got[s]
        assert (g["status"], g["reason"], g["submit_ts"], g["finalized_ts"], g["last_ts"]) == (r["status"], r["reason"], r["submit"], r["final"], r["last"])
        for p in PHASES:
            ended = [b - a for a, b, _ in r["spans"].get(p, []) if b is not None]
            assert g[f"{p}_s"] == (pytest.approx(sum(ended)) if ended else None)
    empty = spark.createDataFrame([], EVENTS)
    assert lifecycle.records(lifecycle.lived(empty), lifecycle.spans(lifecycle.lived(empty))).count() == 0


def test_timelines(spark):
    rows = made_events(5)
    alive = lifecycle.lived(spark.createDataFrame(rows, EVENTS))
    found = lifecycle.spans(alive)
    records = lifecycle.records(alive, found)
    got, cut = {}, {}
    for r in lifecycle.timeline(records, found).orderBy("session_id", "place").collect():
        got.setdefault(r["session_id"], []).append((r["segment"], r["start_ts"], r["end_ts"]))
    for r in lifecycle.sweep(records, found).orderBy("session_id", "place").collect():
        cut.setdefault(r["session_id"], []).append((r["segment"], r["start_ts"], r["end_ts"]))
    for s, r in by_event(rows).items():
        pieces, now = [], r["submit"]
        for a, _, _, p, b in sorted((a, PHASES.index(p), n, p, b) for p, spans in r["spans"].items() for a, b, n in spans if b is not None):
            pieces += [("idle", now, a)] * (a - now > 1e-6) + [(p, a, b)] * (b > a)
            now = b
        pieces += [("idle", now, r["final"])] * (r["final"] is not None and r["final"] - now > 1e-6)
        assert got.get(s, []) == pieces
        # the sweep covers every instant once, with the innermost span
        end = r["final"] if r["final"] is not None else r["last"]
        own = cut.get(s, [])
        assert [b for _, _, b in own[:-1]] == [a for _, a, _ in own[1:]] and (not own or (own[0][1], own[-1][2]) == (r["submit"], end))
        for segment, a, b in own:
            middle = (a + b) / 2
            over = [(x, -min(y if y is not None else end, end), p) for p, spans in r["spans"].items() for x, y, _ in spans if x <= middle < min(y if y is not None else end, end)]
            assert segment == (max(over)[2] if over else "idle")


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*streams.ROCKSDB)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset(streams.ROCKSDB[0])


def in_files(folder, rows, size, line):
    os.makedirs(folder)
    for i in range(0, len(rows), size):
        with open(f"{folder}/{i:06d}.json", "w") as f:
            f.write("\n".join(json.dumps(line(r)) for r in rows[i : i + size]))
        os.utime(f"{folder}/{i:06d}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order


def test_stream_of_sessions_equals_batch(rocksdb, tmp_path):
    """Sessions over several batches; those that end by a timer are dropped, and their state goes."""
    spark = rocksdb
    rows = sorted((r for r in made_events(7, 25)), key=lambda r: (r[1], r[0], r[2]))
    start = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    last = rows[-1][1]
    clock = [(-1, last + k * 4000.0, 0, "tick", None, None) for k in (1, 2, 3)]  # moves the watermark on
    in_files(f"{tmp_path}/in", rows, 60, lambda r: {"session_id": r[0], "ts": (start + dt.timedelta(seconds=r[1])).isoformat(), "seq": r[2], "event": r[3], "status": r[4], "reason": r[5]})
    for k, r in enumerate(clock):
        with open(f"{tmp_path}/in/z{k}.json", "w") as f:
            f.write(json.dumps({"session_id": r[0], "ts": (start + dt.timedelta(seconds=r[1])).isoformat(), "seq": 0, "event": "tick"}))
        os.utime(f"{tmp_path}/in/z{k}.json", (1_800_000_000 + k, 1_800_000_000 + k))
    stream = spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = streams.follow_sessions(stream, idle_s=2000.0, late="10 seconds").writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    progress = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    alive = lifecycle.lived(spark.createDataFrame(rows, EVENTS))
    found = lifecycle.spans(alive)
    batch = lifecycle.expire(lifecycle.records(alive, found), F.lit(last + 9000.0), 2000.0)
    left = {r["session_id"]: r["n"] for r in found.where("end_ts IS NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = lambda r, still: (r["session_id"], r["status"], r["reason"], r["submit_ts"], r["finalized_ts"], *[None if r[f"{p}_s"] is None else round(r[f"{p}_s"], 6) for p in PHASES], still)
    want = sorted((key(r, left.get(r["session_id"], 0)) for r in batch.collect()), key=repr)
    got = sorted((key(r, r["open_spans"]) for r in spark.table("followed").collect()), key=repr)
    assert got == want and any(r[1:3] == ("dropped", "idle") for r in got)
    assert max(progress) > 0 and progress[-1] < max(progress)


def test_prompts_go_on_from_a_saved_table(rocksdb, tmp_path):
    """Two jobs, the second from the table that the first left, give what one job gives; a forgotten prompt starts anew."""
    spark = rocksdb
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(6)}", v, [float(rng.randrange(2))] * 2 if rng.random() < 0.8 else [0.0, 1.0]) for v in range(40)]
    line = lambda r: {"prompt_id": r[0], "version": r[1], "rewards": r[2]}
    schema = "prompt_id string, version int, rewards array<double>"

    def run(part, name, saved=None, **settings):
        in_files(f"{tmp_path}/{name}", part, 14, line)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}")
        q = streams.curate_on(stream, saved, **settings).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
        end = time.time() + 90
        while settings and q.isActive and time.time() < end and spark.table(name).agg(F.max("version")).first()[0] != part[-1][1]:
            time.sleep(1)
        q.stop() if settings else q.awaitTermination(120)
        return spark.table(name).groupBy("prompt_id").agg(F.max_by(F.struct("streak", "kind", "success"), "version").alias("s")).select("prompt_id", "s.*")

    whole = {r["prompt_id"]: (r["streak"], r["kind"], round(r["success"], 9)) for r in run(rows, "whole").collect()}
    run(rows[:20], "first").write.parquet(f"{tmp_path}/saved")
    saved = spark.read.parquet(f"{tmp_path}/saved")
    second = {r["prompt_id"]: (r["streak"], r["kind"], round(r["success"], 9)) for r in run(rows[20:], "second", saved).collect()}
    kept = {r["prompt_id"]: (r["streak"], r["kind"], round(r["success"], 9)) for r in saved.collect()}
    assert {**kept, **second} == whole
    lived = {r["prompt_id"] for r in run(rows[:14], "lived", ttl_ms=3_600_000).collect()}
    assert lived == {p for p, _, _ in rows[:14]}
