import gzip
import json

import pytest

from tidewheel.sources import files


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"question": "q1", "answer": "a"}), "", json.dumps({"messages": [{"role": "user", "content": "m"}], "source": "s"}), "{broken"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"question": "q2"}))
    (tmp_path / "c.json").write_text(json.dumps([{"question": "q3"}, {"question": "q4"}]))
    rows = files.read_jsonl(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl.gz"]).cache()
    assert rows.count() == 4 and rows.where("_corrupt IS NOT NULL").count() == 1
    good = files.normalize_record(rows.where("_corrupt IS NULL").drop("_corrupt"), "mine")
    assert sorted((r["messages"][0]["content"], r["answer"], r["source"]) for r in good.collect()) == [("m", "", "s"), ("q1", "a", "mine"), ("q2", "", "mine")]
    assert files.read_json_array(spark, f"{tmp_path}/c.json").count() == 2
    assert {(r["file_no"]) for r in files.read_with_file_order(spark, f"{tmp_path}/*.jsonl*").collect()} == {0, 1}


def test_manifest_and_results(spark, tmp_path):
    full, empty = spark.range(3).toDF("n"), spark.range(0).toDF("n")
    assert files.manifest({"a": full}).first()["rows"] == 3
    with pytest.raises(Exception, match="empty dataset: b"):
        files.manifest({"a": full, "b": empty}).collect()
    samples = spark.createDataFrame([("t", 0, "x"), ("t", 1, "y")], "task_id string, completion_id int, completion string")
    results = spark.createDataFrame([("t", 0, True)], "task_id string, completion_id int, passed boolean")
    files.write_results(samples, results, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").where("passed").count() == 1
    full.write.parquet(f"{tmp_path}/root/set")
    assert files.read_prepared(spark, f"{tmp_path}/root", "set").count() == 3


def test_snapshot_round_trip(spark, tmp_path):
    from tidewheel.operators import selection

    fresh = spark.createDataFrame([(0, 9, 8), (1, 1, 8), (2, 5, 8)], "seq_no long, min_version int, seq_len int")
    files.write_snapshot(fresh, fresh.where("seq_no = 1"), f"{tmp_path}/s")
    back, replay, _ = files.restore_snapshot(spark, f"{tmp_path}/s")
    order = lambda policy: [r["seq_no"] for r in back.orderBy(*selection.arrival_order(policy)).collect()]
    assert order("fifo") == [0, 1, 2] and order("edf") == [1, 2, 0] and replay.count() == 1


def test_lines_and_scoreboard(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 0.5), ("a", "y", None), ("b", "x", 0.25)], "agent string, task string, metric double")
    assert files.write_lines(rows, f"{tmp_path}/lines") == 3
    assert sorted(map(tuple, spark.read.schema("agent string, task string, metric double").json(f"{tmp_path}/lines").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    files.write_scoreboard(rows, f"{tmp_path}/board", "agent", "task", "metric", ["x", "y"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/board/matrix").collect()] == [("a", "0.5", None), ("b", "0.25", None)]
    assert spark.read.json(f"{tmp_path}/board/long").count() == 3
