"""Reading and writing prompt datasets and results; schemas are always stated."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.functions.ranking import place_within

PROMPT = "question string, answer string, messages array<struct<role string, content string>>, source string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = PROMPT) -> DataFrame:
    """JSON lines, plain or gzipped, files or folders; blank lines are skipped and broken ones kept aside in ``_corrupt``."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows


def read_json_array(spark: SparkSession, path: str, schema: str = PROMPT) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_with_file_order(spark: SparkSession, path: str, schema: str = PROMPT) -> DataFrame:
    """Rows with their file, and the file's place in lexical order."""
    from pyspark.sql import Window

    rows = read_jsonl(spark, path, schema).withColumn("file", F.col("_metadata.file_path"))
    files = rows.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)  # one row a file
    return rows.join(F.broadcast(files), "file")


def normalize_record(rows: DataFrame, source: str) -> DataFrame:
    """Messages from the question where there are none, an empty answer for none, and the source as a tag."""
    made = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    return rows.select(F.when(F.size("messages") > 0, F.col("messages")).otherwise(made).alias("messages"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("source", F.lit(source)).alias("source"))


def read_prepared(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows of each dataset; an empty one is an error."""
    out = None
    for name, df in datasets.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rows", F.when(F.col("rows") > 0, F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("empty dataset: "), F.col("name"))).cast("long")))


def write_results(samples: DataFrame, results: DataFrame, path: str) -> None:
    """Results joined back to their samples, as JSON lines."""
    samples.join(results, ["task_id", "completion_id"], "left").write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines, null fields kept; how many were written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def write_scoreboard(rows: DataFrame, path: str, agent: str, task: str, metric: str, tasks: list[str]) -> None:
    """Agents by ``tasks`` as CSV with a header under ``path``/matrix, and a row an agent and task as JSON lines under ``path``/long."""
    rows.groupBy(agent).pivot(task, tasks).agg(F.first(metric)).orderBy(agent).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/matrix")  # a row an agent
    rows.select(agent, task, metric).write.mode("overwrite").json(f"{path}/long")


def write_snapshot(fresh: DataFrame, replay: DataFrame, path: str, *, facts: dict | None = None) -> int:
    """Fresh and replay entries under ``path`` as the next generation, with ``facts`` (counters, settings); its number.

    Entries are written first, and a manifest of one small file is moved into place once they all stand: whatever
    breaks off before that leaves the generation before as the last one. Order is a column (``seq_no``), not the files'.
    """
    spark = fresh.sparkSession
    both = fresh.withColumn("part", F.lit("fresh")).unionByName(replay.withColumn("part", F.lit("replay")), allowMissingColumns=True)
    number = max([-1, *_names(spark, f"{path}/entries"), *_names(spark, f"{path}/manifests")]) + 1
    both.write.partitionBy("part").parquet(f"{path}/entries/{number}")
    counts = {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/entries/{number}").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    said = json.dumps({"generation": number, "fresh": counts.get("fresh", 0), "replay": counts.get("replay", 0), "schema": both.schema.json(), "facts": facts or {}})
    files, where = _files(spark, path)
    draft = where(f"{path}/manifests/.{number}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(said.encode()))
    out.close()
    if not files.rename(draft, where(f"{path}/manifests/{number}")):
        raise OSError(f"generation {number} of {path} was published by another job")
    return number


def restore_snapshot(spark: SparkSession, path: str, order: str = "fifo") -> tuple[DataFrame, DataFrame, dict]:
    """Fresh and replay entries of the last whole generation, and its facts; fresh ones with the ``priority`` that ``order`` gives them now.

    A generation without a readable manifest isn't whole and is passed over. Priorities aren't kept, as the order may
    have changed: the order of arrival (``fifo``), or the version (``edf``), where what has none goes first.
    """
    for number in sorted(_names(spark, f"{path}/manifests"), reverse=True):
        try:
            said = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifests/{number}").collect()))
            schema = StructType.fromJson(json.loads(said["schema"]))
        except (ValueError, KeyError):
            continue
        rows = spark.read.schema(schema).parquet(f"{path}/entries/{number}")
        fresh, replay = (rows.where(F.col("part") == p).drop("part") for p in ("fresh", "replay"))
        return fresh.withColumn("priority", priority(order)), replay, said["facts"]
    raise FileNotFoundError(f"no whole snapshot under {path}")


def priority(order: str):
    """What the entries of a buffer are served by, before their order of arrival."""
    return F.col("seq_no") if order == "fifo" else F.coalesce(F.col("min_version").cast("long"), F.lit(-1))


def read_legacy_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of JSON lines without ``seq_no``: their place over all files in order of name, by their offsets within a file.

    Blocks of a file are numbered in parallel and then set one behind the other by their counts.
    """
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_in"))
    placed = place_within(rows, [], F.struct("_file", "_start"), [F.col("_in")], "seq_no")
    return placed.drop("_file", "_start", "_in")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[int]:
    """The numbers that name entries of a folder."""
    files, where = _files(spark, path)
    if not files.exists(where(path)):
        return []
    return [int(n) for n in (s.getPath().getName() for s in files.listStatus(where(path))) if n.isdigit()]
