"""The corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark passages, and the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.decontaminate import decontaminate
from tidewheel.llm.jaccard import near_duplicates
from tidewheel.llm.line_dedup import drop_boilerplate
from tidewheel.llm.mixing import mix_sources
from tidewheel.llm.quality import classify
from tidewheel.llm.tables import broadcast_if_small, discard, durable


def _md5():
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good, non-toxic text keeps."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text."""
    cut = drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group; documents without words form no group and stay.

    A repeated row is the same document again, and stays once; rows with a null id are documents of their own and stay.
    """
    found = near_duplicates(docs.select("doc_id", _md5().alias("text_md5"), "text"), carry="text_md5")
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct()
    kept = docs.withColumn("_text_md5", _md5()).join(broadcast_if_small(gone), (F.col("doc_id") == F.col("_id")) & (F.col("_text_md5") == F.col("_md5")), "left_anti")
    again = found.groupBy("doc_id", "text_md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.limit(1).count():
        named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "_text_md5"])
        kept = named.unionByName(kept.where(F.col("doc_id").isNull()))
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with their domain, words and number of copies (epochs)."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
]

#: The first stage hashes n-grams into model buckets, which SQL can't say; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it, and deleted once the next stands."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, new = durable(docs)
            if path:
                discard(spark, path)
            path = new
    return docs
