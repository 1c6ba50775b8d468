"""Site-relative line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.tables import aside, broadcast_if_small, durable


def _line_key(line):
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """``host`` and ``lines``: keys of the lines on at least ``min_pages`` pages and over ``ratio`` of a host's pages.

    The ratio alone decides; two pages, as a line that only one page has isn't repeated, and all of a host's single page
    would be. A line counts once for each page that holds it, trimmed of spaces; blank lines never count. A host's array is
    bounded by its mean distinct lines a page over ``ratio``. Counting combines within tasks before the shuffle, so
    a host with a third of all pages is spread over its lines.
    """
    known = pages.where(F.col(host).isNotNull())
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != "")
    counts = (
        known.select(F.col(host).alias("_host"), F.explode(F.array_distinct(F.transform(lines, _line_key))).alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_pages"))
        .where(F.col("_pages") >= min_pages)
    )
    totals = known.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.join(totals, "_host")
        .where(F.col("_pages") > ratio * F.col("_total"))
        .groupBy("_host")
        .agg(F.collect_list("_line").alias("_lines"))
    )


def drop_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``, and ``n_lines`` and ``n_dropped`` added.

    Null texts stay null with 0 lines, an empty text is one blank line. Pages without a host have no site to be
    measured against and stay as they are. Each row is a page of its own, repeated ids included. The site is the
    column ``host`` (the source of a document); lines are told apart by 64-bit hashes. Columns of the names
    ``n_lines`` and ``n_dropped`` are replaced; all others stay.
    """
    pages, back = aside(pages, {"_site", "_lines", "_hit", "_kept"})
    found, _ = durable(boilerplate_lines(pages, host=host, text=text, ratio=ratio, min_pages=min_pages))
    found = broadcast_if_small(found.withColumnRenamed("_host", "_site"), 20_000)
    lines = F.split(F.col(text), "\n", -1)
    joined = pages.join(found, F.col(host) == F.col("_site"), "left")
    hit = F.array_intersect(F.transform(lines, _line_key), F.col("_lines"))
    marked = joined.withColumn("_hit", F.when(F.col("_lines").isNotNull() & F.col(text).isNotNull(), hit))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_hit"), _line_key(x)))
    touched = F.coalesce(F.size("_hit") > 0, F.lit(False))
    total = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    total = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(total)
    return back(
        marked.withColumn("_kept", F.when(touched, kept))
        .withColumn("n_lines", total)
        .withColumn("n_dropped", F.when(touched, total - F.size("_kept")).otherwise(F.lit(0)).cast("long"))
        .withColumn(text, F.when(touched, F.array_join("_kept", "\n")).otherwise(F.col(text)))
        .drop("_site", "_lines", "_hit", "_kept")
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select(
        "doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5")
    )


ORACLE = """
WITH l AS (
  SELECT source, trim(x) AS line, count(*) AS pages FROM (
    SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS x
    FROM documents WHERE source IS NOT NULL) GROUP BY 1, 2),
t AS (SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY 1),
b AS (SELECT source, list(line) AS bad FROM l JOIN t USING (source)
      WHERE line <> '' AND pages >= 2 AND pages > 0.05 * total GROUP BY 1),
k AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS lines,
             list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))) AS kept
      FROM documents d LEFT JOIN b ON d.source = b.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       length(array_to_string(kept, chr(10)))::BIGINT AS n_chars_kept, md5(array_to_string(kept, chr(10))) AS text_md5
FROM k
"""
