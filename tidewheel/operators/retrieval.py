"""Batch retrieval: BM25 over postings, exact dense top-k, page lookup and link neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.lineage import cut
from tidewheel.functions.sizes import broadcast_if_small


#: Documents whose postings a task has.
TASK_DOCS = 1000


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9\\u0080-\\uffff]+"), lambda w: w != "")


def bm25(corpus: DataFrame, queries: DataFrame, k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents (``doc_id, text``) of each query (``query_id, query``), ties by id.

    Postings are kept for query terms only, before any shuffle of the corpus where their size allows to send them to
    all tasks; frequencies are written once, since document frequencies and scores both read them, and the top k is
    taken by rank within a query.
    """
    words = corpus.select("doc_id", terms(F.col("text")).alias("ws"))
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    stats = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("ws")).alias("mean_len"))
    posting = words.select("doc_id", F.size("ws").alias("len"), F.explode("ws").alias("term")).join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi")
    # dealt by document, so that what a task sums for a query is that of its own documents
    tf = posting.repartition(max(1, -(-corpus.count() // TASK_DOCS)), "doc_id").groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(tf)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    weighed = tf.join(broadcast_if_small(df), "term").join(F.broadcast(stats)).select("term", "doc_id", weight.alias("w"))  # stats: one row
    scored = weighed.join(broadcast_if_small(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 512) -> DataFrame:
    """The ``k`` nearest vectors (``vec_id, embedding``) of each query by cosine, exact.

    Queries go round in blocks of a fixed size: each block is a small matrix that is sent to the tasks, each task
    keeps its own best k a query, and only those are shuffled. Ties are broken by id.
    """
    ids = queries.select("vec_id").withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // block)))))
    parts = ids.select("_b").distinct().orderBy("_b").collect()  # one row a block
    found = None
    for (number,) in parts:
        rows = queries.join(ids.where(F.col("_b") == number).select("vec_id"), "vec_id").orderBy("vec_id").toArrow()  # about ``block`` rows
        names = rows.column("vec_id").to_numpy()
        matrix = _unit(rows.column("embedding"))

        def best(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            held: tuple[np.ndarray, np.ndarray] | None = None  # ids and scores of the best so far, a row a query
            for batch in batches:
                if not len(batch):
                    continue
                mine, scores = batch.column("vec_id").to_numpy(), np.round(matrix @ _unit(batch.column("embedding")).T, 6)
                ids = np.broadcast_to(mine, scores.shape)
                if held is not None:
                    ids, scores = np.hstack([held[0], ids]), np.hstack([held[1], scores])
                top = np.lexsort((ids, -scores), axis=1)[:, :k]
                held = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
            if held is not None:
                q = np.repeat(names, held[0].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(held[0].reshape(-1)), pa.array(held[1].reshape(-1))], ["query_id", "vec_id", "score"])

        local = vectors.select("vec_id", "embedding").mapInArrow(best, "query_id long, vec_id long, score double")
        found = local if found is None else found.unionByName(local)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(column) -> np.ndarray:
    x = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def page_key(url: Column) -> Column:
    """The key under which a page is found, whatever form its address has."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, "^[a-zA-Z]+://", "")), "[?#].*$", "")
    return F.regexp_replace(F.replace(F.replace(bare, F.lit("index.php/"), F.lit("index.php?title=")), F.lit("_"), F.lit("%20")), "/+$", "")


def access(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """``request, page_id`` of every request: the page (``page_id, url``; the least of several) with its key, or null."""
    known = pages.groupBy(page_key(F.col("url")).alias("_key")).agg(F.min("page_id").alias("page_id"))
    return requests.withColumn("_key", page_key(F.col("request"))).join(known, "_key", "left").drop("_key")


def neighbours(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Pages that a visited page links to or is linked from (``url, near``), less those visited."""
    both = links.select("url", F.col("target").alias("near")).unionByName(links.select(F.col("target").alias("url"), F.col("url").alias("near")))
    return both.join(visited.select("url"), "url", "left_semi").join(visited.select(F.col("url").alias("near")), "near", "left_anti").distinct()
