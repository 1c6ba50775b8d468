"""Quality classification by importance resampling between a target and a raw text model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import words
from tidewheel.llm.blocks import gaps, pack, unpack
from tidewheel.llm.tables import aside, discard, durable

#: Features are hashed into 2 ** BITS buckets, kept in SLICES equal parts.
BITS, SLICES = 22, 64
#: Labelled rows that the target model is fitted on, at most: those of the least id hashes.
MAX_LABELS = 200_000
#: Scale of the Gumbel noise: 1 draws in proportion to the weights, less keeps nearer to the threshold.
TEMPERATURE = 0.25
_BINS, _RANGE = 256, 64
_TAG = [np.uint64(x) for x in (0x1F0A, 0x2F0B, 0x3F0C, 0x4F0D)]
#: Parts of the texts in ``classify``; each is weighed by a model of the labels of the other parts.
FOLDS = 4
#: Share of buckets that tell target from raw text, as believed before any count is seen.
TELLING = 0.01
#: Steps of 1 in which a model's ratios are kept, as 16-bit numbers.
STEPS = 2048
#: Bytes of text whose features are made at once.
_SLICE = 1 << 20

#: Word characters of the second reading, in which punctuation separates; the first splits at white space only.
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False


def _buckets(h: np.ndarray, tag: int) -> np.ndarray:
    return (words.mix(h + _TAG[tag]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, bucket) pairs, in order, and the number of rows.

    N-grams of a row: words between white space and all adjacent pairs of them, words between any punctuation, and
    pairs of the latter in which a word follows itself, as one feature for each share (1/2 to 1/16) of all words that
    they exceed.
    """
    data, offsets = words.text_bytes(column)
    rows = len(offsets) - 1
    found = []
    h, c = words.word_hashes(data, offsets)
    d = np.repeat(np.arange(rows), c)
    found.append((d, _buckets(h, 0)))
    if len(h) > 1:
        near = d[1:] == d[:-1]
        found.append((d[1:][near], _buckets(words.mix(h[:-1]) + h[1:], 3)[near]))
    h, c = words.word_hashes(data, offsets, _BREAKS)
    d = np.repeat(np.arange(rows), c)
    found.append((d, _buckets(h, 1)))
    if len(h) > 1:
        near = d[1:] == d[:-1]
        again = np.bincount(d[:-1][near & (h[1:] == h[:-1])], minlength=rows)
        for level in range(1, 5):
            enough = np.flatnonzero((again << level > c) & (again > 1))
            found.append((enough, _buckets(np.full(len(enough), level, np.uint64), 2)))
    keys = np.unique(np.concatenate([(d << BITS) + b for d, b in found]).astype(np.int64)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1), rows


def _counts(docs: DataFrame) -> DataFrame:
    """Rows that have each bucket, of all and of those of the target, for each ``fold``; summed in tasks, then by slice."""
    width, folds = (1 << BITS) // SLICES, FOLDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 * folds, 1 << BITS), np.int32)  # raw and target of each fold
        for batch in batches:
            for part in words.slices(batch, "text", _SLICE):
                row, bucket, _ = features(part.column("text"))
                good = np.asarray(pc.fill_null(part.column("target"), False).to_numpy(zero_copy_only=False), bool)
                fold = part.column("fold").to_numpy()
                for f in range(folds):
                    np.add.at(counts[2 * f], bucket[(fold == f)[row]], 1)
                    np.add.at(counts[2 * f + 1], bucket[((fold == f) & good)[row]], 1)
        bodies = []
        for s in range(SLICES):
            own = counts[:, s * width : (s + 1) * width]
            at = np.flatnonzero(own.any(0))
            bodies.append(pack(gaps(at.astype(np.int32)), *own[:, at]) if len(at) else None)
        keep = [s for s in range(SLICES) if bodies[s]]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([bodies[s] for s in keep], pa.binary())], ["slice", "body"])

    def total(table: pa.Table) -> pa.Table:
        counts = np.zeros((2 * folds, width), np.int64)
        for body in table.column("body").to_pylist():
            at, *own = unpack(body)
            counts[:, np.cumsum(at)] += np.array(own)
        sums = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (counts[::2].sum(1), counts[1::2].sum(1))]
        return pa.table({"slice": table.column("slice")[:1], "raw": sums[0], "target": sums[1], "body": pa.array([pack(*counts)], pa.binary())})

    return docs.mapInArrow(run, "slice int, body binary").groupBy("slice").applyInArrow(total, "slice int, raw array<long>, target array<long>, body binary")


def shrunk_ratios(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """log(target share / raw share) of every bucket, shrunk by how likely its counts say that the two shares differ.

    Either the target has its ``share`` of a bucket's rows, or (``TELLING`` of all buckets) any other, of which
    Beta(share, 1 - share) is the prior. The ratio under the second is multiplied by its probability given the
    counts. No count is too small to move it, and the certainty grows with the table.
    """
    if not 0 < share < 1:
        return np.zeros(len(raw))
    rising = [np.concatenate([[0.0], np.cumsum(np.log(x + np.arange(int(raw.max(initial=0)))))]) for x in (share, 1 - share, 1.0)]
    other = rising[0][target] + rising[1][raw - target] - rising[2][raw]
    same = target * np.log(share) + (raw - target) * np.log(1 - share)
    sure = 1 / (1 + (1 - TELLING) / TELLING * np.exp(np.clip(same - other, -500, 500)))
    return sure * np.log((target + share) / ((raw + 1) * share))


def kept_ratios(ratios: np.ndarray) -> np.ndarray:
    """Ratios in whole ``STEPS``, up to the bounds of 16 bits: what a driver and each worker hold of a model is half as large so."""
    return np.clip(np.rint(ratios * STEPS), -32767, 32767).astype(np.int16)


def cross_models(marked: DataFrame) -> list[tuple[int, bytearray]]:
    """Slices of ``FOLDS`` models of all hashed words and adjacent pairs, each of the rows outside one ``fold``.

    ``marked`` has ``text``, boolean ``target`` and ``fold``. The models are FOLDS * 2 ** BITS numbers of two bytes,
    whatever the input, and come to the driver a slice at a time.
    """
    table, counts_path = durable(_counts(marked))
    sums = table.agg(*[F.sum(F.col(n)[f]) for n in ("raw", "target") for f in range(FOLDS)]).first()
    sums = np.array([int(x or 0) for x in sums]).reshape(2, FOLDS)
    raw_all, target_all = sums.sum(1, keepdims=True) - sums
    shares = (target_all / np.maximum(raw_all, 1)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body in batch.column("body").to_pylist():
                counts = np.array(unpack(body))
                raw, target = counts[::2], counts[1::2]
                bodies.append(pack(*(kept_ratios(shrunk_ratios(r, t, p)) for r, t, p in zip(raw.sum(0) - raw, target.sum(0) - target, shares, strict=True))))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(bodies, pa.binary())], ["slice", "body"])

    made, path = durable(table.select("slice", "body").mapInArrow(run, "slice int, body binary"))
    models = [(r["slice"], r["body"]) for r in made.toLocalIterator()]  # SLICES rows
    discard(marked.sparkSession, path, counts_path)
    return models


def mean_ratios(docs: DataFrame, models: list[tuple[int, bytearray]]) -> DataFrame:
    """``docs`` with ``mean_ratio``, of a text's distinct features in the model without its ``fold``, and their number."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "mean_ratio double, n_features long"])
    shared = docs.sparkSession.sparkContext.broadcast(models)
    width = (1 << BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((FOLDS, 1 << BITS), np.int16)
        for s, body in shared.value:
            dense[:, s * width : (s + 1) * width] = unpack(bytes(body))
        for batch in batches:
            for part in words.slices(batch, "text", _SLICE):
                row, bucket, rows = features(part.column("text"))
                n = np.bincount(row, minlength=rows)
                total = np.bincount(row, weights=dense[part.column("fold").to_numpy()[row], bucket], minlength=rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total / STEPS / np.maximum(n, 1), pa.float64()), pa.array(n, pa.int64())], [*part.schema.names, "mean_ratio", "n_features"])

    return docs.mapInArrow(run, schema)


def best_threshold(weight: np.ndarray, good: np.ndarray) -> float:
    """The least weight to keep: that of the greatest difference of the shares of good and of other rows kept.

    Halfway to the next lower weight; without rows of both kinds nothing is below it.
    """
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(-weight, kind="stable")
    w, g = weight[order], good[order]
    gain = np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum()
    gain[np.flatnonzero(w[1:] == w[:-1])] = -np.inf  # equal weights stay together
    at = int(np.argmax(gain))
    return float(w[at] if at + 1 == len(w) else (w[at] + w[at + 1]) / 2)


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise that the seed and the key name."""
    draw = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(-F.log(draw))


def top_k(scored: DataFrame, k: int, *, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """The ``k`` rows of greatest key, ties by ``tie``, without a sort of all rows.

    Counts of bins of the key find the one bin in which the k-th row lies, counts of finer bins the part of that bin;
    only this part is ordered.
    """
    place = F.least(F.greatest(F.col(key), F.lit(-float(_RANGE))), F.lit(float(_RANGE))) * _BINS
    sure, rest = None, scored
    for bin_of in (F.floor(place), F.floor((place - F.floor(place)) * (1 << 16))):
        counts = rest.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()  # at most 2 * _RANGE * _BINS + 1 or 2 ** 16 rows
        edge = None
        for row in counts:
            if row["n"] >= k:
                edge = row["bin"]
                break
            k -= row["n"]
        if edge is None:
            return rest if sure is None else sure.unionByName(rest)
        over = rest.where(bin_of > edge)
        sure, rest = over if sure is None else sure.unionByName(over), rest.where(bin_of == edge)
    ranked = rest.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), F.col(tie))))
    return sure.unionByName(ranked.where(F.col("_rank") <= k).drop("_rank"))


def _labelled(labels: DataFrame, most: int) -> DataFrame:
    """``_labelled`` ids, at most ``most``, with whether all their labels are good (``_good`` 1)."""
    chosen = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("_good"))
    if labels.limit(most + 1).count() > most:
        chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most)
    return chosen.withColumnRenamed("doc_id", "_labelled")


def _drawn(docs: DataFrame, scored: DataFrame, k: int, text: str, id_col: str) -> DataFrame:
    """The rows of ``docs`` that ``k`` rows of greatest ``_key`` in ``scored`` stand for."""
    keep = top_k(scored, k, key="_key", tie="_md5")
    found = keep.groupBy("_id", "_md5").agg(F.max("log_weight").alias("log_weight"))
    rest = docs.drop("log_weight").withColumn("_text_md5", F.md5(F.coalesce(F.col(text), F.lit(""))))
    joined = rest.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_md5") == F.col("_md5")))
    # repeated rows have one key, so only those of the last key kept may be kept in part
    last = keep.orderBy("_key", F.desc("_md5")).select("_id", "_md5").first()
    if last is not None:
        here = F.col("_id").eqNullSafe(F.lit(last["_id"])) & (F.col("_md5") == last["_md5"])
        have, all_ = keep.where(here).count(), scored.where(here).count()
        if have < all_:
            some = joined.where(here).withColumn("_rank", F.row_number().over(Window.partitionBy("_md5").orderBy("_md5"))).where(F.col("_rank") <= have).drop("_rank")
            joined = joined.where(~here).unionByName(some)
    return joined.drop("_id", "_md5", "_text_md5")


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", k: int | None = None, seed: int = 29, temperature: float = TEMPERATURE, max_labels: int = MAX_LABELS) -> DataFrame:
    """The ``k`` rows of ``docs`` drawn by importance weight towards good, non-toxic text, with ``log_weight``.

    Target: labelled rows (``quality`` 1, ``toxic`` 0); raw: all labelled rows, as the sample of the raw text on which
    both models are fitted, so that groups of unlabelled copies can't tilt the ratio. A label table over
    ``max_labels`` rows is bounded to the rows of least id hash; every row of ``docs`` is weighed. Texts fall into ``FOLDS`` parts by their bytes; each is weighed by a model of the labels of the other parts, so
    that no text is weighed by its own label and copies weigh alike. Ratios are shrunk (``shrunk_ratios``), none is
    zeroed. ``log_weight`` is their mean over a text's distinct features times the mean number of features of the
    labelled texts: the weight of its content at the average length. Without ``k`` it is the number of documents
    that weigh at least the threshold which best separates the labelled texts so weighed (``best_threshold``). Gumbel
    noise of ``temperature`` makes the top k a draw without replacement.

    Without any target label, or without others, all weights are 0 and without ``k`` all rows stay. Null and empty
    texts weigh 0. Repeated rows share their noise, and of those with the last key as many are kept as make ``k``.
    Labels of a null id, or null in both columns, count as none. Other columns stay, one named ``log_weight`` is replaced.
    """
    docs, back = aside(docs, {"_id", "_md5", "_text_md5", "_rank"})
    sample = F.broadcast(_labelled(labels, max_labels))  # at most max_labels ids
    fold = (F.crc32(F.coalesce(F.col(text), F.lit(""))) % FOLDS).cast("int").alias("fold")
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"), fold).join(sample, F.col("_id") == F.col("_labelled"), "left").drop("_labelled")
    models = cross_models(marked.where(F.col("_good").isNotNull() & F.col("text").isNotNull()).select("text", "fold", (F.col("_good") == 1).alias("target")))
    narrow = mean_ratios(marked, models)
    scored, _ = durable(narrow.select("_id", "_good", "mean_ratio", "n_features", F.md5(F.coalesce("text", F.lit(""))).alias("_md5")))
    own = scored.where(F.col("_good").isNotNull() & (F.col("n_features") > 0))
    scale = own.agg(F.avg("n_features")).first()[0] or 1.0
    scored = scored.withColumn("log_weight", F.round(F.col("mean_ratio") * F.lit(scale), 6))
    scored = scored.withColumn("_key", F.col("log_weight") + F.lit(temperature) * gumbel(F.coalesce(F.col("_id").cast("string"), F.lit("")), seed))
    if k is None:
        seen = own.groupBy("_id").agg(F.min("mean_ratio").alias("mean"), F.min("_good").alias("good")).select("mean", "good").toArrow()  # at most max_labels rows
        edge = best_threshold(seen.column("mean").to_numpy() * scale, seen.column("good").to_numpy() == 1)
        k = scored.where(F.col("log_weight") >= F.lit(edge)).count()
    return back(_drawn(docs, scored.drop("_good", "mean_ratio", "n_features"), k, text, id_col))


def op9_quality_resample(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "log_weight")
