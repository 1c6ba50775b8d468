"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.tables import aside, broadcast_if_small, durable, whole_text

LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"tier0": 4.0, "tier1": 3.0, "tier2": 2.0, "tier3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def tier_of_source(source: str = "source") -> Column:
    """The domain of a source: its trailing number modulo 4; ``none`` without one."""
    digits = F.regexp_extract(F.col(source), "([0-9])$", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit("none")).otherwise(F.concat(F.lit("tier"), (digits.cast("int") % 4).cast("string")))


def _weight(column: str, weights: Mapping[str, float]) -> Column:
    chosen = F.lit(1.0)
    for name, w in weights.items():
        chosen = F.when(F.col(column) == name, F.lit(float(w))).otherwise(chosen)
    return chosen


def fill_to_weights(nodes: DataFrame, parents: list[str], budget: Column) -> DataFrame:
    """Adds ``granted``: ``budget`` of each parent shared by ``weight`` among its nodes, none above its ``capacity``.

    What a full node can't take goes to its siblings by their weights. Nodes are full in order of capacity over
    weight, so one ordered window over a parent's children finds the level at which the others stand.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("_ratio").asc_nulls_last(), *[F.col(c) for c in LEVELS if c in nodes.columns])
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (budget - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        nodes.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
        .withColumn("_full", F.coalesce(F.col("_ratio") <= level, F.lit(False)))
        .withColumn("_taken", F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(family), F.lit(0)))
        .withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family))
        .withColumn("granted", F.when(F.col("_full"), F.col("capacity").cast("double")).otherwise(F.coalesce(F.col("weight") * ((budget - F.col("_taken")) / F.col("_open")), F.lit(0.0))))
        .drop("_ratio", "_full", "_taken", "_open")
    )


def leaf_targets(leaves: DataFrame, *, share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``target`` tokens of each leaf (``LEVELS``, ``tokens``): the budget goes down the tree level by level.

    A subtree's capacity is ``max_epochs`` times its tokens, so a shortage is met by siblings first and by the
    ancestor's siblings only when the whole subtree is full.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(level, weights.get(level, {})))
        if above is None:
            whole = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(share)).cast("double")
            nodes = nodes.withColumn("_budget", whole)
        else:
            nodes = nodes.join(above, path[:-1])
        above = fill_to_weights(nodes, path[:-1], F.col("_budget")).select(*path, *(["tokens"] if depth == 2 else []), F.col("granted").alias("_budget"))
    return above.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.floor(F.col("_budget") + F.lit(1e-6)).cast("long").alias("target"))


def mix_sources(docs: DataFrame, *, domain: Column | None = None, share: float = 0.7, max_epochs: int = 3, seed: int = 17, weights: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``domain``, ``n_tokens`` and ``copies`` > 0: how many epochs of the mix hold each document.

    The budget is ``share`` of all tokens (words). A leaf of target t takes floor(t / its tokens) whole epochs and
    the longest prefix that still fits of one more epoch, ordered by md5 of seed, epoch and id. Equal ids stand
    and fall together. The prefix is found in two steps, over sums of 4096 ranges of the hash and then within the
    one range where the target ends, so a leaf with a third of all rows is never ordered as one group.
    Null labels form nodes of their own (as ``none``); null texts count as empty, and a leaf without tokens
    gives nothing. Columns of the added names are replaced.
    """
    docs, back = aside(docs, {"_domain", "_lang", "_source", "_tokens", "_whole", "_rest", "_code", "_range", "_last", "_base", "_in"})
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    domain = tier_of_source() if domain is None else domain
    own = [F.coalesce(domain, F.lit("none")).alias("_domain"), F.coalesce(F.col("lang"), F.lit("none")).alias("_lang"), F.coalesce(F.col("source"), F.lit("none")).alias("_source")]
    keyed = docs.select("*", *own, word_count(text).alias("_tokens"))
    leaf = ["_domain", "_lang", "_source"]
    leaves = keyed.groupBy(*[F.col(c).alias(c[1:]) for c in leaf]).agg(F.sum("_tokens").alias("tokens"))
    plan, _ = durable(leaf_targets(leaves.where("tokens > 0"), share=share, max_epochs=max_epochs, weights=weights))
    plan = plan.select(*[F.col(c[1:]).alias(c) for c in leaf], F.floor(F.col("target") / F.col("leaf_tokens")).cast("long").alias("_whole"), (F.col("target") % F.col("leaf_tokens")).alias("_rest"))
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_whole").cast("string"), F.col(id_col).cast("string")))
    drawn = keyed.join(broadcast_if_small(plan), leaf).withColumn("_code", code).withColumn("_range", F.substring("_code", 1, 3))
    sums = drawn.groupBy(*leaf, "_range", "_rest").agg(F.sum("_tokens").alias("_sum"))
    running = F.sum("_sum").over(Window.partitionBy(*leaf).orderBy("_range"))
    ends = sums.withColumn("_to", running).withColumn("_from", F.col("_to") - F.col("_sum"))
    # the first range that doesn't fit whole; all lower ones do
    ends, _ = durable(ends.where("_to > _rest").groupBy(*leaf).agg(F.min(F.struct("_range", "_from")).alias("_end")))
    ends = ends.select(*leaf, F.col("_end._range").alias("_last"), F.col("_end._from").alias("_base"))
    placed = drawn.join(broadcast_if_small(ends), leaf, "left")
    clear = placed.where(F.col("_last").isNull() | (F.col("_range") != F.col("_last"))).withColumn("_in", F.coalesce(F.col("_range") < F.col("_last"), F.lit(True)))
    within = Window.partitionBy(*leaf).orderBy("_code", F.col(id_col).cast("string")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(F.col("_range") == F.col("_last")).withColumn("_in", F.col("_base") + F.sum("_tokens").over(within) <= F.col("_rest"))
    copies = F.col("_whole") + F.when(F.col("_in") & (F.col("_rest") > 0), 1).otherwise(0)
    out = clear.unionByName(edge).withColumn("domain", F.col("_domain")).withColumn("n_tokens", F.col("_tokens")).withColumn("copies", copies.cast("long"))
    return back(out.where("copies > 0").drop(*[c for c in out.columns if c in {*leaf, "_tokens", "_whole", "_rest", "_code", "_range", "_last", "_base", "_in"}]))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return mix_sources(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(name: str, path: str, parent: str, budget: str, weight: str, source: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_n AS ({source}),
{name}_w AS (SELECT *, {weight} AS weight, capacity / ({weight}) AS ratio FROM {name}_n),
{name}_f AS (SELECT *, coalesce(ratio <= (({budget}) - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS is_full FROM {name}_w WINDOW o AS ({part} ORDER BY ratio, {path})),
{name}_t AS (SELECT *, coalesce(sum(capacity) FILTER (is_full) OVER ({part}), 0) AS taken, sum(weight) FILTER (NOT is_full) OVER ({part}) AS open FROM {name}_f),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity::DOUBLE ELSE coalesce(weight * ((({budget}) - taken) / open), 0.0) END AS granted FROM {name}_t)"""


def _case(column: str, weights: Mapping[str, float]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}::DOUBLE' for k, v in weights.items())} ELSE 1.0::DOUBLE END"


def oracle(documents: str = "documents", share: float = 0.7, max_epochs: int = 3, seed: int = 17) -> str:
    budget = f"(SELECT floor(sum(tokens) * {share}::DOUBLE)::DOUBLE FROM leaves)"
    return f"""
WITH keyed AS (
  SELECT doc_id, lang, source, CASE WHEN coalesce(regexp_extract(source, '([0-9])$', 1), '') = '' THEN 'none'
         ELSE 'tier' || (regexp_extract(source, '([0-9])$', 1)::INT % 4)::VARCHAR END AS d, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM {documents}),
leaves AS (SELECT d, l, s, sum(n)::BIGINT AS tokens, (sum(n) * {max_epochs})::BIGINT AS capacity FROM keyed GROUP BY ALL HAVING sum(n) > 0),
{_level_sql("a", "d", "", budget, _case("d", DOMAIN_WEIGHTS), "SELECT d, sum(capacity)::BIGINT AS capacity FROM leaves GROUP BY d")},
{_level_sql("b", "d, l", "d", "above", _case("l", LANG_WEIGHTS), "SELECT x.*, a.granted AS above FROM (SELECT d, l, sum(capacity)::BIGINT AS capacity FROM leaves GROUP BY d, l) x JOIN a USING (d)")},
{_level_sql("c", "d, l, s", "d, l", "above", "1.0::DOUBLE", "SELECT leaves.*, b.granted AS above FROM leaves JOIN b USING (d, l)")},
plan AS (SELECT d, l, s, floor(granted + 1e-6)::BIGINT // tokens AS whole, floor(granted + 1e-6)::BIGINT % tokens AS rest FROM c),
ordered AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY md5(concat_ws('|', '{seed}', whole::VARCHAR, doc_id::VARCHAR)), doc_id::VARCHAR
                                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed JOIN plan USING (d, l, s)),
chosen AS (SELECT doc_id, d AS domain, lang, source, n AS n_tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ordered)
SELECT * FROM chosen WHERE copies > 0
"""


ORACLE = oracle()
