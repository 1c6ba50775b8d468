"""Catalogues: first rows, inverted indexes, TF-IDF terms, shares and weighted draws."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidewheel.functions.hashing import hash_uniform
from tidewheel.functions.lineage import cut
from tidewheel.functions.sizes import shared


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in source order, by a combining aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ngrams(text: Column, stop: Column, most: int = 2) -> Column:
    """Lower-cased words of two characters or more that are neither in ``stop`` nor a number of 0 to 999, and runs of up to ``most`` of those left."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]{2,})"), F.lit(1)), lambda w: ~F.array_contains(stop, w) & ~w.rlike("^(0|[1-9][0-9]{0,2})$"))

    def run(ws: Column, n: int) -> Column:
        return F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(0))), lambda w, i: F.array_join(F.slice(ws, i + 1, F.lit(n)), " "))

    # as the one element of an array the words are found once, not for every run
    return F.transform(F.array(words), lambda ws: F.concat(ws, *[run(ws, n) for n in range(2, most + 1)]))[0]


def tfidf_terms(items: DataFrame, k: int, *, category: str = "category", features: int = 1000) -> DataFrame:
    """The ``k`` terms of greatest TF-IDF of each item (``item, category, terms``) within its category.

    A category's ``features`` most frequent terms count; weights are smoothed and scaled to unit length. Frequencies are
    written once, since document frequencies and weights both read them.
    """
    tf = items.select("item", category, F.explode("terms").alias("term")).groupBy("item", category, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(tf)
    n = items.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy(category, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("cf"), "term"))).where(F.col("_r") <= features)
    w = tf.join(shared(df.select(category, "term", "df")), [category, "term"]).join(shared(n), category).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(category, "item")))
    scored = w.withColumn("tfidf", F.round(F.col("w") / norm, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(category, "item").orderBy(F.desc("tfidf"), "term"))).where(F.col("rank") <= k).select("item", category, "term", "tfidf", "rank")


def top_share(ranked: DataFrame, items: DataFrame, category: str = "category") -> DataFrame:
    """For each category the share of its items that have a term among their best."""
    n = items.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return ranked.groupBy(category, "term").agg(F.count(F.lit(1)).alias("have")).join(n, category).select(category, "term", (F.col("have") / F.col("n")).alias("share"))


def page_of(rows: DataFrame, keys: list[str], order: list[Column], page: int, size: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank").between((page - 1) * size + 1, page * size))


#: Items that a slot of a key's weights has on average, and the width of the key ranges in which they are summed.
SLOT_ITEMS, ITEM_RANGE = 64, 1 << 16


def weighted_draws(rows: DataFrame, keys: list[str], item: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` items (whole numbers) of each key with probability in proportion to weight, which is 0 or more.

    An item has a stretch of its key's summed weights, by the sums of the ranges before its own and the running sum
    within it; a key's whole length is cut into slots of ``SLOT_ITEMS`` items on average. A draw is a point, which
    meets the stretches of its slot only. A key without weight gives nothing.
    """
    ranged = rows.select(*keys, item, F.col(weight).cast("double").alias("_w"), F.floor(F.col(item) / ITEM_RANGE).alias("_r"))
    sums = ranged.groupBy(*keys, "_r").agg(F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.sum("_sum").over(group.orderBy("_r")) - F.col("_sum")
    ahead = sums.select(*keys, "_r", before.alias("_before"), F.sum("_sum").over(group).alias("_all"), F.ceil(F.sum("_n").over(group) / SLOT_ITEMS).alias("_slots")).where("_all > 0")
    own = F.sum("_w").over(Window.partitionBy(*keys, "_r").orderBy(item))
    placed = ranged.withColumn("_own", own).join(ahead, [*keys, "_r"]).withColumn("_to", F.col("_before") + F.col("_own")).withColumn("_from", F.col("_to") - F.col("_w"))
    slot = lambda at: F.least(F.floor(at / F.col("_all") * F.col("_slots")), F.col("_slots") - 1)
    stretches = placed.where("_w > 0").select(*keys, item, "_from", "_to", F.explode(F.sequence(slot(F.col("_from")), slot(F.col("_to")))).alias("_slot"))
    drawn = ahead.select(*keys, "_all", "_slots").distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    points = drawn.withColumn("_at", hash_uniform(seed, *[F.col(k) for k in keys], F.col("draw")) * F.col("_all"))
    points = points.select(*keys, "draw", "_at", slot(F.col("_at")).alias("_slot"))
    return points.join(stretches, [*keys, "_slot"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select(*keys, "draw", item)


def parse_price(text: Column) -> list[Column]:
    """``pricing``: up to two prices behind the dollar signs of a text, 100 where there is none; ``price_tag``: how they are shown."""
    behind = F.slice(F.split(text, "\\$"), 2, 1 << 20)
    parts = F.filter(F.transform(behind, lambda p: F.regexp_replace(p, "[^0-9.]", "").try_cast("double")), lambda p: p.isNotNull())
    prices = F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.slice(parts, 1, 2)).otherwise(F.array(F.lit(100.0)))
    shown = F.transform(prices, lambda p: F.concat(F.lit("$"), p.cast("string")))
    return [prices.alias("pricing"), F.array_join(shown, " to ").alias("price_tag")]


def clean_options(options: Column) -> Column:
    """Options of a product (``map<string, array<struct<value, image>>>``) by their lower-cased names: trimmed, lower-cased values, slashes as bars.

    Options without contents are left out; of names that differ by case only the last one stays.
    """
    told = F.filter(F.map_entries(options), lambda e: e["value"].isNotNull())
    value = lambda c: F.lower(F.replace(F.trim(c["value"]), F.lit("/"), F.lit(" | ")))
    cleaned = F.transform(told, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.transform(e["value"], value).alias("value")))
    last = F.filter(cleaned, lambda e, i: ~F.exists(F.slice(cleaned, i + 2, F.greatest(F.size(cleaned), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def option_images(options: Column) -> Column:
    """The image of each option's value (as ``clean_options`` writes them); of equal values the last one's."""
    value = lambda c: F.lower(F.replace(F.trim(c["value"]), F.lit("/"), F.lit(" | ")))
    pairs = F.flatten(F.transform(F.filter(F.map_values(options), lambda v: v.isNotNull()), lambda v: F.transform(v, lambda c: F.struct(value(c).alias("key"), c["image"].alias("value")))))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def option_text(options: Column) -> Column:
    """``name: value, value, and name: value`` of cleaned options."""
    said = F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    return F.array_join(said, ", and ")


def known_products(products: DataFrame, key: str, dropped: list[str]) -> DataFrame:
    """Products without the columns ``dropped`` and without those whose key is ``nan`` or over ten characters."""
    return products.where((F.col(key) != "nan") & (F.length(key) <= 10)).drop(*dropped)


def search_contents(title: Column, description: Column, bullets: Column, options: Column) -> Column:
    """The lower-cased text that a product is found by: title, description, first bullet and options."""
    first = F.coalesce(F.try_element_at(bullets, F.lit(1)), F.lit(""))
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), first, option_text(options)))


def postings(rows: DataFrame, term: str, item: str, width: int) -> DataFrame:
    """``term, block, items``: the sorted items of each term, in blocks of ``width`` keys, of which none has more items than that."""
    blocked = rows.withColumn("block", F.floor(F.col(item) / width))
    return blocked.groupBy(term, "block").agg(F.sort_array(F.collect_set(item)).alias("items"))


def lookup(items: DataFrame, queries: DataFrame, *, draws: int, seed: int) -> DataFrame:
    """``query_id, item``: what a query's ``mode`` and ``value`` find: ``<a>`` an attribute, ``<c>`` a category, ``<q>`` a query; ``<r>`` ``draws`` items by hash.

    Attributes are exploded and joined by value like the other keys; a random query takes its items by the order of
    a hash, a bounded top of each task first.
    """
    keys = F.concat(F.transform("attributes", lambda a: F.struct(F.lit("<a>").alias("mode"), a.alias("value"))), F.array(F.struct(F.lit("<c>").alias("mode"), F.col("category").alias("value")), F.struct(F.lit("<q>").alias("mode"), F.col("query").alias("value"))))
    found = items.select("item", F.explode(keys).alias("k")).select("item", "k.mode", "k.value").distinct().join(queries, ["mode", "value"]).select("query_id", "item")
    best = items.select("item", hash_uniform(seed, F.col("item")).alias("u")).orderBy("u", "item").limit(draws).select("item")
    return found.unionByName(queries.where("mode = '<r>'").select("query_id").join(F.broadcast(best)))  # best: ``draws`` rows


def category_match(own: Column, wanted: Column) -> Column:
    """Whether two paths of categories share at least two distinct ones, in any order."""
    parts = lambda c: F.array_distinct(F.transform(F.split(c, "›"), lambda x: F.trim(x)))
    return F.size(F.array_intersect(parts(own), parts(wanted))) >= 2


def type_reward(query_match: Column, categories: Column, own: Column, wanted: Column) -> Column:
    """1, .5, .1 or 0 by query, categories and the share of the wanted name's nouns (arrays) that the own name has."""
    nouns = F.array_distinct(F.transform(wanted, lambda w: F.lower(w)))
    share = F.when(F.size(wanted) == 0, 0.2).otherwise(F.size(F.array_intersect(nouns, F.transform(own, lambda w: F.lower(w)))) / F.size(wanted))
    return F.when(share == 0, 0.0).when(share < 0.1, 0.1).when(query_match | categories | (share > 0.2), 1.0).otherwise(0.5)


def purchase_reward(rows: DataFrame, *, similar: float = 85.0) -> DataFrame:
    """``r_type, attributes_met, options_met, reward`` of a purchase against its goal.

    Columns of the purchase: ``query, categories, nouns, attributes, texts`` (array), ``options, price``; of the goal:
    the same with ``goal_`` in front and ``goal_price`` as the most it may cost (0: no bound, and then no reward). A
    wanted attribute is met by one like it or by a text with it, an option by one like it.
    """
    near = lambda wanted, own: like_any(F.col(wanted), F.col(own), F.lit(similar))
    made = rows.withColumn("_attributes", near("goal_attributes", "attributes")).withColumn("_options", near("goal_options", "options"))
    said = lambda g: F.exists("texts", lambda t: F.contains(F.lower(t), g))
    made = made.withColumn("attributes_met", F.size(F.filter("goal_attributes", lambda g: F.array_contains("_attributes", g) | said(g)))).withColumn("options_met", F.size("_options"))
    made = made.withColumn("r_type", type_reward(F.col("query") == F.col("goal_query"), category_match(F.col("categories"), F.col("goal_categories")), F.col("nouns"), F.col("goal_nouns")))
    cheap = F.when(F.col("goal_price") > 0, (F.col("price") <= F.col("goal_price")).cast("int"))
    parts = F.size("goal_attributes") + F.size("goal_options") + 1
    return made.withColumn("reward", (F.col("attributes_met") + F.col("options_met") + cheap) / parts * F.col("r_type")).drop("_attributes", "_options")


@F.pandas_udf(ArrayType(StringType()))
def like_any(wanted: pd.Series, own: pd.Series, similar: pd.Series) -> pd.Series:
    """The wanted strings whose token-set ratio with one of the own is over ``similar``."""
    return pd.Series([[g for g in w if any(token_set_ratio(p, g) > s for p in o)] for w, o, s in zip(wanted, own, similar, strict=True)])


def token_set_ratio(a: str, b: str) -> float:
    """Greatest similarity (twice the common subsequence over both lengths, in hundredths) of what two word sets share and each as a whole."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(p for p in (both, " ".join(sorted(z))) if p) for z in (x - y, y - x))
    pairs = [(left, right)] + ([(both, left), (both, right)] if both else [])
    return max(200.0 * _common(p, q) / (len(p) + len(q)) for p, q in pairs)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def fingerprint(rows: DataFrame, texts: list[Column], levels: int = 6) -> DataFrame:
    """``fingerprint, rows`` of a table whatever its order: digests of rows, gathered by prefixes of ``levels`` hexadecimal digits and then of one less each time.

    A gathering holds the rows of one long prefix (a 16^levels-th of all) or 16 digests, never a share of the table.
    An empty table has no row.
    """
    digest = F.md5(F.array_join(F.sort_array(F.collect_list("m")), ","))
    level = rows.select(F.md5(F.concat_ws(",", *texts)).alias("m")).groupBy(F.substring("m", 1, levels).alias("p")).agg(digest.alias("m"), F.count(F.lit(1)).alias("n"))
    for k in range(levels - 1, -1, -1):
        level = level.groupBy(F.substring("p", 1, k).alias("p")).agg(digest.alias("m"), F.sum("n").alias("n"))
    return level.select(F.col("m").alias("fingerprint"), F.col("n").alias("rows"))
