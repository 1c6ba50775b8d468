"""Triples and recipe graphs as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.lineage import cut
from tidewheel.functions.sizes import shared


def reach(entities: DataFrame, triples: DataFrame, relation: str) -> DataFrame:
    """Distinct objects of ``entities`` (``s``) by one relation."""
    return triples.where(F.col("p") == relation).join(entities.select("s").distinct(), "s", "left_semi").select(F.col("o").alias("s")).distinct()


def one_type(result: DataFrame, *sets: DataFrame, kind) -> DataFrame:
    """``result`` of sets of entities (``s``), or an error where those are of more than one type, as ``kind`` of an entity tells."""
    every = sets[0].select("s")
    for other in sets[1:]:
        every = every.unionByName(other.select("s"))
    kinds = every.agg(F.count_distinct(kind(F.col("s"))).alias("_kinds"))  # one row
    wrong = F.raise_error(F.lit("the sets have entities of more than one type")).cast("boolean")
    return result.join(F.broadcast(kinds)).where(F.when(F.col("_kinds") > 1, wrong).otherwise(F.lit(True))).drop("_kinds")


def sources_of(objects: DataFrame, triples: DataFrame, relation: str) -> DataFrame:
    return triples.where(F.col("p") == relation).join(objects.select(F.col("s").alias("o")).distinct(), "o", "left_semi").select("s").distinct()


def relations(entities: DataFrame, triples: DataFrame) -> DataFrame:
    return triples.join(entities.select("s").distinct(), "s", "left_semi").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def connected(entities: DataFrame, targets: DataFrame, triples: DataFrame, hops: int) -> DataFrame:
    """Entities that reach a target within ``hops`` relations; distinct after each, so hubs don't multiply."""
    edges = triples.select("s", "o")
    front = entities.select("s", F.col("s").alias("at")).distinct()
    found = None
    for _ in range(hops):
        front = front.join(edges.withColumnRenamed("s", "_s"), F.col("at") == F.col("_s")).select("s", F.col("o").alias("at")).distinct()
        hit = front.join(targets.select(F.col("s").alias("at")), "at", "left_semi").select("s")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def extreme(triples: DataFrame, relation: str, greatest: bool = True) -> DataFrame:
    """Entities with the extreme numeric value of an attribute; ties are kept. An aggregate and a join, no global sort."""
    v = triples.where(F.col("p") == relation).select("s", F.col("o").try_cast("double").alias("v"))
    best = v.agg((F.max if greatest else F.min)("v").alias("_v"))
    return v.join(F.broadcast(best), F.col("v") == F.col("_v")).select("s", "v")  # best: one row


def chain_depth(edges: DataFrame, max_depth: int) -> DataFrame:
    """Longest chain of parts (``item, part``) below every item, up to ``max_depth``; a cycle ends at that depth.

    Level by level: an item is at depth d when one of its parts reaches d - 1. Only distinct items of the level are joined.
    """
    level = edges.select(F.col("item")).distinct()
    depth = level.withColumn("depth", F.lit(1))
    for d in range(2, max_depth + 1):
        level = edges.join(level.withColumnRenamed("item", "part"), "part", "left_semi").select("item").distinct()
        depth = depth.unionByName(level.withColumn("depth", F.lit(d)))
    return depth.groupBy("item").agg(F.max("depth").alias("depth"))


def base_materials(targets: DataFrame, recipes: DataFrame, ingredients: DataFrame, stock: DataFrame) -> DataFrame:
    """``target, item, needed``: what must be had to make each target's ``count`` of ``item`` beside the stock.

    ``recipes`` (``item, makes``) and ``ingredients`` (``item, part, uses``) are the first recipe of each item; ``stock``
    (``item, have``) covers a need whole or is taken from it. Needs go down level by level, each written before the
    next, until none is left to make; an item met again on its own path needs nothing more, so cycles end. Recipes
    with stock, and ingredients, are written once, and sent to all tasks only where their rows are few.
    """
    kind = dict(targets.dtypes)["item"]
    level = cut(targets.select("target", "item", F.col("count").cast("long").alias("count"), F.array().cast(f"array<{kind}>").alias("path")))
    facts, uses = shared(cut(recipes.join(stock.hint("merge"), "item", "full"))), shared(cut(ingredients))
    base = None
    while True:
        open_ = cut(level.join(facts, "item", "left").withColumn("lack", F.col("count") - F.coalesce("have", F.lit(0))).where("lack > 0"))
        found = open_.where("makes IS NULL").select("target", "item", F.col("lack").alias("needed"))
        base = found if base is None else base.unionByName(found)
        crafts = F.ceil(F.col("lack") / F.col("makes"))
        down = open_.where("makes IS NOT NULL").join(uses, "item").select("target", F.col("part").alias("item"), (crafts * F.col("uses")).cast("long").alias("count"), F.concat("path", F.array("item")).alias("path"))
        level = down.where(~F.array_contains("path", F.col("item")))
        if not level.limit(1).count():
            return base.groupBy("target", "item").agg(F.sum("needed").alias("needed"))


def recipe_chain(targets: DataFrame, ingredients: DataFrame) -> DataFrame:
    """``target, item, depth``: the recipes that a target's chain uses, from itself (0) down; an item on its own path ends it."""
    uses = shared(cut(ingredients.select("item", "part")))
    makes = shared(cut(ingredients.select("item").distinct()))
    level = cut(targets.select("target", "item").join(makes, "item", "left_semi").withColumn("path", F.array("item")))
    chain, d = level.select("target", "item", F.lit(0).alias("depth")), 0
    while level.limit(1).count():
        d += 1
        down = level.join(uses, "item").where(~F.array_contains("path", F.col("part"))).select("target", F.col("part").alias("item"), F.concat("path", F.array("part")).alias("path"))
        level = cut(down.join(makes, "item", "left_semi"))
        chain = chain.unionByName(level.select("target", "item", F.lit(d).alias("depth")))
    return chain


def tag_rules(tags: DataFrame, kinds: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``tag, how, pattern`` of each ``tag``: from ``kinds``, or for ``<wood>_logs`` and ``<wood>_stems`` that wood's logs and stems."""
    low = F.lower("tag")
    wood = F.regexp_replace(low, "_(logs|stems)$", "")
    own = F.lit(None).cast("array<struct<how:string,pattern:string>>")
    for name, rules in reversed(kinds.items()):
        own = F.when(low == name, F.array(*[F.struct(F.lit(h).alias("how"), F.lit(p).alias("pattern")) for h, p in rules])).otherwise(own)
    woods = F.array(*[F.struct(F.lit("starts").alias("how"), F.concat(wood, F.lit(end)).alias("pattern")) for end in ("_log", "_stem")])
    return tags.select("tag", F.explode(F.coalesce(own, F.when(low.rlike(".+_(logs|stems)$"), woods))).alias("r")).select("tag", "r.how", "r.pattern")


def tag_items(rules: DataFrame, items: DataFrame) -> DataFrame:
    """``tag, item``: items that match any rule of a tag. Each way of matching is an equi-join on the item's own starts or ends."""
    starts = F.transform(F.sequence(F.lit(1), F.length("item")), lambda n: F.substring(F.col("item"), F.lit(1), n))
    ends = F.transform(F.sequence(F.lit(1), F.length("item")), lambda n: F.right(F.col("item"), n))
    keys = F.concat(F.transform(starts, lambda x: F.struct(F.lit("starts").alias("how"), x.alias("pattern"))), F.transform(ends, lambda x: F.struct(F.lit("ends").alias("how"), x.alias("pattern"))), F.array(F.struct(F.lit("is").alias("how"), F.col("item").alias("pattern"))))
    each = items.select("item").distinct().where("length(item) > 0").select("item", F.explode(keys).alias("k")).select("item", "k.how", "k.pattern")
    return each.join(rules, ["how", "pattern"]).select("tag", "item").distinct()


def targets_met(targets: Column, stock: Column) -> Column:
    """1 where the stock (a map) has at least the count of every target (a map)."""
    return F.forall(F.map_entries(targets), lambda t: F.coalesce(F.try_element_at(stock, t["key"]), F.lit(0)) >= t["value"]).cast("int")
