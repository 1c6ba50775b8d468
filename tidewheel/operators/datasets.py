"""Preparing prompt datasets: answers, fields, tests, splits, negatives and goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform
from tidewheel.functions.ranking import place_within

#: The trailing request of prompts, and the page furniture of shopping states.
STEPS_SUFFIX = r"(?i)(\r?\n|\\n)*\s*Let'?s\s+think\s+step\s+by\s+step\s+and\s+output\s+the\s+final\s+answer\s+within\s*\\boxed\{\}\.\s*$"
GOAL_BUTTON = "\n[button] search [button_]"
PRICE_CLAUSE = ", and price lower than"


def clean_boxed(answer: Column) -> Column:
    """Without ``$\\boxed{`` and then without the trailing characters ``}`` and ``$``."""
    return F.regexp_replace(F.replace(answer, F.lit("$\\boxed{"), F.lit("")), "[}$]+$", "")


def first_nonblank(*columns: str) -> Column:
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in columns])


def one_supported_type(tests: Column, supported: tuple[str, ...]) -> Column:
    """Whether an array of test structs is non-empty and all of one supported type."""
    kinds = F.array_distinct(F.transform(tests, lambda t: t["type"]))
    return (F.size(tests) > 0) & (F.size(kinds) == 1) & F.element_at(kinds, 1).isin(*supported)


def normalize_tests(tests: Column) -> Column:
    """Inputs and outputs of the tests, as JSON."""
    return F.to_json(F.struct(F.transform(tests, lambda t: t["input"]).alias("inputs"), F.transform(tests, lambda t: t["output"]).alias("outputs")))


def normalize_test_text(text: Column) -> Column:
    """Tests in JSON text as JSON of inputs and outputs, with the function's name where they call one.

    Null where there are none, where kinds are mixed or unknown, and where calls don't agree on one name. A test without
    a kind that has an input and an output is one of a program.
    """
    tests = F.from_json(text, "array<struct<type:string,input:string,output:string,fn_name:string>>")
    kinds = F.array_distinct(F.transform(tests, lambda t: F.coalesce(t["type"], F.when(t["input"].isNotNull() & t["output"].isNotNull(), "stdin_stdout"))))
    names = F.array_distinct(F.transform(tests, lambda t: F.coalesce(t["fn_name"], F.lit(""))))
    whole = F.forall(tests, lambda t: t["input"].isNotNull() & t["output"].isNotNull())
    kind, name = F.try_element_at(kinds, F.lit(1)), F.try_element_at(names, F.lit(1))
    inputs, outputs = F.transform(tests, lambda t: t["input"]).alias("inputs"), F.transform(tests, lambda t: t["output"]).alias("outputs")
    one = (F.size(tests) > 0) & (F.size(kinds) == 1) & whole
    called = F.when((F.size(names) == 1) & (name != ""), F.to_json(F.struct(name.alias("fn_name"), inputs, outputs)))
    return F.when(one & (kind == "stdin_stdout"), F.to_json(F.struct(inputs, outputs))).when(one & (kind == "function_call"), called)


def split_contiguous(rows: DataFrame, keys: list[str], draw: Column, tie: str, parts: int) -> DataFrame:
    """``part``: contiguous parts of each key's rows in the order of a uniform draw; the last takes the remainder."""
    placed = place_within(rows.withColumn("_draw", draw), keys, F.floor(F.col("_draw") * 256), [F.col("_draw"), F.col(tie)], "_place", "_all")
    size = F.greatest(F.floor(F.col("_all") / parts), F.lit(1))
    return placed.withColumn("part", F.least(F.floor(F.col("_place") / size), F.lit(parts - 1)).cast("int")).drop("_draw", "_place", "_all")


def truncate_each(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key in source order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def sample_candidates(candidates: DataFrame, sample: str, positive: Column, item: str, rank: str, *, k: int, top: int, top_share: float = 0.8, negative_share: float = 0.2, seed: int = 0) -> DataFrame:
    """``k`` candidates of each sample with ``positive``: one right one and k - 1 others, or k others and no right one.

    In ``top_share`` of the samples that have any, the others are drawn from the negatives ranked below ``top``, else
    from the rest. A sample goes without a right one in ``negative_share`` of the cases, and where it has none; one
    whose others are missing keeps it. All draws are by hash.
    """
    u = lambda what: hash_uniform(seed, what, F.col(sample))
    marked = candidates.withColumns({"_pos": F.coalesce(positive, F.lit(False)), "_top": F.col(rank) < top})
    facts = marked.groupBy(sample).agg(F.max("_pos").alias("_has"), F.coalesce(F.max(~F.col("_pos") & F.col("_top")), F.lit(False)).alias("_some"), F.coalesce(F.max(~F.col("_pos") & ~F.col("_top")), F.lit(False)).alias("_rest"))
    facts = facts.withColumn("_near", (u("pool") < top_share) & F.col("_some"))
    facts = facts.withColumn("_right", F.col("_has") & ((u("right") > negative_share) | ~F.when(F.col("_near"), F.col("_some")).otherwise(F.col("_rest"))))
    usable = marked.join(facts, sample).where((F.col("_pos") & F.col("_right")) | (~F.col("_pos") & (F.col("_top") == F.col("_near"))))
    place = F.row_number().over(Window.partitionBy(sample, "_pos").orderBy(hash_uniform(seed, F.col(sample), F.col(item)), item))
    most = F.when(F.col("_pos"), 1).otherwise(F.when(F.col("_right"), k - 1).otherwise(k))
    return usable.withColumn("_r", place).where(F.col("_r") <= most).withColumn("positive", F.col("_pos")).drop("_pos", "_top", "_has", "_some", "_rest", "_near", "_right", "_r")


def expand_options(rows: DataFrame, options: list[str]) -> DataFrame:
    """One row for every combination of the option arrays, however many; none where an option has no value."""
    out = rows
    for o in options:
        out = out.withColumn(o, F.explode(o))
    return out


def numbered(rows: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """``name``: the position of each row from 0 by the numeric column ``order``, without gaps and without one sorted partition.

    Quantiles cut the order into ranges; a range's rows are numbered in it, behind the count of all before. Nulls come first; equal values are numbered in any order.
    """
    cuts = sorted(set(rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    bucket = F.lit(0)
    if cuts:
        bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))), F.lit(0))
    return place_within(rows, [], F.when(F.col(order).isNull(), -1).otherwise(bucket), [F.col(order)], name)


def strip_suffix(text: Column) -> Column:
    """Without a trailing request to reason in steps and to box the answer, whatever its case and line breaks."""
    return F.regexp_replace(text, STEPS_SUFFIX, "")


def prompt_messages(problem: Column) -> Column:
    """A problem as the messages of a chat: one of the user's."""
    return F.array(F.struct(F.lit("user").alias("role"), problem.alias("content")))


def code_question(content: Column, starter: Column, intro: str, starter_format: Column, stdin_format: str) -> Column:
    """A coding problem with the format that its answer must have; ``starter_format`` already holds the starter code."""
    how = F.when(F.length(F.trim(F.coalesce(starter, F.lit("")))) > 0, starter_format).otherwise(F.lit(stdin_format))
    return F.concat(F.lit(f"{intro}\n\n### Question:\n"), F.trim(F.coalesce(content, F.lit(""))), F.lit("\n\n### Format: "), how, F.lit("\n\n### Answer: (use the provided format with backticks)\n\n\n"))


def code_cases(public: Column, private: Column, metadata: Column) -> Column:
    """Public and then private JSON cases as JSON of inputs and outputs: with the function's name, or lines of a program."""
    read = lambda c: F.coalesce(F.from_json(c, "array<struct<input:string,output:string>>"), F.array())
    cases = F.concat(read(public), read(private))
    name = F.get_json_object(metadata, "$.func_name")
    line = lambda x: F.when(x.endswith("\n"), x).otherwise(F.concat(x, F.lit("\n")))
    called = F.to_json(F.struct(F.transform(cases, lambda x: x["input"]).alias("inputs"), F.transform(cases, lambda x: x["output"]).alias("outputs"), name.alias("fn_name")))
    piped = F.to_json(F.struct(F.transform(cases, lambda x: line(x["input"])).alias("inputs"), F.transform(cases, lambda x: line(x["output"])).alias("outputs"), F.lit(False).alias("remote")))
    return F.when(F.coalesce(name, F.lit("")) != "", called).otherwise(piped)


def goal_searches(goals: DataFrame, searches: str, known: DataFrame, first: int, last: int | None) -> DataFrame:
    """A row for each search of a cleaned ``goal`` that is among ``known`` (``goal, place``) at a place of [first, last)."""
    inside = F.col("place") >= first if last is None else F.col("place").between(first, last - 1)
    at = known.groupBy("goal").agg(F.min("place").alias("place")).where(inside)
    return goals.select("goal", F.explode(searches).alias("search")).join(at.select("goal"), "goal", "left_semi")


def clean_goal(text: Column, headers: list[str]) -> Column:
    """Lower case, without quotes, page ``headers`` (lower case) and the search button, up to the clause about the price."""
    bare = F.regexp_replace(F.lower(text), "[\"']", "")
    for part in [*headers, GOAL_BUTTON]:
        bare = F.replace(bare, F.lit(part), F.lit(""))
    return F.split_part(F.btrim(bare, F.lit(" \n\t\r")), F.lit(PRICE_CLAUSE), F.lit(1))
