"""Agent traces and judgements: parsing, rewards and metrics as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size patterns in the order in which they are tried.
SIZES = [
    "xx-large", "3x-large", "4x-large", "5x-large", "x-large", "x-small", "medium", "large", "small", "queen", "twin", "full", "king", "one size", "pack",
    "(.*)neck(.*)sleeve", r"(.*) women \| (.*) men", "(.*)w x(.*)l", "(.*)w by (.*)l", "(.*)w x(.*)h", "(.*)wide", "(.*)x-wide", "(.*)narrow", "(.*)petite", "(.*)inch", "(.*)plus", "(.*)mm",
    "women(.*)", "(.*)x(.*)", "(.*)ft", "(.*)feet", "(.*)meter", "(.*)yards", r"(.*)\*(.*)", r"(.*)\-(.*)", r'(\d+)"$', r"(\d+)f$", r"(\d+)m$", r"(\d+)cm$", r"(\d+)g$",
]


def turn_discount(reward: Column, turns: Column, d: float) -> Column:
    return reward * F.pow(F.lit(d), turns)


def depth_weight(reward: Column, depth: Column) -> Column:
    return reward / (depth + 1)


def selector_reward(parsed: Column, right: Column) -> Column:
    """0 for what can't be parsed, 1 for a right choice, else a half."""
    return F.when(~parsed, 0.0).when(right, 1.0).otherwise(0.5)


def router_reward(parsed: Column, to_large: Column, small_right: Column, large_right: Column) -> Column:
    """-0.5 for no route; 1 for the smaller model where it is right; the larger pays where only it is right."""
    return F.when(~parsed, -0.5).when(~to_large & small_right, 1.0).when(to_large & large_right & ~small_right, 1.0).when(to_large & large_right, 0.5).otherwise(0.0)


def testgen_reward(valid: Column, agrees: Column) -> Column:
    return 0.5 * (valid.cast("double") + (valid & agrees).cast("double"))


def verdict(text: Column) -> Column:
    """correct, incorrect or invalid, from JSON or else from the words of a judgement."""
    given = F.lower(F.coalesce(F.get_json_object(text, "$.judgement"), F.lit("")))
    low = F.lower(text)
    return F.when(given.isin("correct", "incorrect"), given).when(low.contains("incorrect"), "incorrect").when(low.contains("correct"), "correct").otherwise("invalid")


def clamp_score(score: Column) -> Column:
    """Within 0 and 1; 0 for what isn't a number."""
    x = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def action(text: Column) -> tuple[Column, Column]:
    """Name and argument of ``name[arg]``."""
    return F.regexp_extract(text, "([a-z_]+)\\[(.*?)\\]", 1), F.regexp_extract(text, "([a-z_]+)\\[(.*?)\\]", 2)


def metric_means(rows: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """Mean of every metric over the episodes that emitted it."""
    return rows.select(*keys, F.explode(metrics).alias("metric", "value")).groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("episodes"))


def conditional_rate(flag: Column, given: Column) -> Column:
    """Share of ``flag`` among rows with ``given``; null without any."""
    return F.avg(F.when(given, flag.cast("double")))


def complete_groups(episodes: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """Episodes of groups in which none failed."""
    return episodes.join(episodes.where(failed).select(*keys).distinct(), keys, "left_anti")


def recall_at(positions: Column, ks: list[int]) -> list[Column]:
    """Share of samples whose best positive has a rank below each k."""
    return [F.avg((F.coalesce(F.array_min(positions), F.lit(1 << 30)) < k).cast("double")).alias(f"recall_{k}") for k in ks]


def since_seconds(text: Column) -> Column:
    """Seconds of spans like ``2d``, ``3h``, ``5m``, ``7s`` and their sequences."""
    unit = lambda u, n: F.coalesce(F.regexp_extract(text, f"(\\d+){u}", 1).try_cast("long"), F.lit(0)) * n
    return unit("d", 86400) + unit("h", 3600) + unit("m", 60) + unit("s", 1)


def first_colour(text: Column, colours: list[str], missing: str | None = None) -> Column:
    """The first of the ordered colours that the text contains; ``missing``, or else the text itself, where it has none."""
    found = F.lit(None).cast("string")
    for c in reversed(colours):
        found = F.when(F.contains(text, F.lit(c)), c).otherwise(found)
    return F.coalesce(found, text if missing is None else F.lit(missing))


def size_kind(text: Column) -> Column:
    """The first of the ordered size patterns found in the lower-cased text; ``numeric_size`` for a number, else ``not_matched``."""
    low = F.lower(text)
    found = F.when(low.rlike("^([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), "numeric_size").otherwise("not_matched")
    for p in reversed(SIZES):
        found = F.when(low.rlike(p), p).otherwise(found)
    return found


def pack_offsets(rows: DataFrame, batch: str, order: str, tokens: str) -> DataFrame:
    """Where each sequence lies in its packed batch: lengths summed in order."""
    from pyspark.sql import Window

    upto = F.sum(F.size(tokens)).over(Window.partitionBy(batch).orderBy(order))
    return rows.withColumn("end", upto).withColumn("start", F.col("end") - F.size(tokens))


def reduce_html(html: Column, tags: tuple[str, ...] = ("title", "h1", "p", "li", "td")) -> Column:
    """The texts of the chosen elements in document order, one a line, without inner tags."""
    body = F.regexp_replace(F.regexp_replace(html, "(?s)<(script|style)\\b.*?</(script|style)>", ""), "(?s)<!--.*?-->", "")
    parts = F.regexp_extract_all(body, F.lit(f"(?s)<(?:{'|'.join(tags)})(?: [^>]*)?>(.*?)(?=</?(?:{'|'.join(tags)})[ >])"), F.lit(1))
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), "\\s+", " ")))
    return F.array_join(F.filter(plain, lambda p: p != ""), "\n")


def shell_action(text: Column) -> list[Column]:
    """``action, content`` of a turn of ``Think:`` and ``Act:`` lines: the last act that says bash, finish or answer(...).

    Bash takes the fenced scripts of the turn; an answer without parentheses isn't one.
    """
    acts = F.reverse(F.regexp_extract_all(text, F.lit("Act:\\s*(.+)"), F.lit(1)))
    said = F.transform(acts, lambda a: F.when(F.lower(a).startswith("bash"), F.struct(F.lit("bash").alias("k"), F.lit(None).cast("string").alias("c"))).when(F.lower(a).startswith("finish"), F.struct(F.lit("commit").alias("k"), F.lit(None).cast("string").alias("c"))).when(F.lower(a).startswith("answer") & a.rlike("\\([^\\n]*\\)"), F.struct(F.lit("commit").alias("k"), F.regexp_extract(a, "\\((.*)\\)", 1).alias("c"))))
    first = F.try_element_at(F.filter(said, lambda x: x.isNotNull()), F.lit(1))
    scripts = F.array_join(F.regexp_extract_all(text, F.lit("(?s)```bash\\n(.*?)\\n```"), F.lit(1)), "\n\n")
    return [first["k"].alias("action"), F.when(first["k"] == "bash", scripts).otherwise(first["c"]).alias("content")]


def choice_action(text: Column) -> list[Column]:
    """``option, action`` of ``Answer:``, ``Action:`` and ``Value:`` lines: option A where none is named."""
    option = F.regexp_extract(text, "Answer: (A|B|C|D|E|F)", 1)
    act, value = F.regexp_extract(text, "Action: (CLICK|SELECT|TYPE)", 1), F.regexp_extract(F.trim(text), "(?m)Value: (.*)$", 1)
    return [F.when(option == "", "A").otherwise(option).alias("option"), F.concat(act, F.lit(" "), F.trim(value)).alias("action")]


def search_format(text: Column) -> Column:
    """Whether every kind of call is closed as often as opened, at most one is made, no speaker is named and thinking ends at most once."""
    n = lambda part: (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    kinds = ("search", "access", "answer")
    ok = n("</think>") <= 1
    for k in kinds:
        ok = ok & (n(f"<{k}>") == n(f"</{k}>"))
    return ok & (sum((n(f"<{k}>") for k in kinds), F.lit(0)) <= 1) & ~F.contains(text, F.lit("Assistant")) & ~F.contains(text, F.lit("assistant"))


def retry_discount(turns: Column, d: float) -> Column:
    """The first reward of the turns' (an array) that isn't 0, discounted once for each failed turn before it; 0 where all fail."""
    at = F.array_position(F.transform(turns, lambda r: r != 0), True)
    return F.when(at > 0, F.get(turns, (at - 1).cast("int")) * F.pow(F.lit(d), at - 1)).otherwise(0.0)


def unique_tasks(rows: DataFrame, key: str, targets: str, stock: str) -> DataFrame:
    """The least ``key`` of each pair of targets and stock (maps of counts), whatever the order of their entries, with ``copies``."""
    form = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    return rows.groupBy(form(targets).alias("targets"), form(stock).alias("stock")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
