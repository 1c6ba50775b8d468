"""Answer scoring and response parsing as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII punctuation, the articles, and the ranges of Chinese characters.
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
PUNCTUATION = "[!-/:-@\\[-`{-~]"
ARTICLES = "(?<![\\p{L}\\p{N}_])(a|an|the)(?![\\p{L}\\p{N}_])"


def normalize_answer(text: Column) -> Column:
    """Lower case, without punctuation, then without articles, then single blanks."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def answer_words(text: Column) -> Column:
    """Distinct lower-cased words, punctuation read as a blank."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), PUNCTUATION, " "), "\\s+"), lambda w: w != ""))


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("int")


def sub_match(prediction: Column, gold: Column) -> Column:
    return F.contains(normalize_answer(prediction), normalize_answer(gold)).cast("int")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the word sets; 0 where either is empty or they share nothing."""
    return word_f1(answer_words(prediction), answer_words(gold))


def word_f1(p: Column, g: Column) -> Column:
    """F1 of two sets of words (arrays)."""
    both = F.size(F.array_intersect(p, g))
    return F.when(both > 0, 2.0 * both / (F.size(p) + F.size(g))).otherwise(0.0)


def cover_match(prediction: Column, gold: Column) -> Column:
    """1 where every word of the gold answer is among the prediction's."""
    return (F.size(F.array_except(answer_words(gold), answer_words(prediction))) == 0).cast("int")


def matches_any(prediction: Column, golds: Column, *, inside: bool = False) -> Column:
    """1 where any gold answer equals the prediction (or is within it), True and False read as yes and no."""
    own = normalize_answer(yes_no(prediction))
    test = (lambda g: F.contains(own, normalize_answer(yes_no(g)))) if inside else (lambda g: normalize_answer(yes_no(g)) == own)
    return F.exists(golds, test).cast("int")


def yes_no(text: Column) -> Column:
    return F.when(text == "True", "yes").when(text == "False", "no").otherwise(text)


def cjk_tokens(text: Column) -> Column:
    """Distinct characters but digits, blanks and the stops ``，。,.-``, and runs of digits."""
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, PUNCTUATION, " ")), "\\s+", " "))
    return F.array_union(F.filter(F.split(F.regexp_replace(bare, "[0-9，。 ,.\\-]", ""), ""), lambda c: c != ""), F.regexp_extract_all(bare, F.lit("([0-9]+)"), F.lit(1)))


def token_f1_cjk(prediction: Column, gold: Column) -> Column:
    """F1 of the words, or of characters and digit runs where the gold answer has Chinese characters."""
    p, g = cjk_tokens(prediction), cjk_tokens(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when(gold.rlike(CJK), F.when(both > 0, 2.0 * both / (F.size(p) + F.size(g))).otherwise(0.0)).otherwise(token_f1(prediction, gold))


def best_over_golds(rows: DataFrame, items: DataFrame, *, block: int = 4096) -> DataFrame:
    """``best``: the greatest word F1 of each row's ``text`` with any ``gold`` of ``items``; 0 where none shares a word.

    The items are a stated query set: they go round in blocks of ``block``, each as an index from word to the items
    that have it, and a text's words are looked up there, so that no text meets an item that shares nothing. Null
    texts get 0.
    """
    number = items.count()
    out = rows.withColumn("_words", answer_words(F.col("text"))).drop("text").withColumn("best", F.lit(0.0))
    golds = items.select(answer_words(F.col("gold")).alias("w")).withColumn("_b", F.pmod(F.xxhash64("w"), F.lit(max(1, -(-number // block)))))
    for k in range(max(1, -(-number // block))):
        found = [r["w"] for r in golds.where(F.col("_b") == k).select("w").collect()]  # about ``block`` rows
        out = out.mapInArrow(_best_of(found), out.schema)
    return out.drop("_words")


def _best_of(golds: list[list[str]]):
    sizes = np.array([len(g or []) for g in golds], np.float64)
    index: dict[str, list[int]] = {}
    for i, words in enumerate(golds):
        for w in words or []:
            index.setdefault(w, []).append(i)
    index = {w: np.array(at) for w, at in index.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column("best").to_numpy().copy()
            for r, words in enumerate(batch.column("_words").to_pylist()):
                hits = [index[w] for w in words or [] if w in index]
                if hits:
                    shared = np.bincount(np.concatenate(hits), minlength=len(sizes))
                    best[r] = max(best[r], (2.0 * shared / (len(words) + sizes)).max())
            yield batch.set_column(batch.schema.get_field_index("best"), "best", pa.array(best))

    return run


def tool_call(text: Column, kinds: tuple[str, ...] = ("search", "access", "answer")) -> list[Column]:
    """``cut, kind, argument``: a text up to the end of its earliest complete call, and what that part calls.

    The kind is the first of ``kinds`` with a complete call in the part; without any the text stays whole.
    """
    ends = []
    for k in kinds:
        found = F.regexp_substr(text, F.lit(f"(?s)<{k}>.*?</{k}>"))
        ends.append(F.instr(text, found) + F.length(found) - 1)
    cut = F.coalesce(F.substring(text, F.lit(1), F.least(*ends)), text)
    kind, argument = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(kinds):
        has = cut.rlike(f"(?s)<{k}>.*?</{k}>")
        kind = F.when(has, k).otherwise(kind)
        argument = F.when(has, F.btrim(F.regexp_extract(cut, f"(?s)<{k}>(.*?)</{k}>", 1), F.lit(" \n\t\r"))).otherwise(argument)
    return [cut.alias("cut"), kind.alias("kind"), argument.alias("argument")]


def flatten_search(response: Column) -> Column:
    """The first query's passages of a search server's JSON with their scores; a passage's own score stays."""
    read = F.from_json(response, "results struct<passages:array<array<struct<text:string,source:string,score:double>>>,scores:array<array<double>>>")["results"]
    return F.transform(F.arrays_zip(F.get(read["passages"], F.lit(0)).alias("p"), F.get(read["scores"], F.lit(0)).alias("s")), lambda x: F.struct(x["p"]["text"].alias("text"), x["p"]["source"].alias("source"), F.coalesce(x["p"]["score"], x["s"]).alias("score")))


def regroup_metrics(metrics: Column, prefix: str, groups: dict[str, str], rest: str = "misc") -> Column:
    """A map whose keys under ``prefix`` are moved to the group of the first pattern that their rest begins with."""

    def key(k: Column) -> Column:
        tail, group = F.substring(k, F.lit(len(prefix) + 1), F.length(k)), F.lit(rest)
        for pattern, name in reversed(groups.items()):
            group = F.when(tail.startswith(pattern), name).otherwise(group)
        return F.when(k.startswith(prefix), F.concat(group, F.lit("/"), tail)).otherwise(k)

    return F.transform_keys(metrics, lambda k, _: key(k))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match's group; null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def balanced_tags(text: Column, tags: list[str]) -> Column:
    """As many closing as opening tags of every kind, and at most one of each."""
    ok = F.lit(True)
    for t in tags:
        ok = ok & (count_of(text, f"<{t}") == count_of(text, f"</{t}>")) & (count_of(text, f"</{t}>") <= 1)
    return ok
