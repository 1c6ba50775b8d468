"""What is kept of pages and of models' answers about them: chunks of pages, tagged parts, fenced blocks and numbers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The elements of which chunks are kept, and what follows those of some.
KEPT = ("title", "p", "li", "td", "tr")
BEHIND = {"p": "\n\n", "li": "\n"}
_TAGS = re.compile(rf"<(?:({'|'.join(KEPT)})[> ]|/({'|'.join(KEPT)})>)")


def chunks_of(page: str) -> str:
    """Chunks of a page in order of their begin, each from an opening tag to the first closing tag of its name behind it.

    The next chunk begins behind the last one's text, so that a tag that is open when another closes isn't seen again
    and inner elements of a kept one are part of it. A list item with a line break isn't kept: the next one from its
    closing tag on is looked at. What never closes is left out. One scan lists the tags; each is then passed once.
    """
    opened: dict[str, list[int]] = {k: [] for k in KEPT}
    closed: dict[str, list[int]] = {k: [] for k in KEPT}
    for m in _TAGS.finditer(page):
        (opened[m[1]] if m[1] else closed[m[2]]).append(m.start())
    kept = {k: _kept(page, opened[k], closed[k], k) for k in KEPT}
    out, at, first = [], 0, dict.fromkeys(KEPT, 0)
    while True:
        ready = []
        for kind in KEPT:
            begins, i = opened[kind], first[kind]
            while i < len(begins) and begins[i] < at:
                i += 1
            first[kind] = i
            if i < len(begins) and kept[kind][i] is not None:
                ready.append((kept[kind][i], kind))
        if not ready:
            return "".join(out)
        (begin, at), kind = min(ready)
        out.append(page[begin : at + len(kind) + 3] + BEHIND.get(kind, ""))


def _kept(page: str, begins: list[int], ends: list[int], kind: str) -> list[tuple[int, int] | None]:
    """For each opening tag the chunk that a search from it on would keep: its own, or that of the first tag behind the end of one that isn't kept."""
    found: list[tuple[int, int] | None] = [None] * len(begins)
    j = len(ends)
    for i in range(len(begins) - 1, -1, -1):
        while j and ends[j - 1] > begins[i]:
            j -= 1
        if j < len(ends):
            own = begins[i], ends[j]
            if kind == "li" and page.find("\n", *own) >= 0:
                behind = bisect_left(begins, ends[j])
                found[i] = found[behind] if behind < len(begins) else None
            else:
                found[i] = own
    return found


@pandas_udf(StringType())
def reduce_page(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``chunks_of`` each page; null stays null."""
    for batch in pages:
        yield batch.map(lambda p: None if p is None else chunks_of(p))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def last_between(text: Column, opening: str, closing: str) -> Column:
    """What stands behind the last ``opening`` and before the first ``closing`` behind that, stripped; null where the text lacks one of them.

    Without a ``closing`` behind the last ``opening`` it is all that follows.
    """
    tail = F.substring_index(text, opening, -1)
    return F.when(F.contains(text, F.lit(opening)) & F.contains(text, F.lit(closing)), stripped(F.substring_index(tail, closing, 1)))


def last_fence(text: Column, kind: str = "json") -> Column:
    """The last fenced block of ``kind``, stripped; null without one that closes."""
    tail = F.substring_index(text, f"```{kind}", -1)
    return F.when(F.contains(text, F.lit(f"```{kind}")) & F.contains(tail, F.lit("```")), stripped(F.substring_index(tail, "```", 1)))


#: What tells text that isn't fenced from Python.
MARKERS = ("def ", "class ", "import ", "from ", "print(", "if __name__", "for ", "while ", "return ")


def python_code(text: Column, least: int = 20, markers: bool = False) -> Column:
    """The last fenced block of at least ``least`` characters, or else the whole text if it has as many; null otherwise.

    With ``markers`` chat tokens are cut first, and a whole text must look like Python.
    """
    source = stripped(F.regexp_replace(text, "<\\|[^>\\n]+?\\|>", "")) if markers else text
    blocks = F.filter(F.transform(F.regexp_extract_all(source, F.lit("(?is)```(?:python|py)?\\s*\\n?(.*?)\\n?```"), F.lit(1)), stripped), lambda b: F.length(b) >= least)
    whole = stripped(source)
    fits = F.length(whole) >= least
    if markers:
        looks = F.lit(False)
        for m in MARKERS:
            looks = looks | F.contains(whole, F.lit(m))
        fits = fits & looks
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.when(fits, whole))


def last_of(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def bracket_count(text: Column) -> Column:
    """The last number in brackets; empty without one."""
    return F.coalesce(last_of(text, "\\[([0-9.]+)\\]"), F.lit(""))


def bracket_or_number(text: Column) -> Column:
    """What the last brackets hold, or else the last number with its thousands put together; empty without either."""
    return F.coalesce(last_of(text, "\\[([^\\]]+)\\]"), last_of(F.replace(text, F.lit(","), F.lit("")), "(-?\\d*\\.?\\d+)"), F.lit(""))


def blended(score: Column, augmented: Column, weight: float = 0.7) -> Column:
    """``weight`` of a score and the rest of the better of it and the augmented answers'; the score alone without those (null)."""
    return F.when(augmented.isNull(), score).otherwise(score * weight + F.greatest(augmented, score) * (1 - weight))


def seconds_before(text: Column, now: Column) -> Column:
    """Seconds since 1970 of a number, a date with or without time or day, or a span (``1.5d``, ``2h``, ``3m``, ``4s``) before ``now``.

    Dates are in UTC. A span takes its first number and its first letters; null for another unit or no number.
    """
    date = F.coalesce(*[F.try_to_timestamp(F.when(text.rlike(shape), text), F.lit(form)) for shape, form in (("^\\d{4}-\\d{1,2}-\\d{1,2} \\d{1,2}:\\d{1,2}:\\d{1,2}$", "y-M-d H:m:s"), ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "y-M-d"), ("^\\d{4}-\\d{1,2}$", "y-M"))])
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), date.cast("timestamp_ntz")) / 1e6
    unit = F.regexp_extract(text, "([a-zA-Z]+)", 1)
    seconds = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1)
    number = F.when(F.trim(text).rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), F.trim(text).try_cast("double"))  # not "5d", which would be a number too
    return F.coalesce(number, at, now - F.regexp_extract(text, "([\\d.]+)", 1).try_cast("double") * seconds)
