"""Chunks of pages against a search from the start for every chunk, on broken and nested markup; parts of answers by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import pages


def by_searching(page):
    """Looks for the first chunk again and again in what is left of the page."""
    out = []
    while True:
        found = []
        for kind in ("title", "p", "li", "td", "tr"):
            at = 0
            while True:
                starts = [i for i in (page.find(f"<{kind}>", at), page.find(f"<{kind} ", at)) if i >= 0]
                end = page.find(f"</{kind}>", min(starts)) if starts else -1
                if end < 0:
                    break
                if kind != "li" or "\n" not in page[min(starts) : end]:
                    found.append((min(starts), end, kind))
                    break
                at = end
        if not found:
            return "".join(out)
        begin, end, kind = min(found)
        out.append(page[begin : end + len(f"</{kind}>")] + {"p": "\n\n", "li": "\n"}.get(kind, ""))
        page = page[end:]


def broken_page(rng):
    parts = ["<p>", "</p>", "<p class='a'>", "<li>", "</li>", "<li id=1>", "<td>", "</td>", "<tr>", "</tr>", "<title>", "</title>", "<pre>", "</pre>", "<b>", "</b>", "\n", "text", " ", "<", "</", "<p", "ü", "<tr/>", "</li", "<!-- <p> -->"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))


def test_chunks_of_broken_pages():
    rng = random.Random(12)
    for _ in range(20_000):
        page = broken_page(rng)
        assert pages.chunks_of(page) == by_searching(page), page


def test_reduce_page_in_spark(spark):
    rng = random.Random(13)
    rows = [(i, broken_page(rng)) for i in range(200)] + [(900, None), (901, ""), (902, "<p>" * 50_000), (903, "<li>a\nb</li>" * 20_000), (904, "<p>x</p>" * 20_000)]
    got = dict(spark.createDataFrame(rows, "k int, html string").repartition(3).select("k", pages.reduce_page("html")).collect())
    assert got[900] is None and got[902] == "" and got[903] == "" and got[904] == "<p>x</p>\n\n" * 20_000
    assert all(got[k] == by_searching(page) for k, page in rows[:200])


def test_parts_of_answers(spark):
    def of(column, *texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]

    assert of(lambda t: pages.last_between(t, "<title>", "</title>"), "a <title>x</title> b <title> y\n</title> <title>", "<title>a</title><title>z </title>", "no", "</title> a <title> rest", None) == ["", "z", None, "rest", None]
    assert of(pages.last_fence, "```json\n[1]\n``` and ```json [2] ```", "```json [3]", "``` [4] ```", "```json [5] ``` ```json open") == ["[2]", None, None, None]
    assert of(pages.python_code, "```python\nprint('a long enough line')\n```", "```py\nshort\n```", "plain text of more than twenty characters", "x", "```\nfirst block of enough length\n``` ```PYTHON\nsecond block of enough length\n```") == ["print('a long enough line')", None, "plain text of more than twenty characters", None, "second block of enough length"]
    assert of(lambda t: pages.python_code(t, markers=True), "<|im_start|>import os; print(os.getcwd())<|im_end|>", "plain text without any such word") == ["import os; print(os.getcwd())", None]
    assert of(pages.bracket_count, "[1] [2.5] [x]", "none") == ["2.5", ""]
    assert of(pages.bracket_or_number, "[a] [b c]", "1,234 and -5.5", "none", "[] 7") == ["b c", "-5.5", "", "7"]
    got = of(lambda t: pages.seconds_before(t, F.lit(1e6)), "12.5", "1970-01-02", "1970-01-01 00:00:10", "1970-02", "1.5d", "2h", "3 m ago", "4s", "5y", "soon")
    assert got == pytest.approx([12.5, 86400, 10, 31 * 86400, 1e6 - 129600, 1e6 - 7200, 1e6 - 180, 1e6 - 4, None, None])
