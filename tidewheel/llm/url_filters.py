"""Temporal URL list join with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.tables import broadcast_if_small

#: Scheme, optional user info, host, optional port, path.
URL = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def url_host(url: str | Column) -> Column:
    """Lower-cased host without a trailing dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), "\\.$", "")
    return F.when(host != "", host)


def url_keys(url: str | Column) -> Column:
    """All list keys that cover a URL: the host and its parent domains, then host and path prefixes by segment."""
    url = F.col(url) if isinstance(url, str) else url
    host = url_host(url)
    labels = F.split(host, "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda s: s != "")
    some = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments)))
    prefixes = F.transform(some, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host.isNotNull(), F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (``list_name, key, action, at``) as intervals [``valid_from``, ``valid_to``), open at the end when null.

    An ``add`` holds until the next entry of its list and key; of several at one time, ``remove`` wins. Entries
    without list, key or time say nothing and are left out; repeated entries count once.
    """
    once = entries.where("list_name IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").groupBy("list_name", "key", "at").agg(F.max("action").alias("action"))
    following = F.lead("at").over(Window.partitionBy("list_name", "key").orderBy("at"))
    return once.withColumn("valid_to", following).where("action = 'add'").select("list_name", "key", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, *, allow: str = "allow") -> DataFrame:
    """Every capture (``page_id, url, fetched_at``) against the entries active when it was fetched.

    The as-of join is an equi-join on list key with the fetch time in the interval: keys are exploded from the
    captures, and the list side is broadcast only when a count finds it small; otherwise the join shuffles and
    adaptive execution splits a domain that a third of the captures share. The most specific (longest) key decides,
    ``allow`` before other lists on a tie, then the list's name. Repeated captures are one row with ``n_rows``.
    A URL without host, or a null time, matches nothing and is not blocked. Other columns of the captures are left
    out: rows that differ in them alone are the same capture.
    """
    at = F.col("fetched_at")
    once = captures.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = once.withColumn("_key", F.explode_outer(F.array_distinct(url_keys("url"))))
    spans = broadcast_if_small(validity_intervals(entries).withColumnRenamed("key", "_listed"))
    active = keyed.join(spans, (F.col("_key") == F.col("_listed")) & (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))), "left")
    rank = F.struct(F.length("_listed").alias("len"), (F.col("list_name") == allow).alias("allowed"), F.col("list_name").alias("list"), F.col("_listed").alias("key"), F.col("valid_from").alias("since"))
    found = active.groupBy("page_id", "url", "fetched_at", "n_rows").agg(
        F.count("_listed").alias("n_active"), F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists"), F.max(F.when(F.col("_listed").isNotNull(), rank)).alias("_best")
    )
    return found.select(
        "page_id", "url", url_host("url").alias("host"), "fetched_at", "n_rows", "n_active", "lists", F.col("_best.key").alias("matched_key"), F.col("_best.list").alias("matched_list"),
        F.col("_best.since").alias("listed_since"), F.coalesce(F.col("_best.list") != allow, F.lit(False)).alias("blocked"),
    )


def _draw(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def _day(text: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), _draw(text, 366).cast("int"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, fetched on a day of 2024 that the URL's hash names: the table has no fetch times."""
    return pages.select("page_id", "url", _day(F.coalesce("url", F.lit(""))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts, parent domains and path prefixes that occur in ``pages``.

    Every key of two labels and every fourth other key is listed, four entries each (added, removed, added again,
    removed), on days and on a list that the key's hash names.
    """
    keys = pages.select(F.explode(F.array_distinct(url_keys("url"))).alias("key")).distinct()
    labels = F.size(F.split("key", "\\."))
    chosen = keys.where(F.col("key").contains(".")).where((_draw(F.col("key"), 4) == 0) | ((labels == 2) & ~F.col("key").contains("/")))
    name = F.element_at(F.array(F.lit("allow"), F.lit("malware"), F.lit("spam")), (_draw(F.concat(F.lit("list:"), "key"), 3) + 1).cast("int"))
    turn = chosen.select("key", name.alias("list_name"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    return turn.select("list_name", "key", F.when(F.col("i") % 2 == 0, "add").otherwise("remove").alias("action"), _day(F.concat("key", F.lit(":"), F.col("i").cast("string"))).alias("at"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = filter_captures(captures_of(pages), entries_of(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "listed_since")})


_RE = URL.replace("'", "''")
ORACLE = f"""
WITH p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '{_RE}', 1)), '\\.$', ''), '') AS host,
                  list_filter(string_split(regexp_extract(url, '{_RE}', 2), '/'), lambda s: s <> '') AS seg,
                  DATE '2024-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 8))::BIGINT % 366)::INT AS fetched_at FROM pages),
once AS (SELECT page_id, url, host, seg, fetched_at, count(*) AS n_rows FROM p GROUP BY ALL),
k AS (SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1:i], '/')))) AS key
      FROM once WHERE host IS NOT NULL),
ks AS (SELECT DISTINCT key FROM k WHERE contains(key, '.') AND (('0x' || substr(md5(key), 1, 8))::BIGINT % 4 = 0 OR (len(string_split(key, '.')) = 2 AND NOT contains(key, '/')))),
e AS (SELECT key, (['allow', 'malware', 'spam'])[('0x' || substr(md5('list:' || key), 1, 8))::BIGINT % 3 + 1] AS list_name,
             CASE WHEN i % 2 = 0 THEN 'add' ELSE 'remove' END AS action, DATE '2024-01-01' + (('0x' || substr(md5(key || ':' || i::VARCHAR), 1, 8))::BIGINT % 366)::INT AS on_day
      FROM ks, range(4) t(i)),
v AS (SELECT * FROM (SELECT list_name, key, on_day AS valid_from, action, lead(on_day) OVER (PARTITION BY list_name, key ORDER BY on_day) AS valid_to
      FROM (SELECT list_name, key, on_day, max(action) AS action FROM e GROUP BY ALL)) WHERE action = 'add'),
m AS (SELECT k.page_id, k.url, k.fetched_at, v.list_name, v.key, v.valid_from, row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_at
        ORDER BY length(v.key) DESC, (v.list_name = 'allow') DESC, v.list_name DESC, v.key DESC) AS rn
      FROM k JOIN v ON k.key = v.key AND k.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)),
g AS (SELECT page_id, url, fetched_at, count(*) AS n_active, array_to_string(list_sort(list(DISTINCT list_name)), ',') AS lists,
             max(CASE WHEN rn = 1 THEN key END) AS matched_key, max(CASE WHEN rn = 1 THEN list_name END) AS matched_list, max(CASE WHEN rn = 1 THEN valid_from END) AS listed_since FROM m GROUP BY 1, 2, 3)
SELECT o.page_id, o.url, o.host, o.fetched_at::VARCHAR AS fetched_at, o.n_rows, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, matched_key, matched_list, listed_since::VARCHAR AS listed_since,
       coalesce(matched_list <> 'allow', false) AS blocked
FROM once o LEFT JOIN g ON o.page_id IS NOT DISTINCT FROM g.page_id AND o.url IS NOT DISTINCT FROM g.url AND o.fetched_at = g.fetched_at
"""
