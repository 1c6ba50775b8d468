"""Products with their options, prices and search documents; attributes with the items that have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.jobs.corpora import _PARTS, _parts
from tidewheel.operators import catalogue, traces
from tidewheel.sources.adapters import sessions, table, with_views

S = with_views("sessions")
#: Items of a posting: a range of so many keys.
POSTING = 4096


def _products(spark, d):
    """Parts as products: some keys unusable, options with contents or without, in several ways of writing, and price texts."""
    k = F.col("p_partkey")
    content = lambda value, image: F.struct(value.alias("value"), image.alias("image"))
    none = F.lit(None).cast("string")
    colours = F.transform(F.split("p_name", " "), lambda w: content(F.concat(F.lit(" "), F.initcap(w), F.lit("/X")), F.when(k % 2 == 0, F.concat(w, F.lit(".png")))))
    sizes = F.array(content(F.col("p_size").cast("string"), none))
    empty = F.lit(None).cast("array<struct<value: string, image: string>>")
    options = F.when(k % 6 > 0, F.create_map(F.lit("Color"), colours, F.lit("SIZE"), F.when(k % 4 > 0, sizes).otherwise(empty), F.lit("Fit"), empty)).otherwise(F.create_map().cast("map<string, array<struct<value: string, image: string>>>"))
    price = F.format_string("%.2f", "p_retailprice")
    pricing = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("$"), price)).when(k % 5 == 2, F.concat(F.lit("$"), price, F.lit(" - $1,000.50"))).when(k % 5 == 3, F.concat(F.lit("was 7 now $"), price, F.lit(" $2 $3")))
    asin = F.when(k % 50 == 7, "nan").when(k % 50 == 9, F.concat(F.lit("TOOLONG"), k.cast("string"), F.lit("00000"))).otherwise(k.cast("string"))
    return table(spark, d, "part").select("p_partkey", asin.alias("asin"), F.initcap("p_name").alias("name"), F.col("p_type").alias("full_description"), F.array(F.col("p_brand"), F.lit("second")).alias("small_description"), options.alias("customization_options"), pricing.alias("pricing_text"), F.concat(F.lit("  "), F.upper("p_name")).alias("query"), F.col("p_size").alias("brand_url"))


def product_clean(spark, d):
    """Usable products with their options by name, the images of values, and what is asked for."""
    p = catalogue.known_products(_products(spark, d), "asin", ["brand_url"])
    options = catalogue.clean_options(F.col("customization_options"))
    images = F.map_filter(catalogue.option_images(F.col("customization_options")), lambda _, v: v.isNotNull())
    return p.select("p_partkey", F.trim(F.lower("query")).alias("query"), catalogue.option_text(options).alias("options"), F.size(options).alias("n_options"), F.array_join(F.array_sort(F.map_values(images)), ",").alias("images"))


def build_search_documents(spark, d):
    p = catalogue.known_products(_products(spark, d), "asin", ["brand_url"])
    contents = catalogue.search_contents(F.col("name"), F.col("full_description"), F.col("small_description"), catalogue.clean_options(F.col("customization_options")))
    return p.select(F.col("asin").alias("id"), contents.alias("contents"))


def parse_price(spark, d):
    prices, tag = catalogue.parse_price(F.col("pricing_text"))
    p = _products(spark, d).select("p_partkey", prices, tag)
    return p.select("p_partkey", F.round(F.col("pricing")[0], 2).alias("low"), F.round(F.try_element_at("pricing", F.lit(-1)), 2).alias("high"), "price_tag")


def attribute_inverted_index(spark, d):
    """The items of each attribute, in postings of a range of keys each, so that none grows with the table."""
    t = _parts(spark, d).select("item", F.explode("terms").alias("term")).distinct()
    return catalogue.postings(t, "term", "item", POSTING).select("term", "block", F.size("items").alias("n"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


def latency_anomalies(spark, d):
    """Sessions over their group's 95th percentile, by day."""
    found = traces.anomalies(sessions(spark, d), ["rank", "status"], "total_s")
    return found.groupBy("rank", "status", F.floor(F.col("submit_ts") / 86400).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("anomaly").alias("anomalies"))


QUERIES = {f.__name__: f for f in (product_clean, build_search_documents, parse_price, attribute_inverted_index, latency_anomalies)}

_PRODUCTS = """c AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 6 > 0 THEN list_transform(string_split(p_name, ' '), lambda w: lower(w) || ' | x') END AS colours, CASE WHEN p_partkey % 6 > 0 AND p_partkey % 4 > 0 THEN p_size::VARCHAR END AS size, lower(p_name) AS title, lower(p_type) AS type, lower(p_brand) AS brand
FROM part WHERE p_partkey % 50 NOT IN (7, 9) AND length(p_partkey::VARCHAR) <= 10), o AS (SELECT *, coalesce('color: ' || array_to_string(colours, ', ') || coalesce(', and size: ' || size, ''), '') AS options FROM c)"""
_PRICE = "printf('%.2f', p_retailprice)"
ORACLES = {
    "product_clean": f"""WITH {_PRODUCTS} SELECT p_partkey, trim(lower(p_name)) AS query, options, ((colours IS NOT NULL)::INT + (size IS NOT NULL)::INT)::INT AS n_options, CASE WHEN p_partkey % 2 = 0 AND colours IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda w: w || '.png'))), ',') ELSE '' END AS images FROM o""",
    "build_search_documents": f"WITH {_PRODUCTS} SELECT p_partkey::VARCHAR AS id, title || ' ' || type || ' ' || brand || ' ' || options AS contents FROM o",
    "parse_price": f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, {_PRICE}::DOUBLE AS x FROM part) SELECT p_partkey, CASE WHEN k IN (0, 4) THEN 100.0::DOUBLE ELSE x END AS low, CASE k WHEN 1 THEN x WHEN 2 THEN 1000.5::DOUBLE WHEN 3 THEN 2.0::DOUBLE ELSE 100.0::DOUBLE END AS high,
CASE k WHEN 1 THEN '$' || x WHEN 2 THEN '$' || x || ' to $1000.5' WHEN 3 THEN '$' || x || ' to $2.0' ELSE '$100.0' END AS price_tag FROM p""",
    "attribute_inverted_index": f"WITH {_PARTS}, t AS (SELECT DISTINCT item, unnest(terms) AS term FROM p) SELECT term, item // {POSTING} AS block, count(*)::INT AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM t GROUP BY 1, 2",
    "latency_anomalies": f"{S}, q AS (SELECT *, total_s > quantile_cont(total_s, 0.95) OVER (PARTITION BY rank, status) AS a FROM sessions) SELECT rank, status, floor(submit_ts / 86400)::BIGINT AS day, count(*) AS sessions, count(*) FILTER (a) AS anomalies FROM q GROUP BY 1, 2, 3",
}
