"""Retrieval, trace, catalogue and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions.hashing import hash_uniform_sql
from tidewheel.functions.sizes import spread
from tidewheel.operators import catalogue, graph, retrieval, traces
from tidewheel.sources.adapters import links, sessions, table, triples, with_views

STOP = ["of", "the"]
S, K, L = with_views("sessions"), with_views("triples"), with_views("links")


def bm25_search(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(table(spark, d, "documents"), q, 5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.dense_topk(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


def page_access(spark, d):
    """Every page under another form of its address, and every link: the page found, or null."""
    asked = _requests(spark, d)
    return retrieval.access(asked, table(spark, d, "pages")).select("request", "page_id")


def _requests(spark, d):
    """Addresses to look up: each page's with another scheme and fragment, and the targets of links, of which no page is known."""
    other = F.concat(F.lit("HTTPS://"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#top"))
    return table(spark, d, "pages").select(other.alias("request")).union(links(spark, d).select("target")).distinct()


def page_exists(spark, d):
    pages = table(spark, d, "pages").select(retrieval.page_key(F.col("url")).alias("key")).distinct()
    return _requests(spark, d).withColumn("key", retrieval.page_key(F.col("request"))).join(pages, "key", "left_semi").select("request")


def neighbour_candidates(spark, d):
    visited = table(spark, d, "pages").where("url LIKE 'https%'").select("url").distinct()
    return retrieval.neighbours(links(spark, d), visited).groupBy("url").agg(F.count(F.lit(1)).alias("candidates"))


def link_in_degree(spark, d):
    return links(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("in_links"))


def time_offsets(spark, d):
    return traces.offsets(sessions(spark, d), "submit_ts", "finalized_ts").select("session_id", F.round("submit_ts", 4).alias("submit_ts"), F.round("finalized_ts", 4).alias("finalized_ts"))


def step_boundaries(spark, d):
    return traces.step_boundaries(sessions(spark, d), 50).select("step", F.round("step_end", 4).alias("step_end"))


def step_interval_assign(spark, d):
    s = sessions(spark, d)
    return traces.assign_steps(s, traces.step_boundaries(s, 50)).groupBy(F.coalesce("step", F.lit(-1)).alias("step")).agg(F.count(F.lit(1)).alias("sessions"))


def latency_quantiles(spark, d):
    q = traces.quantiles(sessions(spark, d), ["rank", "status"], "total_s", [0.5, 0.95])
    return q.select("rank", "status", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "least", "most")])


def histogram_bins(spark, d):
    return traces.histogram(sessions(spark, d), "total_s")


def idle_gaps(spark, d):
    g = traces.idle_gaps(sessions(spark, d), ["rank"], "submit_ts", "finalized_ts", 60.0)
    return g.groupBy("rank").agg(F.count(F.lit(1)).alias("gaps"), F.round(F.sum("gap"), 2).alias("idle_s"))


def _parts(spark, d):
    return spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"), catalogue.ngrams(F.concat_ws(" ", F.initcap("p_name"), F.lit("of the"), F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.lit("size"), F.col("p_size").cast("string")), F.lit("100 a 1000")), F.array(*[F.lit(w) for w in STOP])).alias("terms"))


def dedup_products(spark, d):
    p = table(spark, d, "part").select("p_name", "p_brand", "p_partkey", "p_retailprice")
    return catalogue.first_rows(p, ["p_name", "p_brand"], ["p_partkey"])


def tfidf_terms(spark, d):
    return catalogue.tfidf_terms(_parts(spark, d), 2)


def attribute_top_share(spark, d):
    p = _parts(spark, d)
    return catalogue.top_share(catalogue.tfidf_terms(p, 2), p).select("category", "term", F.round("share", 6).alias("share"))


def product_page(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return catalogue.page_of(p, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 2, 10)


def weighted_sample(spark, d):
    p = table(spark, d, "part").select("p_type", "p_partkey", (F.col("p_size") + 1).alias("w"))
    return catalogue.weighted_draws(p, ["p_type"], "p_partkey", "w", 20, 9)


def catalogue_review_join(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("l_quantity"), 6).alias("rating"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(r, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"), F.coalesce("rating", F.lit(0.0)).alias("rating"))


def kg_neighbors(spark, d):
    t = triples(spark, d)
    start = t.where("p = 'status' AND o = 'F'").select("s")
    return graph.reach(graph.reach(start, t, "placed_by"), t, "in_nation")


def kg_relations(spark, d):
    t = triples(spark, d)
    return graph.relations(t.where("s LIKE 'C%'").select("s"), t)


def kg_connected(spark, d):
    t = triples(spark, d).where("p IN ('placed_by', 'in_nation', 'in_region')")
    return graph.connected(t.where("p = 'placed_by'").select("s"), spark.createDataFrame([("N3",), ("N7",)], "s string"), t, 2)


def kg_compare(spark, d):
    return triples(spark, d).where((F.col("p") == "balance") & (F.col("o").try_cast("double") >= 5000)).select("s")


def kg_count(spark, d):
    t = triples(spark, d)
    return t.groupBy("p").agg(F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def kg_argmax(spark, d):
    return graph.extreme(triples(spark, d), "balance")


def kg_intersect(spark, d):
    t = triples(spark, d)
    done, pending = (graph.reach(t.where(f"p = 'status' AND o = '{x}'").select("s"), t, "placed_by") for x in ("F", "P"))
    return graph.one_type(done.intersect(pending), done, pending, kind=lambda s: F.substring(s, 1, 1))


def kg_union(spark, d):
    t = triples(spark, d)
    first, second = (graph.sources_of(spark.createDataFrame([(n,)], "s string"), t, "in_nation") for n in ("N1", "N2"))
    return graph.one_type(first.union(second).distinct(), first, second, kind=lambda s: F.substring(s, 1, 1))


def base_items(spark, d):
    """Parts that recipes use and that have none themselves."""
    r = _recipes(spark, d)
    return r.select(F.col("part").alias("item")).distinct().join(r.select("item"), "item", "left_anti")


def _recipes(spark, d):
    """An item's part is its key's half where the halves share a type: chains of bounded depth."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_type")
    q = p.select(F.col("item").alias("part"), F.col("p_type").alias("part_type"))
    return p.join(q, (F.floor(F.col("item") / 2) == F.col("part")) & (F.col("item") > 0)).where((F.col("item") % 3 != 0)).select("item", "part")


def crafting_depth(spark, d):
    return graph.chain_depth(_recipes(spark, d), 6).select("item", "depth")


def table_md5(spark, d):
    """Fingerprint of all lines, independent of row order."""
    t = table(spark, d, "lineitem")
    text = lambda c, kind: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.2f", c) if kind == "double" else F.date_format(c, "yyyy-MM-dd") if kind.startswith("timestamp") else F.col(c).cast("string"))
    return catalogue.fingerprint(t, [text(c, k) for c, k in t.dtypes])


QUERIES = {f.__name__: f for f in (bm25_search, dense_topk, page_access, page_exists, neighbour_candidates, link_in_degree, time_offsets, step_boundaries, step_interval_assign, latency_quantiles, histogram_bins, idle_gaps, dedup_products, tfidf_terms, attribute_top_share, product_page, weighted_sample, catalogue_review_join, kg_neighbors, kg_relations, kg_connected, kg_compare, kg_count, kg_argmax, kg_intersect, kg_union, base_items, crafting_depth, table_md5)}

_TERMS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9\\x{{80}}-\\x{{ffff}}]+'), lambda w: w <> '')"
_KEY = "regexp_replace(replace(replace(regexp_replace(lower(regexp_replace({x}, '^[a-zA-Z]+://', '')), '[?#].*$', ''), 'index.php/', 'index.php?title='), '_', '%20'), '/+$', '')"
_ASKED = "r AS (SELECT 'HTTPS://' || regexp_replace(url, '^[a-z]+://', '') || '#top' AS request FROM pages UNION SELECT target FROM links)"
_U = hash_uniform_sql("'9'", "p_type", "draw::VARCHAR")
_PARTS = "p AS (SELECT p_partkey AS item, p_type AS category, u || list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) AS terms FROM (SELECT *, list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(replace(p_brand, '#', '')), 'size' || p_size, '1000'], lambda w: len(w) > 1) AS u FROM part))"
_TFIDF = f"""{_PARTS}, tf AS (SELECT item, category, term, count(*) AS tf FROM (SELECT item, category, unnest(terms) AS term FROM p) GROUP BY ALL), n AS (SELECT category, count(*) AS n FROM p GROUP BY 1),
df AS (SELECT * FROM (SELECT category, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY category ORDER BY cf DESC, term) <= 1000),
w AS (SELECT item, category, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (category, term) JOIN n USING (category)),
s AS (SELECT item, category, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY category, item)), 6) AS tfidf FROM w), t AS (SELECT *, (row_number() OVER (PARTITION BY category, item ORDER BY tfidf DESC, term))::INT AS rank FROM s QUALIFY rank <= 2)"""
_STEPS = """e AS (SELECT rank, task_id, max(finalized_ts) AS task_end FROM sessions WHERE status = 'accepted' GROUP BY 1, 2), o AS (SELECT *, (row_number() OVER (PARTITION BY rank ORDER BY task_end, task_id) - 1) // 50 AS step FROM e),
g AS (SELECT rank, step, max(task_end) AS fin FROM o GROUP BY 1, 2 HAVING count(*) = 50), b AS (SELECT step, max(fin) AS step_end FROM g GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT rank) FROM sessions))"""
_MD5 = "WITH d7 AS (SELECT md5(concat_ws(',', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, printf('%.2f', l_quantity), printf('%.2f', l_extendedprice), printf('%.2f', l_discount), printf('%.2f', l_tax), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS m, NULL::VARCHAR AS p FROM lineitem)"
for _level in range(6, -1, -1):
    _MD5 += f", d{_level} AS (SELECT substr({'m' if _level == 6 else 'p'}, 1, {_level}) AS p, md5(string_agg(m, ',' ORDER BY m)) AS m FROM d{_level + 1} GROUP BY 1)"
_MD5 += " SELECT m AS fingerprint, (SELECT count(*) FROM d7) AS rows FROM d0"
ORACLES = {
    "bm25_search": f"WITH w AS (SELECT doc_id, {_TERMS.format(x='text')} AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS ml FROM w), q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format(x='text')}) AS term FROM benchmark), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2 / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * l / ml))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM s) SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 5",
    "dense_topk": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS s FROM v q, v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 4) AS score, rank::INT AS rank FROM r WHERE rank <= 5",
    "page_access": f"{L}, {_ASKED}, k AS (SELECT {_KEY.format(x='url')} AS key, min(page_id) AS page_id FROM pages GROUP BY 1) SELECT request, page_id FROM r LEFT JOIN k ON {_KEY.format(x='request')} = key",
    "page_exists": f"{L}, {_ASKED} SELECT request FROM r WHERE {_KEY.format(x='request')} IN (SELECT {_KEY.format(x='url')} FROM pages)",
    "neighbour_candidates": f"{L}, v AS (SELECT DISTINCT url FROM pages WHERE url LIKE 'https%'), b AS (SELECT url, target AS near FROM links UNION SELECT target, url FROM links) SELECT url, count(*) AS candidates FROM b WHERE url IN (FROM v) AND near NOT IN (FROM v) GROUP BY 1",
    "link_in_degree": f"{L} SELECT target, count(*) AS in_links FROM links GROUP BY 1",
    "time_offsets": f"{S} SELECT session_id, round(submit_ts - (SELECT min(submit_ts) FROM sessions), 4) AS submit_ts, round(finalized_ts - (SELECT min(submit_ts) FROM sessions), 4) AS finalized_ts FROM sessions",
    "step_boundaries": f"{S}, {_STEPS} SELECT step, round(step_end, 4) AS step_end FROM b",
    "step_interval_assign": f"{S}, {_STEPS}, a AS (SELECT session_id, min(step) AS step FROM sessions LEFT JOIN b ON step_end >= finalized_ts GROUP BY 1) SELECT coalesce(step, -1) AS step, count(*) AS sessions FROM a GROUP BY 1",
    "latency_quantiles": f"{S} SELECT rank, status, round(quantile_cont(total_s, 0.5), 6) AS p50, round(quantile_cont(total_s, 0.95), 6) AS p95, round(min(total_s), 6) AS least, round(max(total_s), 6) AS most FROM sessions GROUP BY 1, 2",
    "histogram_bins": f"{S}, f AS (SELECT min(total_s) AS lo, greatest(2 * (quantile_cont(total_s, 0.75) - quantile_cont(total_s, 0.25)) / pow(count(total_s), 1 / 3::DOUBLE), (max(total_s) - min(total_s)) / 120, 1e-3) AS width FROM sessions) SELECT floor((total_s - lo) / width)::BIGINT AS bin, count(*) AS n FROM sessions, f GROUP BY 1",
    "idle_gaps": f"{S}, g AS (SELECT rank, submit_ts - max(finalized_ts) OVER (PARTITION BY rank ORDER BY submit_ts, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM sessions) SELECT rank, count(*) AS gaps, round(sum(gap), 2) AS idle_s FROM g WHERE gap > 60 GROUP BY 1",
    "dedup_products": "SELECT p_name, p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1",
    "tfidf_terms": f"WITH {_TFIDF} SELECT item, category, term, tfidf, rank FROM t",
    "attribute_top_share": f"WITH {_TFIDF} SELECT category, term, round(count(*) / any_value(n), 6) AS share FROM t JOIN n USING (category) GROUP BY 1, 2",
    "product_page": "SELECT p_partkey, p_type, p_retailprice, rank::INT AS rank FROM (SELECT p_partkey, p_type, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank BETWEEN 11 AND 20",
    "weighted_sample": f"WITH w AS (SELECT p_type, p_partkey, sum(p_size + 1) OVER (PARTITION BY p_type ORDER BY p_partkey) AS hi, sum(p_size + 1) OVER (PARTITION BY p_type) AS total, p_size + 1 AS w FROM part), dr AS (SELECT p_type, draw::INT AS draw, {_U} AS u FROM (SELECT DISTINCT p_type FROM part), range(1, 21) t(draw)) SELECT p_type, draw, p_partkey FROM dr JOIN w USING (p_type) WHERE u * total >= hi - w AND u * total < hi",
    "catalogue_review_join": "SELECT p_partkey, p_name, coalesce(reviews, 0) AS reviews, coalesce(rating, 0.0) AS rating FROM part LEFT JOIN (SELECT l_partkey, count(*) AS reviews, round(avg(l_quantity), 6) AS rating FROM lineitem GROUP BY 1) ON p_partkey = l_partkey",
    "kg_neighbors": f"{K} SELECT DISTINCT n.o AS s FROM triples f JOIN triples b ON b.s = f.s AND b.p = 'placed_by' JOIN triples n ON n.s = b.o AND n.p = 'in_nation' WHERE f.p = 'status' AND f.o = 'F'",
    "kg_relations": f"{K} SELECT p, count(*) AS n FROM triples WHERE s LIKE 'C%' GROUP BY 1",
    "kg_connected": f"{K} SELECT DISTINCT b.s FROM triples b JOIN triples n ON n.s = b.o AND n.p = 'in_nation' WHERE b.p = 'placed_by' AND n.o IN ('N3', 'N7')",
    "kg_compare": f"{K} SELECT s FROM triples WHERE p = 'balance' AND o::DOUBLE >= 5000",
    "kg_count": f"{K} SELECT p, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM triples GROUP BY 1",
    "kg_argmax": f"{K}, v AS (SELECT s, o::DOUBLE AS v FROM triples WHERE p = 'balance') SELECT s, v FROM v WHERE v = (SELECT max(v) FROM v)",
    "kg_intersect": f"{K} SELECT b.o AS s FROM triples f JOIN triples b ON b.s = f.s AND b.p = 'placed_by' WHERE f.p = 'status' AND f.o = 'F' INTERSECT SELECT b.o FROM triples f JOIN triples b ON b.s = f.s AND b.p = 'placed_by' WHERE f.p = 'status' AND f.o = 'P'",
    "kg_union": f"{K} SELECT DISTINCT s FROM triples WHERE p = 'in_nation' AND o IN ('N1', 'N2')",
    "base_items": "SELECT DISTINCT p_partkey // 2 AS item FROM part WHERE p_partkey > 0 AND p_partkey % 3 <> 0 AND (p_partkey // 2 = 0 OR (p_partkey // 2) % 3 = 0)",
    "crafting_depth": "WITH RECURSIVE r AS (SELECT p_partkey AS item, p_partkey // 2 AS part FROM part WHERE p_partkey > 0 AND p_partkey % 3 <> 0), c AS (SELECT item, 1 AS depth FROM r UNION SELECT r.item, c.depth + 1 FROM r JOIN c ON r.part = c.item WHERE c.depth < 6) SELECT item, max(depth) AS depth FROM c GROUP BY 1",
    "table_md5": _MD5,
}
