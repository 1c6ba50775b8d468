"""The library's inputs as views of the driver tables; every expression has a twin in ``SQL`` for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of rollouts: one row of ``lineitem`` each; ``seq_no`` is their order of arrival."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("traj_idx"), (F.col("l_suppkey") % 2).cast("int").alias("model_key"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
        ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("int").alias("min_version"), F.col("l_quantity").cast("int").alias("seq_len"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("seq_no"), (F.col("l_discount") * 10).alias("logprob_gap"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout outcomes by prompt: one event each, versions are days."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("prompt_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("int").alias("version"), F.col("event_type").isin("purchase", "click").cast("double").alias("reward"), F.col("event_id").alias("seq_no"), "event_type"
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation attempts: dataset, sample and whether the attempt is right."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("dataset"))
    return table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "dataset", F.col("l_partkey").alias("sample"), (F.col("l_returnflag") == "R").alias("correct"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), F.col("l_discount").alias("reward"), F.col("l_linenumber").alias("run_idx")
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced sessions: one event each, with submit and finalise times in seconds."""
    start = epoch_micros("ts") / 1e6
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("session_id"), (F.col("event_id") / 4).cast("long").alias("task_id"), (F.col("user_id") % 4).cast("int").alias("rank"), start.alias("submit_ts"), F.col("value").alias("total_s"), (start + F.col("value")).alias("finalized_ts"),
        F.when(F.col("event_type") == "error", "rejected").otherwise("accepted").alias("status"), F.col("event_type"),
    )


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences, a conversation each: aligned arrays in turn order."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.filter(F.split("text", "\\s+"), lambda w: w != "").alias("ws"))
    turns = words.select(
        "conv_id", "turn", F.transform("ws", lambda w: (F.length(w) % 97).cast("int")).alias("input_ids"), F.transform("ws", lambda w: (F.col("role") == "assistant").cast("int")).alias("loss_mask"),
        F.transform("ws", lambda w: -(1.0 + F.length(w) % 7) / 10).alias("logprobs"), F.transform("ws", lambda w: F.when(F.col("role") == "assistant", F.col("turn")).otherwise(F.lit(-1)).cast("int")).alias("versions"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "input_ids", "loss_mask", "logprobs", "versions")))
    own = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return own.select("conv_id", *[F.flatten(F.col(f"t.{c}")).alias(c) for c in ("input_ids", "loss_mask", "logprobs", "versions")])


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (s, p, o) about customers, nations, regions and orders."""
    t = lambda df, s, p, o: df.select(F.concat(F.lit(s[0]), F.col(s[1:]).cast("string")).alias("s"), F.lit(p).alias("p"), (F.concat(F.lit(o[0]), F.col(o[1:]).cast("string")) if o[0] != "=" else F.col(o[1:]).cast("string")).alias("o"))
    n, c, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return t(n, "Nn_nationkey", "in_region", "Rn_regionkey").union(t(c, "Cc_custkey", "in_nation", "Nc_nationkey")).union(t(c, "Cc_custkey", "balance", "=c_acctbal")).union(t(o, "Oo_orderkey", "placed_by", "Co_custkey")).union(t(o, "Oo_orderkey", "status", "=o_orderstatus"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-links of pages, resolved against the page's host; distinct."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("site"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return pages.select("url", F.when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.col("href")).alias("target")).distinct()


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of traced sessions: an order is a session, its lines are phase spans.

    Some spans never start or never end, some orders are never finalised, or twice, or without a status before.
    """
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    orders = o.select(F.col("o_orderkey").alias("session_id"), (epoch_micros("o_orderdate") / 1e6).alias("t0"), "o_orderstatus", "o_orderpriority")
    none = F.lit(None).cast("string")
    event = lambda df, ts, seq, name, status=none, reason=none: df.select("session_id", ts.alias("ts"), F.lit(seq).cast("int").alias("seq") if isinstance(seq, int) else seq.cast("int").alias("seq"), name.alias("event"), status.alias("status"), reason.alias("reason"))
    key, t0 = F.col("session_id"), F.col("t0")
    ended = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected")
    final = F.lit("finalized")
    of_orders = event(orders, t0, -1, F.lit("submit"))
    of_orders = of_orders.union(event(orders.where(key % 17 == 0), t0 + 100, 900, final))
    of_orders = of_orders.union(event(orders.where((F.col("o_orderstatus") != "P")), t0 + F.when(key % 13 == 0, 120).otherwise(300), 901, final, ended, F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))))
    of_orders = of_orders.union(event(orders.where(key % 19 == 0), t0 + 350, 902, final, F.lit("failed"), F.lit("late")))
    phase = F.when(F.col("l_returnflag") == "R", "generate").when(F.col("l_returnflag") == "A", "reward").otherwise("toolcall")
    lines = l.join(orders, F.col("l_orderkey") == key).select("session_id", "t0", phase.alias("phase"), ((F.col("l_partkey") % 97) * 2.5).alias("off"), "l_quantity", "l_suppkey", ((F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000) * 2).alias("n"))
    begun = event(lines.where("l_suppkey % 11 > 0"), t0 + F.col("off"), F.col("n"), F.concat("phase", F.lit("_start")))
    done = event(lines.where("l_suppkey % 7 > 0"), t0 + F.col("off") + F.col("l_quantity"), F.col("n") + 1, F.concat("phase", F.lit("_end")))
    return of_orders.union(begun).union(done)


SQL = {
    "trace_events": """SELECT session_id, ts, seq::INT AS seq, event, status, reason FROM (
        WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) / 1e6 AS t0, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
        l AS (SELECT k, t0, CASE l_returnflag WHEN 'R' THEN 'generate' WHEN 'A' THEN 'reward' ELSE 'toolcall' END AS phase, t0 + (l_partkey % 97) * 2.5::DOUBLE AS s, l_quantity AS q, l_suppkey AS p, (l_linenumber * 1000 + l_partkey % 1000) * 2 AS n FROM lineitem JOIN o ON k = l_orderkey)
        SELECT k AS session_id, t0 AS ts, -1 AS seq, 'submit' AS event, NULL::VARCHAR AS status, NULL::VARCHAR AS reason FROM o
        UNION ALL SELECT k, t0 + 100, 900, 'finalized', NULL, NULL FROM o WHERE k % 17 = 0
        UNION ALL SELECT k, t0 + CASE WHEN k % 13 = 0 THEN 120 ELSE 300 END, 901, 'finalized', CASE WHEN st = 'F' THEN 'accepted' ELSE 'rejected' END, CASE WHEN st = 'O' THEN pr END FROM o WHERE st <> 'P'
        UNION ALL SELECT k, t0 + 350, 902, 'finalized', 'failed', 'late' FROM o WHERE k % 19 = 0
        UNION ALL SELECT k, s, n, phase || '_start', NULL, NULL FROM l WHERE p % 11 > 0
        UNION ALL SELECT k, s + q, n + 1, phase || '_end', NULL, NULL FROM l WHERE p % 7 > 0)""",
    "rollouts": """SELECT l_orderkey AS group_id, l_linenumber AS traj_idx, (l_suppkey % 2)::INT AS model_key, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
        ((year(l_shipdate) - 1992) * 12 + month(l_shipdate))::INT AS min_version, l_quantity::INT AS seq_len,
        ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS seq_no, l_discount * 10 AS logprob_gap FROM lineitem""",
    "outcomes": """SELECT user_id AS prompt_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS version, (event_type IN ('purchase', 'click'))::INT::DOUBLE AS reward, event_id AS seq_no, event_type FROM events""",
    "eval_results": """SELECT r_name AS dataset, l_partkey AS sample, l_returnflag = 'R' AS correct, l_orderkey * 10 + l_linenumber AS attempt, l_discount AS reward, l_linenumber AS run_idx
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sessions": """SELECT event_id AS session_id, event_id // 4 AS task_id, (user_id % 4)::INT AS rank, epoch_us(ts) / 1e6 AS submit_ts, value AS total_s, epoch_us(ts) / 1e6 + value AS finalized_ts,
        CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'accepted' END AS status, event_type FROM events""",
    "token_rows": """SELECT conv_id, flatten(list(list_transform(ws, lambda w: (length(w) % 97)::INT) ORDER BY turn)) AS input_ids, flatten(list(list_transform(ws, lambda w: (role = 'assistant')::INT) ORDER BY turn)) AS loss_mask,
        flatten(list(list_transform(ws, lambda w: -(1.0::DOUBLE + length(w) % 7) / 10) ORDER BY turn)) AS logprobs, flatten(list(list_transform(ws, lambda w: (CASE WHEN role = 'assistant' THEN turn ELSE -1 END)::INT) ORDER BY turn)) AS versions
        FROM (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM conversations) GROUP BY conv_id""",
    "triples": """SELECT 'N' || n_nationkey AS s, 'in_region' AS p, 'R' || n_regionkey AS o FROM nation UNION ALL SELECT 'C' || c_custkey, 'in_nation', 'N' || c_nationkey FROM customer
        UNION ALL SELECT 'C' || c_custkey, 'balance', c_acctbal::VARCHAR FROM customer UNION ALL SELECT 'O' || o_orderkey, 'placed_by', 'C' || o_custkey FROM orders UNION ALL SELECT 'O' || o_orderkey, 'status', o_orderstatus FROM orders""",
    "links": """SELECT DISTINCT url, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS target FROM
        (SELECT url, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""",
}


def with_views(*names: str) -> str:
    """The WITH clause that gives DuckDB the adapters' rows."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
