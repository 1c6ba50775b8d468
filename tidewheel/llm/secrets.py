"""Secret scans with DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.tables import aside, whole_text

#: The pattern kinds, in the order that breaks ties between spans that start together.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 24
#: Bits a character that a window must reach, by character class.
BITS = {"hex": 3.25, "alnum": 4.0, "base64": 4.1}
#: Candidates that match one of these are known not to be secrets: placeholders, alphabets, ids and public digests.
ALLOWED = (
    "(?i)example|placeholder|changeme|dummy|sample|x{6,}",
    "(?i)0123456789|abcdefghijkl|qwertyuiop",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^sha(1|256|384|512)-",
)
_ONE = 1 << 20
_CHUNK = 512
#: Windows of a candidate that one pass slides over; a longer candidate takes several, which share its characters at their ends.
PASS = 4096


def _fixed(count: int) -> int:
    """count * log2(count) in units of 2^-20, so that adding and removing counts never drifts."""
    return round(count * math.log2(count) * _ONE) if count > 1 else 0


def _most(bits: float) -> int:
    """A window has at least ``bits`` a character when its sum of count * log2(count) is at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _ONE)


def _running(steps: Column) -> Column:
    """Inclusive running sums of an array, a chunk at a time so that long arrays aren't copied for each element."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int"))), lambda i: F.slice(steps, i * _CHUNK + 1, _CHUNK))

    def sums(values: Column) -> Column:
        empty = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(values, empty, lambda a, x: F.struct((a["upto"] + x).alias("upto"), F.concat(a["all"], F.array(a["upto"] + x)).alias("all")))

    done = F.transform(parts, sums)
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<array<int>>").alias("all"))
    joined = F.aggregate(done, start, lambda a, p: F.struct((a["upto"] + p["upto"]).alias("upto"), F.concat(a["all"], F.array(F.transform(p["all"], lambda x: x + a["upto"]))).alias("all")))
    return F.flatten(joined["all"])


def _matches(df: DataFrame, pattern: str, column: str, text: str) -> DataFrame:
    """Adds ``column``: array of (start, match), leftmost and non-overlapping; null where the text has none.

    The pieces between matches and the matches take turns, so the running sum of their lengths gives each start.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    df = df.withColumn("_secret_m", F.when(F.col(text).rlike(pattern), found)).withColumn("_secret_p", F.when(F.col("_secret_m").isNotNull(), pieces))
    steps = F.transform(F.col("_secret_m"), lambda m, i: F.length(F.element_at("_secret_p", i + 1)) + F.when(i > 0, F.length(F.element_at("_secret_m", F.greatest(i, F.lit(1))))).otherwise(0))
    df = df.withColumn("_secret_s", F.when(F.col("_secret_m").isNotNull(), _running(steps)))
    return df.withColumn(column, F.transform("_secret_m", lambda m, i: F.struct(F.element_at("_secret_s", i + 1).alias("start"), m.alias("match")))).drop("_secret_m", "_secret_p", "_secret_s")


def _spans(column: str, kind: str, keep) -> Column:
    """(start, rank, end, kind) of those matches that ``keep`` holds for."""
    kept = F.filter(F.col(column), lambda x: keep(x["match"]))
    made = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.length(x["match"])).alias("end")))
    return F.coalesce(made, F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def _slide(candidate: str, start: str, rank: str, most: str) -> str:
    """SQL for the spans of windows with high entropy in a candidate; windows that overlap or touch join.

    One pass over the characters. The state is the count of each alphabet letter (a character of ``counts`` each),
    the fixed-point sum of count * log2(count), the last high window's span and the spans before it. A step takes
    one letter out, puts one in and adjusts the sum by the two counts that changed.
    """
    table = f"array({', '.join(f'{_fixed(c)}L' for c in range(WINDOW + 2))})"
    letters = f"transform(split({candidate}, ''), c -> instr('{ALPHABET}', c))"
    came, went = "x.came", "x.went"

    def count(at: str) -> str:
        return f"(ascii(substr(a.counts, {at}, 1)) - 48)"

    def put(counts: str, at: str, by: int) -> str:
        return f"overlay({counts} PLACING chr(ascii(substr({counts}, {at}, 1)) + {by}) FROM {at} FOR 1)"

    added = f"{table}[{count(came)} + 1] - {table}[{count(came)}]"
    removed = f"{table}[{count(went)} - 1] - {table}[{count(went)}]"
    counts = f"CASE WHEN {went} = {came} THEN a.counts WHEN {went} = 0 THEN {put('a.counts', came, 1)} ELSE {put(put('a.counts', went, -1), came, 1)} END"
    total = f"a.total + CASE WHEN {went} = {came} THEN 0L WHEN {went} = 0 THEN {added} ELSE {added} + {removed} END"
    high = f"(x.i >= {WINDOW} AND {total} <= {most})"
    span = "named_struct('start', a.since, 'rank', {r}, 'end', a.upto)".format(r=rank)
    first = f"{start} + x.i - {WINDOW}"
    apart = f"({high} AND a.upto > 0 AND a.upto < {first})"
    steps = f"transform({letters}, (c, i) -> named_struct('i', i + 1, 'came', c, 'went', IF(i >= {WINDOW}, element_at(letters, i - {WINDOW} + 1), 0)))"
    return f"""
    aggregate(flatten(transform(array({letters}), letters -> {steps.replace(letters, 'letters')})),
      named_struct('counts', repeat('0', {len(ALPHABET)}), 'total', 0L, 'since', 0, 'upto', 0, 'spans', cast(array() AS array<struct<start:int,rank:int,end:int>>)),
      (a, x) -> named_struct('counts', {counts}, 'total', {total},
        'since', CASE WHEN {high} AND (a.upto = 0 OR a.upto < {first}) THEN {first} ELSE a.since END,
        'upto', CASE WHEN {high} THEN {start} + x.i ELSE a.upto END,
        'spans', CASE WHEN {apart} THEN concat(a.spans, array({span})) ELSE a.spans END),
      a -> CASE WHEN a.upto > 0 THEN concat(a.spans, array({span})) ELSE a.spans END)"""


def _entropy_spans(column: str) -> Column:
    """Spans of candidates by character class: hexadecimal, letters and digits, or the base64 alphabets."""
    kind = "CASE WHEN k.match RLIKE '^[0-9a-fA-F]+$' THEN 3 WHEN k.match RLIKE '^[A-Za-z0-9]+$' THEN 4 ELSE 5 END"
    most = f"CASE r WHEN 3 THEN {_most(BITS['hex'])}L WHEN 4 THEN {_most(BITS['alnum'])}L ELSE {_most(BITS['base64'])}L END"
    body = _slide("q.match", "q.start", "r", "most")
    parts = f"transform(sequence(0, greatest(0, (length(k.match) - {WINDOW}) div {PASS})), p -> named_struct('match', substr(k.match, p * {PASS} + 1, {PASS + WINDOW - 1}), 'start', CAST(k.start + p * {PASS} AS INT)))"
    spans = f"flatten(transform({parts}, q -> {body}))"
    # spans of neighbouring passes that overlap or touch are one: starts behind a gap and ends before one, in pairs
    first, last = "filter(s, (x, i) -> i = 0 OR element_at(s, i).end < x.start)", "filter(s, (x, i) -> i = size(s) - 1 OR x.end < element_at(s, i + 2).start)"
    whole = f"transform(array({spans}), s -> IF(size(s) < 2, s, zip_with({first}, {last}, (f, l) -> named_struct('start', f.start, 'rank', f.rank, 'end', l.end))))"
    inner = f"flatten(transform(array({kind}), r -> flatten(transform(array({most}), most -> flatten({whole})))))"
    return F.expr(f"coalesce(flatten(transform({column}, k -> {inner})), cast(array() AS array<struct<start:int,rank:int,end:int>>))")


def scan_secrets(docs: DataFrame, *, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``base_spans`` and ``entropy_spans``: arrays of (start, rank, end), rank an index into ``KINDS``.

    Base spans are pattern matches: an assigned value of 12 or more characters, access keys of 18, lower-case
    hexadecimal runs of 16. Entropy spans join the windows of ``WINDOW`` characters that reach their class's bits
    in candidate runs of token characters; a candidate that an allow-list pattern matches is suppressed, base
    spans never are. Offsets are code points, ends exclusive. A candidate of any length is slid over in passes, so that the
    characters of one pass alone are an array. Null and empty texts have no spans, repeated rows are scanned alike.
    Columns named as the two added are replaced, others stay.
    """
    docs, back = aside(docs, {f"_secret_{c}" for c in ("t", "m", "p", "s", "assign", "access", "hex", "run")})
    df = docs.withColumn("_secret_t", whole_text(text))
    df = _matches(df, ASSIGN, "_secret_assign", "_secret_t")
    df = _matches(df, "AKIA[A-Z0-9]{14,}", "_secret_access", "_secret_t")  # a run of fewer fails from any start in it
    df = _matches(df, "[0-9a-f]{16,}", "_secret_hex", "_secret_t")
    df = _matches(df, f"[A-Za-z0-9+/_=-]{{{WINDOW},}}", "_secret_run", "_secret_t")
    base = F.concat(
        _spans("_secret_assign", "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12), _spans("_secret_access", "access", lambda m: F.length(m) >= 18), _spans("_secret_hex", "hex", lambda m: F.length(m) >= 16)
    )
    df = df.withColumn("_secret_run", F.filter("_secret_run", lambda k: ~_any(k["match"], allowed)) if allowed else F.col("_secret_run"))
    df = df.withColumn("base_spans", F.array_sort(base)).withColumn("entropy_spans", F.when(F.size("_secret_run") > 0, _entropy_spans("_secret_run")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return back(df.withColumn("entropy_spans", F.coalesce("entropy_spans", none)).drop("_secret_t", "_secret_assign", "_secret_access", "_secret_hex", "_secret_run"))


def _any(match: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | match.rlike(p)
    return hit


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(rank: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )


def _sql_matches(name: str, pattern: str, keep: str) -> str:
    """SQL for the matches of a pattern: the pieces between them and the matches before give each start."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start, found[i] AS match
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS found, regexp_split_to_array(t, '{p}') AS pieces FROM d)) WHERE {keep})"""


def _oracle() -> str:
    sums = f"[{', '.join(f'{_fixed(c)}::BIGINT' for c in range(WINDOW + 2))}]"
    assign = ASSIGN.replace("'", "''")
    allowed = " OR ".join("regexp_matches(match, '" + p.replace("'", "''") + "')" for p in ALLOWED)
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_matches("a", ASSIGN, f"length(regexp_extract(found[i], '{assign}', 2)) >= 12")},
{_sql_matches("k", ACCESS, "length(found[i]) >= 18")},
{_sql_matches("h", HEX, "length(found[i]) >= 16")},
{_sql_matches("r", f"[A-Za-z0-9+/_=-]{{{WINDOW},}}", "true")},
base AS (SELECT doc_id, start, 0 AS rank, start + length(match) AS fin FROM a UNION ALL SELECT doc_id, start, 1, start + length(match) FROM k UNION ALL SELECT doc_id, start, 2, start + length(match) FROM h),
c AS (SELECT doc_id, start, match, CASE WHEN regexp_full_match(match, '[0-9a-fA-F]+') THEN 3 WHEN regexp_full_match(match, '[A-Za-z0-9]+') THEN 4 ELSE 5 END AS rank FROM r WHERE NOT ({allowed})),
o AS (SELECT doc_id, start, rank, i, substr(match, i, {WINDOW}) AS win FROM (SELECT *, unnest(range(1, length(match) - {WINDOW - 2})) AS i FROM c)),
e AS (SELECT doc_id, start, rank, start + i - 1 AS b, list_sum(list_transform(list_distinct(string_split(win, '')), lambda x: ({sums})[length(win) - length(replace(win, x, '')) + 1])) AS total FROM o),
g AS (SELECT * FROM e WHERE total <= CASE rank WHEN 3 THEN {_most(BITS['hex'])} WHEN 4 THEN {_most(BITS['alnum'])} ELSE {_most(BITS['base64'])} END),
f AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY b) AS island FROM (SELECT *, (coalesce(lag(b) OVER (PARTITION BY doc_id, start ORDER BY b) + {WINDOW} < b, true))::INT AS fresh FROM g)),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, min(b), rank, max(b) + {WINDOW} FROM f GROUP BY doc_id, start, rank, island),
said AS (SELECT doc_id, start, rank, ([{names}])[rank + 1] || ':' || start::BIGINT || ':' || fin::BIGINT AS line FROM every),
s AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, coalesce(string_agg(line, ',' ORDER BY start, rank) FILTER (rank <= 2), '') AS base_line, string_agg(line, ',' ORDER BY start, rank) AS all_line FROM said GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base_line, '')) AS base_sha256, coalesce(all_line, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""


ORACLE = _oracle()
