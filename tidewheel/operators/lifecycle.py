"""Session lifecycles from their events: phase spans, one record a session, and timelines of what a session did when.

Events are ``session_id, ts, seq, event, status, reason``: ``submit``, ``finalized``, and ``PHASE_start`` and
``PHASE_end`` of each phase; ``seq`` orders events of one time. ``tidewheel.streaming.lifecycle`` follows the same
rules event by event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The phases in their order, and the statuses that end a session.
PHASES = ("generate", "reward", "toolcall")
TERMINAL = ("accepted", "rejected", "failed", "dropped")
#: Idle stretches of no more seconds than this aren't shown.
LEAST_GAP = 1e-6


def lived(events: DataFrame) -> DataFrame:
    """Events from a session's first submit up to the first that ends it: what comes before or after belongs to no session."""
    order = Window.partitionBy("session_id").orderBy("ts", "seq")
    ends = F.coalesce((F.col("event") == "finalized") & F.col("status").isin(*TERMINAL), F.lit(False))
    begun = F.max((F.col("event") == "submit").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = F.max(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumns({"_begun": begun, "_over": F.coalesce(over, F.lit(0))})
    return marked.where("_begun = 1 AND _over = 0").drop("_begun", "_over")


def spans(alive: DataFrame, *, several: bool = True) -> DataFrame:
    """``session_id, phase, seq, start_ts, end_ts`` of each span of ``lived`` events; ``end_ts`` is null while it is open.

    An end closes the start just before it; an end without one is a span of no length. A second start leaves the first
    open for good, or closes it where a phase can't run several times (``several`` false).
    """
    role = F.regexp_extract("event", "^(.+)_(start|end)$", 2)
    steps = alive.select("session_id", "ts", "seq", F.regexp_extract("event", "^(.+)_(start|end)$", 1).alias("phase"), role.alias("role")).where("phase <> ''")
    order = Window.partitionBy("session_id", "phase").orderBy("ts", "seq")
    near = steps.withColumns({"_next": F.lead("role").over(order), "_next_ts": F.lead("ts").over(order), "_before": F.lag("role").over(order)})
    closed = (F.col("_next") == "end") if several else F.col("_next").isNotNull()
    end = F.when(F.col("role") == "end", F.col("ts")).when(closed, F.col("_next_ts"))
    own = near.where((F.col("role") == "start") | F.col("_before").isNull() | (F.col("_before") == "end"))
    return own.select("session_id", "phase", "seq", F.col("ts").alias("start_ts"), end.alias("end_ts"))


def heads(alive: DataFrame) -> DataFrame:
    """A row a session: its status (``pending`` until told), reason and times. ``last_ts`` is the time of the last event."""
    final = F.col("event") == "finalized"
    at = F.struct("ts", "seq")
    return alive.groupBy("session_id").agg(
        F.coalesce(F.max_by("status", F.when(final & F.col("status").isNotNull(), at)), F.lit("pending")).alias("status"),
        F.max_by("reason", F.when(final & F.col("reason").isNotNull(), at)).alias("reason"),
        F.min(F.when(F.col("event") == "submit", F.col("ts"))).alias("submit_ts"),
        F.max(F.when(final, F.col("ts"))).alias("finalized_ts"),
        F.max("ts").alias("last_ts"),
    )


def records(alive: DataFrame, found: DataFrame) -> DataFrame:
    """``heads`` with seconds in each phase and the spans by phase.

    Seconds of a phase are null where none of its spans has ended; ``phases`` maps a phase to its spans in order of
    their start.
    """
    of_phase = found.groupBy("session_id", "phase").agg(F.sort_array(F.collect_list(F.struct("start_ts", "end_ts"))).alias("spans"))
    phases = of_phase.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "spans"))).alias("phases"))
    joined = heads(alive).join(phases, "session_id", "left").withColumn("phases", F.coalesce("phases", F.create_map().cast("map<string, array<struct<start_ts: double, end_ts: double>>>")))
    seconds = {f"{p}_s": seconds_in(F.col("phases"), p) for p in PHASES}
    return joined.withColumns({"total_s": F.col("finalized_ts") - F.col("submit_ts"), **seconds})


def seconds_in(phases: Column, phase: str) -> Column:
    """Sum of a phase's ended spans; null where none has ended."""
    ended = F.filter(F.coalesce(F.try_element_at(phases, F.lit(phase)), F.array()), lambda s: s["end_ts"].isNotNull())
    return F.when(F.size(ended) > 0, F.aggregate(ended, F.lit(0.0), lambda a, s: a + (s["end_ts"] - s["start_ts"])))


def expire(rows: DataFrame, now: Column, idle: float) -> DataFrame:
    """``records`` with sessions that nothing has happened to for ``idle`` seconds dropped, as a timer would do."""
    over = ~F.col("status").isin(*TERMINAL) & (F.col("last_ts") + idle <= now)
    return rows.withColumns({"status": F.when(over, "dropped").otherwise(F.col("status")), "reason": F.when(over, "idle").otherwise(F.col("reason"))})


def _rank(phase: str) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col(phase)).cast("int"), F.lit(0))


def timeline(rows: DataFrame, found: DataFrame, *, least: float = LEAST_GAP) -> DataFrame:
    """``session_id, place, segment, start_ts, end_ts``: ended spans in order of their start, with idle stretches between and behind them.

    Before a span is idle what lies behind the span started before it, or behind the submit; behind the last one what
    is left until the session is finalised. Overlapping spans stay as they are (``sweep`` cuts them).
    """
    done = found.where("end_ts IS NOT NULL").join(rows.select("session_id", "submit_ts", "finalized_ts"), "session_id")
    order = Window.partitionBy("session_id").orderBy("start_ts", _rank("phase"), "phase", "seq")
    placed = done.withColumns({"_since": F.coalesce(F.lag("end_ts").over(order), "submit_ts"), "_last": F.lead("start_ts").over(order).isNull()})
    piece = lambda segment, start, end: F.struct(segment.alias("segment"), start.alias("start_ts"), end.alias("end_ts"))
    idle = F.lit("idle")
    before = F.when(F.col("start_ts") - F.col("_since") > least, piece(idle, F.col("_since"), F.col("start_ts")))
    own = F.when(F.col("end_ts") > F.col("start_ts"), piece(F.col("phase"), F.col("start_ts"), F.col("end_ts")))
    behind = F.when(F.col("_last") & (F.col("finalized_ts") - F.col("end_ts") > least), piece(idle, F.col("end_ts"), F.col("finalized_ts")))
    number = F.row_number().over(order) * 3
    cut = placed.select("session_id", number.alias("_n"), F.posexplode(F.array(before, own, behind)).alias("_k", "p")).where("p IS NOT NULL")
    empty = rows.join(done.select("session_id").distinct(), "session_id", "left_anti").where(F.col("finalized_ts") - F.col("submit_ts") > least)
    empty = empty.select("session_id", F.lit(0).alias("_n"), F.lit(0).alias("_k"), piece(idle, F.col("submit_ts"), F.col("finalized_ts")).alias("p"))
    every = cut.unionByName(empty)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("_n") + F.col("_k"))) - 1
    return every.select("session_id", place.alias("place"), "p.*")


def sweep(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``session_id, place, segment, start_ts, end_ts``: from submit to the end without a gap or an overlap.

    Of spans that overlap the one started last is shown, of those the one that ends first; open ones go on to the end,
    which is the finalised time or, without one, the last event. All else is idle. Each session's times cut it into
    stretches, each stretch takes the innermost span over it, and neighbours of one span are put together again.
    """
    bounds = rows.select("session_id", F.col("submit_ts").alias("_from"), F.coalesce("finalized_ts", "last_ts").alias("_to"))
    clipped = found.join(bounds, "session_id").select("session_id", "phase", "seq", F.greatest("start_ts", "_from").alias("s"), F.least(F.coalesce("end_ts", "_to"), "_to").alias("e")).where("e > s")
    points = bounds.select("session_id", F.explode(F.array("_from", "_to")).alias("t")).unionByName(clipped.select("session_id", F.explode(F.array("s", "e")).alias("t"))).distinct()
    order = Window.partitionBy("session_id").orderBy("t")
    stretches = points.withColumn("u", F.lead("t").over(order)).where("u IS NOT NULL").withColumnRenamed("session_id", "_session")
    inside = (F.col("_session") == F.col("session_id")) & (F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))
    inner = F.max(F.when(F.col("phase").isNotNull(), F.struct("s", -F.col("e"), "phase", "seq"))).alias("_of")
    shown = stretches.join(clipped, inside, "left").groupBy(F.col("_session").alias("session_id"), "t", "u").agg(inner)
    fresh = shown.withColumn("_new", (~F.lag("_of").over(order).eqNullSafe(F.col("_of")) | (F.row_number().over(order) == 1)).cast("int"))
    numbered = fresh.withColumn("place", (F.sum("_new").over(order) - 1).cast("int"))
    return numbered.groupBy("session_id", "place").agg(F.coalesce(F.first("_of.phase"), F.lit("idle")).alias("segment"), F.min("t").alias("start_ts"), F.max("u").alias("end_ts"))
