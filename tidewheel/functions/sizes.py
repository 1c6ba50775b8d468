"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, BYTES = 200_000, 64 << 20


def broadcast_if_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``rows`` rows of at most ``size`` bytes as JSON in all; else as it is, for a shuffled join."""
    length = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= size else df


#: Rows of a task where few bytes hold many rows.
SPREAD_ROWS = 16_384


def spread(df: DataFrame, *keys: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` to a task for every ``rows`` rows: a well compressed file is read by one task, however many rows it has."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def shared(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint when it is small, as ``broadcast_if_small`` finds it; else with one against, as a file's bytes understate its rows."""
    small = broadcast_if_small(df)
    return small if small is not df else df.hint("merge")
