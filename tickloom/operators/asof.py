"""As-of joins: for each left row, the nearest right row in time.

Both sides go through one union and one window over ``(key, chunk)``, so the join
is a single shuffle of each side and never compares pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.chunks import CHUNK, chunk_start


def asof_join(left: DataFrame, right: DataFrame, *, take: dict[str, str], chunk: int,
              by: Sequence[str] = (), ts: str = "ts", right_ts: str | None = None,
              at: Column | None = None, tol: int | None = None,
              direction: str = "backward", strict: bool = False, offset: int = 0,
              tie: str | None = None, match_ts: str | None = None) -> DataFrame:
    """Left rows with columns of the matching right row (null where none).

    ``direction='backward'`` matches the latest right row at or before the look-up
    time, ``'forward'`` the earliest at or after it; ``strict`` excludes equality.
    The look-up time is ``at`` (default the left ``ts``); ``tol`` bounds the distance
    from it, so a lagged look-up measures the tolerance from the lag target.
    ``offset`` is added to right times first (feed latency). Right rows that share
    a time are ordered by ``tie``: the last wins backward, the first wins forward.
    ``take`` maps right columns to output names, ``match_ts`` names the matched time.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction}")
    sign = 1 if direction == "backward" else -1
    right_ts = right_ts or ts
    look = (at if at is not None else F.col(ts)) * F.lit(sign)
    when = (F.col(right_ts) + F.lit(offset)) * F.lit(sign)
    left_side, right_side = (0, 1) if strict else (1, 0)

    keys = list(by)
    fields = [F.col(c).alias(f"v{i}") for i, c in enumerate(take)]
    rows = left.select(
        *keys, look.alias("_t"), F.lit(left_side).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    rows = rows.withColumn(CHUNK, chunk_start(F.col("_t"), chunk))
    quotes = right.select(
        *keys, when.alias("_t"), F.lit(right_side).alias("_side"),
        (F.col(tie) if tie else F.lit(0)).alias("_tie"),
        F.struct(when.alias("t"), *fields).alias("_right"))

    if tol is None:
        quotes = quotes.withColumn(CHUNK, chunk_start(F.col("_t"), chunk))
        quotes = quotes.unionByName(_opening_quotes(rows, quotes, keys, sign))
    else:
        last = chunk_start(F.col("_t") + F.lit(tol), chunk)
        quotes = quotes.withColumn(CHUNK, F.explode(F.sequence(
            chunk_start(F.col("_t"), chunk), last, F.lit(chunk))))

    both = rows.unionByName(quotes, allowMissingColumns=True)
    tie_order = F.col("_tie").asc() if sign > 0 else F.col("_tie").desc()
    frame = (Window.partitionBy(*keys, CHUNK).orderBy("_t", "_side", tie_order)
             .rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(frame))
    found = found.filter(F.col("_side") == left_side)
    near = F.col("_hit").isNotNull()
    if tol is not None:
        near = near & (F.col("_t") - F.col("_hit.t") <= F.lit(tol))
    outs = [F.when(near, F.col(f"_hit.v{i}")).alias(o) for i, o in enumerate(take.values())]
    if match_ts:
        outs.append(F.when(near, F.col("_hit.t") * F.lit(sign)).alias(match_ts))
    return found.select("_left.*", *outs)


def _opening_quotes(rows: DataFrame, quotes: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """The quote in force when each left chunk opens, one row per key and chunk."""
    # in mirrored time the latest instant wins, and within it the smallest tie
    rank = F.struct("_t", F.col("_tie") * F.lit(sign))
    entries = quotes.select(
        *keys, CHUNK, rank.alias("_rank"), F.struct("_t", "_side", "_tie", "_right").alias("_q"),
        F.lit(False).alias("_wanted"))
    entries = entries.unionByName(
        rows.select(*keys, CHUNK, F.lit(True).alias("_wanted")), allowMissingColumns=True)
    table = entries.groupBy(*keys, CHUNK).agg(
        F.max_by("_q", "_rank").alias("_tail"), F.max("_wanted").alias("_wanted"))
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    table = table.withColumn("_open", F.last("_tail", ignorenulls=True).over(earlier))
    table = table.filter(F.col("_wanted") & F.col("_open").isNotNull())
    return table.select(*keys, "_open._t", "_open._side", "_open._tie", "_open._right", CHUNK)
