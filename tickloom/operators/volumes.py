"""Cumulative taker volume: one counter per instrument that never falls.

A window's volume is the counter now less the counter then, whatever was left out between.
Receivers reconnect, so a trade may be recorded twice, and counters start again at zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import chunks as C
from tickloom.operators.folds import refractory


def distinct_trades(trades: DataFrame, *, by: Sequence[str], ts: str, order: Sequence[str],
                    trade_id: str = "trade_id") -> DataFrame:
    """Every trade once, as first received. Trades without an id are all kept.

    Grouped by the id, so one busy instrument spreads over all tasks.
    """
    rest = [c for c in trades.columns if c not in (*by, trade_id, ts, *order)]
    own = F.when(F.col(trade_id).isNull(), F.struct(ts, *order))
    first = F.min_by(F.struct(ts, *order, *rest), F.struct(ts, *order))
    once = trades.groupBy(*by, trade_id, own.alias("_own")).agg(first.alias("_first"))
    return once.select(*by, trade_id, "_first.*")


def taker_volume(trades: DataFrame, *, by: Sequence[str], ts: str, order: Sequence[str] = (),
                 gap: int, chunk: int, qty: str = "qty", trade_id: str = "trade_id",
                 session: Sequence[str] = ()) -> DataFrame:
    """Counter ``cum`` of traded quantity, shown at most once per ``gap``.

    Trades between two shown rows are in the next one. With ``session`` columns the first
    trade of every connection is shown, too. A quantity that is null counts nothing.
    """
    once = distinct_trades(trades, by=by, ts=ts, order=order, trade_id=trade_id)
    at = [*order, trade_id]
    rows = C.running_sum(once, F.coalesce(F.col(qty), F.lit(0.0)), "cum", by=by, ts=ts, order=at,
                         chunk=chunk)
    return refractory(rows, by=[*by, *session], ts=ts, gap=gap, order=at, chunk=chunk)


def rejoined_counter(points: DataFrame, *, by: Sequence[str], ts: str, order: Sequence[str] = (),
                     chunk: int, value: str = "cum", out: str = "total",
                     session: str | None = None) -> DataFrame:
    """A recorded counter that restarts at zero, as one that goes on where it stopped.

    A lower value than the one before starts a new count; with ``session`` so does every
    change of it, which also finds a restart that has already passed the old value. Null
    values repeat the total. Each chunk gives its first and last value and what it adds in
    between, so a busy key is as many tasks as it has chunks.
    """
    keys, at = [*by, C.CHUNK], F.struct(ts, *order)
    label = F.lit(0) if session is None else F.col(session)
    known = F.col(value).isNotNull()
    point = F.when(known, F.struct(F.col(value).alias("v"), label.alias("s")))

    def added(now, before):
        goes_on = before["s"].eqNullSafe(now["s"]) & (now["v"] >= before["v"])
        return F.when(goes_on, now["v"] - before["v"]).otherwise(now["v"])

    rows = C.with_chunk(points, ts, chunk).withColumn("_p", point)
    here = C.chunk_window(by, ts, *order)
    before = F.last("_p", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before).withColumn("_add", F.when(
        F.col("_p").isNotNull() & F.col("_b").isNotNull(), added(F.col("_p"), F.col("_b"))))

    table = rows.groupBy(*keys).agg(
        F.min_by("_p", F.when(known, at)).alias("_head"), F.max_by("_p", F.when(known, at)).alias("_tail"),
        F.coalesce(F.sum("_add"), F.lit(0.0)).alias("_inner"))
    series = Window.partitionBy(*(by or [F.lit(0)])).orderBy(C.CHUNK)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_b", F.last("_tail", ignorenulls=True).over(earlier))
    table = table.withColumn("_step", F.when(F.col("_b").isNull(), F.col("_head.v")).otherwise(
        added(F.col("_head"), F.col("_b"))))
    opening = F.coalesce(F.sum(F.coalesce("_step", F.lit(0.0)) + F.col("_inner")).over(earlier), F.lit(0.0))
    table = table.select(*keys, opening.alias("_open"), F.coalesce("_step", F.lit(0.0)).alias("_step"))
    rows = rows.drop("_b").join(table, keys, "left")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.sum("_add").over(so_far), F.lit(0.0))
    entered = F.when(F.count("_p").over(so_far) > 0, F.col("_step")).otherwise(0.0)
    return rows.withColumn(out, F.col("_open") + entered + inside).drop(
        "_p", "_add", "_open", "_step", C.CHUNK)
