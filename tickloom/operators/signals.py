"""Signals from reference moves, and row selection on message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import folds
from tickloom.operators import grid as G
from tickloom.operators.asof import asof_join
from tickloom.operators.ranges import link_asof
from tickloom.session import materialize


def move_signals(reference: DataFrame, targets: DataFrame, links: DataFrame, *, window: int,
                 threshold_bps: float, yes_band: tuple[float, float], min_tte: int, cooldown: int,
                 chunk: int) -> DataFrame:
    """Signals where the reference moved and its live target can still be traded.

    ``reference(ts, seq, mid)`` is one series; ``targets(instrument, ts, seq, mid)`` the
    quotes; ``links(kind, instrument, from_ts, to_ts, seq, expiry)`` the lifecycle spans.
    The move compares with the last change at or before ``ts - window``; each signal must
    come at least ``cooldown`` after the one before.
    """
    series = G.changes(reference, "mid", by=[], ts="ts", order=["seq"], chunk=chunk)
    rows = asof_join(reference, series, at=F.col("ts") - window, take={"mid": "_past"}, tie="seq",
                     chunk=chunk)
    move = (F.col("mid") / F.when(F.abs("_past") > 1e-12, F.col("_past")) - 1) * 1e4
    rows = rows.withColumn("move_bps", move).filter(F.abs("move_bps") >= threshold_bps)
    # candidates are few: written once, every look-up below starts from them
    rows = materialize(rows, "candidates")
    rows = link_asof(rows, links, chunk=chunk)
    rows = rows.filter(F.col("target").isNotNull())
    expiry = links.groupBy("instrument").agg(F.max("expiry").alias("_expiry"))
    rows = rows.join(expiry, rows["target"] == expiry["instrument"]).drop("instrument")
    rows = materialize(rows.filter(F.col("_expiry") - F.col("ts") >= min_tte), "candidates")
    quotes = targets.select(F.col("instrument").alias("target"), "ts", "seq", "mid")
    rows = asof_join(rows, quotes, by=["target"], take={"mid": "yes_price"}, tie="seq", chunk=chunk)
    rows = rows.filter(F.col("yes_price").between(*yes_band))
    rows = asof_join(rows, quotes, by=["target"], at=F.col("ts") - window,
                     take={"mid": "_before"}, tie="seq", chunk=chunk)
    rows = rows.select(
        "ts", "seq", "target", "move_bps", "yes_price",
        ((F.col("yes_price") - F.col("_before")) * 100).alias("target_move_c"),
        F.signum("move_bps").cast("int").alias("direction"))
    return folds.refractory(rows, by=[], ts="ts", gap=cooldown, order=["seq"],
                            chunk=max(chunk, 20 * cooldown))


def conflate(messages: DataFrame, keys: list[str], *, ts: str = "ts", order: str = "seq") -> DataFrame:
    """Latest message per key; as a batch, or within each micro-batch of a stream."""
    packed = F.struct(*[F.col(c) for c in messages.columns])
    return messages.groupBy(*keys).agg(F.max_by(packed, F.struct(ts, order)).alias("_m")).select("_m.*")


def first_triggers(rows: DataFrame, deltas: list[float], *, by: str = "ticker", ts: str = "ts",
                   order: str = "seq") -> DataFrame:
    """First row of each event with |gap| at or above each threshold."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    at = F.struct(ts, order)
    firsts = rows.groupBy(by).agg(*[F.min_by(packed, F.when(F.abs("gap") >= d, at)).alias(f"_d{i}")
                                    for i, d in enumerate(deltas)])
    long = firsts.select(F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.col(f"_d{i}").alias("r"))
                                             for i, d in enumerate(deltas)])).alias("_x"))
    return long.filter(F.col("_x.r").isNotNull()).select("_x.delta", "_x.r.*")


def with_thresholds(rows: DataFrame, deltas: list[float]) -> DataFrame:
    """Each row once per threshold, for sweeps over a list fixed in the call."""
    return rows.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))


def aligned_grid(markets: DataFrame, target: DataFrame, sources: dict[str, DataFrame], *, step: int,
                 chunk: int, by: str = "ticker") -> DataFrame:
    """Sampler rows: every grid step of each active market, all sources as of that step.

    ``markets(ticker, start_ts, expiry)``; ``target(ticker, ts, seq, ybid, yask)``; each source
    is one series ``(ts, seq, bid, ask)`` and gives ``<name>_bid``, ``<name>_ask``, ``<name>_age``.
    Sources do not depend on the market, so they are looked up once per step.
    """
    if chunk % step:
        raise ValueError("chunk must be a multiple of step")
    first = F.ceil(F.col("start_ts") / step) * step
    # two-level unfolding keeps every array within one chunk
    spans = markets.select(by, "expiry", first.cast("long").alias("_lo"), F.explode(F.sequence(
        F.col("start_ts") - F.pmod("start_ts", F.lit(chunk)),
        F.col("expiry") - F.pmod("expiry", F.lit(chunk)), F.lit(chunk))).alias("_c"))
    lo = F.greatest("_lo", "_c")
    hi = F.least(F.col("expiry"), F.col("_c") + F.lit(chunk - step))
    spans = spans.filter(lo <= hi)
    grid = spans.select(by, "expiry", F.explode(F.sequence(lo, hi, F.lit(step))).alias("ts"))
    clock = grid.select("ts").distinct()
    for name, src in sources.items():
        clock = asof_join(clock, src, take={"bid": f"{name}_bid", "ask": f"{name}_ask"}, tie="seq",
                          match_ts="_at", chunk=chunk)
        clock = clock.withColumn(f"{name}_age", F.col("ts") - F.col("_at")).drop("_at")
    rows = asof_join(grid, target, by=[by], take={"ybid": "ybid", "yask": "yask"}, tie="seq",
                     chunk=chunk)
    quoted = (F.col("ybid") > 0) | (F.col("yask") > 0)
    return rows.filter(quoted).join(clock, "ts").withColumn("tte", F.col("expiry") - F.col("ts"))
