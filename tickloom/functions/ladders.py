"""Order-book ladders: arrays of (px, qty), best level first, handled inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
MICRO = 1_000_000


def micro(px: Column) -> Column:
    """Integer micro-price, the key levels are matched on."""
    return F.round(px * MICRO).cast("long")


def level(px: Column, qty: Column) -> Column:
    return F.struct(px.cast("double").alias("px"), qty.cast("double").alias("qty"))


def from_pairs(pairs: Column) -> Column:
    """``[[px, qty], ...]`` to levels, order kept."""
    return F.transform(pairs, lambda p: level(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def normalize(levels: Column, side: str) -> Column:
    """Drop empty levels and sort best first."""
    kept = F.filter(levels, lambda v: v["px"].isNotNull() & (v["qty"] > 0))
    rising = F.array_sort(kept)
    return rising if side == "ask" else F.reverse(rising)


def reflect(levels: Column) -> Column:
    """Ladder of the other outcome: bids at p become asks at 1 - p, same order."""
    return F.transform(levels, lambda v: level(
        F.round((F.lit(1.0) - v["px"]) * MICRO) / MICRO, v["qty"]))


def top_n(levels: Column, n: int) -> Column:
    return F.slice(levels, 1, n)


def best(levels: Column, field: str = "px") -> Column:
    return F.get(levels, F.lit(0))[field]


def total_qty(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, v: acc + v["qty"])


def mid(bids: Column, asks: Column) -> Column:
    b, a = best(bids), best(asks)
    return F.when((b > 0) & (a > 0), (b + a) / 2)


def spread_bps(bids: Column, asks: Column) -> Column:
    m = mid(bids, asks)
    return (best(asks) - best(bids)) / m * 1e4


def _balance(b: Column, a: Column) -> Column:
    return F.when(b + a > 0, (b - a) / F.when(b + a > 0, b + a)).otherwise(0.0)


def imbalance(bids: Column, asks: Column, k: int, require_coverage: bool = False) -> Column:
    """Quantity imbalance of the top k levels, 0 when empty.

    With ``require_coverage`` a book showing fewer than k levels gives null.
    """
    out = _balance(total_qty(top_n(bids, k)), total_qty(top_n(asks, k)))
    if require_coverage:
        return F.when((F.size(bids) >= k) & (F.size(asks) >= k), out)
    return out


def band_imbalance(bids: Column, asks: Column, bps: float,
                   require_coverage: bool = False) -> Column:
    """Quantity imbalance within ``bps`` of the mid; null if the ladder stops short of it."""
    m = mid(bids, asks)
    lo, hi = m * (1 - bps / 1e4), m * (1 + bps / 1e4)
    b = total_qty(F.filter(bids, lambda v: v["px"] >= lo))
    a = total_qty(F.filter(asks, lambda v: v["px"] <= hi))
    out = F.when(m.isNotNull(), _balance(b, a))
    if require_coverage:
        deep = (F.element_at(bids, -1)["px"] <= lo) & (F.element_at(asks, -1)["px"] >= hi)
        return F.when(deep, out)
    return out


def micro_offset_bps(bids: Column, asks: Column) -> Column:
    """Size-weighted price between the best quotes, as offset from the mid."""
    b, a, bq, aq = best(bids), best(asks), best(bids, "qty"), best(asks, "qty")
    m = mid(bids, asks)
    fair = F.when(bq + aq > 0, (a * bq + b * aq) / F.when(bq + aq > 0, bq + aq))
    return (fair - m) / m * 1e4


def sweep(levels: Column, size: Column, limit: Column, side: str) -> Column:
    """Fill of a marketable order: ``struct(qty, vwap)``.

    ``side='sell'`` takes bids down to ``limit``, ``'buy'`` asks up to it; the first
    level that fails ends the sweep, as levels come best first.
    """
    start = F.struct(size.cast("double").alias("left"), F.lit(0.0).alias("qty"),
                     F.lit(0.0).alias("cash"), F.lit(True).alias("on"))

    def step(acc, v):
        inside = (v["px"] >= limit - EPS) if side == "sell" else (v["px"] <= limit + EPS)
        on = acc["on"] & (acc["left"] > EPS) & (v["px"] > 0) & (v["qty"] > 0) & inside
        take = F.when(on, F.least(acc["left"], v["qty"])).otherwise(0.0)
        return F.struct((acc["left"] - take).alias("left"), (acc["qty"] + take).alias("qty"),
                        (acc["cash"] + take * v["px"]).alias("cash"), on.alias("on"))

    return F.aggregate(levels, start, step, lambda acc: F.struct(
        acc["qty"].alias("qty"),
        F.when(acc["qty"] > EPS, acc["cash"] / F.when(acc["qty"] > EPS, acc["qty"]))
        .otherwise(0.0).alias("vwap")))


def implied_level(quotes: Column) -> Column:
    """Strike where the ladder of P(above strike) crosses one half.

    ``quotes`` holds (strike, p). The last strike with p >= 0.5 and the next one are
    interpolated; null with fewer than two quotes, no crossing, or none above it.
    """
    rows = F.array_sort(F.filter(quotes, lambda q: q["p"].isNotNull()))
    start = F.struct(F.lit(None).cast("double").alias("k0"), F.lit(None).cast("double").alias("p0"),
                     F.lit(None).cast("double").alias("k1"), F.lit(None).cast("double").alias("p1"),
                     F.lit(False).alias("open"))

    def step(acc, q):
        above = q["p"] >= 0.5
        none = F.lit(None).cast("double")
        take_next = ~above & acc["open"]
        return F.struct(
            F.when(above, q["strike"]).otherwise(acc["k0"]).alias("k0"),
            F.when(above, q["p"]).otherwise(acc["p0"]).alias("p0"),
            F.when(above, none).when(take_next, q["strike"]).otherwise(acc["k1"]).alias("k1"),
            F.when(above, none).when(take_next, q["p"]).otherwise(acc["p1"]).alias("p1"),
            F.when(above, True).when(take_next, False).otherwise(acc["open"]).alias("open"))

    def done(acc):
        slope = F.when(acc["p0"] != acc["p1"], acc["p0"] - acc["p1"])
        return F.when(acc["k1"].isNotNull(), F.coalesce(
            acc["k0"] + (acc["k1"] - acc["k0"]) * (acc["p0"] - 0.5) / slope, acc["k0"]))

    return F.when(F.size(rows) >= 2, F.aggregate(rows, start, step, done))
