"""Bucket labels for time to expiry, entry price and moneyness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The report buckets. Time buckets are (low, high], price buckets [low, high).
TTE_BUCKETS = [(300, 240), (240, 180), (180, 120), (120, 60), (60, 0)]
TTE_EARLY_BUCKETS = [(900, 600), (600, 450), (450, 300)]
PRICE_BUCKETS = [(0.02, 0.20), (0.20, 0.35), (0.35, 0.50), (0.50, 0.65), (0.65, 0.80),
                 (0.80, 0.98)]
MONEYNESS_BUCKETS = [
    ("0.05-0.20", 0.05, 0.20), ("0.20-0.35", 0.20, 0.35), ("0.35-0.45", 0.35, 0.45),
    ("0.45-0.55 ATM", 0.45, 0.55), ("0.55-0.65", 0.55, 0.65), ("0.65-0.80", 0.65, 0.80),
    ("0.80-0.95", 0.80, 0.95)]


def _choose(pairs, default) -> Column:
    out = None
    for cond, label in pairs:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out if default is None else out.otherwise(default)


def tte_bucket(tte: Column, buckets: Sequence = TTE_BUCKETS, default: str | None = "other"):
    return _choose([((tte > lo) & (tte <= hi), f"{hi}-{lo}s") for hi, lo in buckets], default)


def price_bucket(price: Column, buckets: Sequence = PRICE_BUCKETS, default: str | None = "other"):
    return _choose([((price >= lo) & (price < hi), f"{lo:.2f}-{hi:.2f}") for lo, hi in buckets],
                   default)


def moneyness_bucket(mid: Column):
    """Null outside the seven buckets."""
    return _choose([((mid >= lo) & (mid < hi), name) for name, lo, hi in MONEYNESS_BUCKETS], None)


def edge_bucket(value: Column, edges: Sequence[float], labels: Sequence[str] | None = None,
                closed: str = "left"):
    """Label of the edge pair holding ``value``; ``closed`` says which end belongs to it."""
    pairs = []
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = ((value >= lo) & (value < hi)) if closed == "left" else (
            (value > lo) & (value <= hi))
        pairs.append((inside, labels[i] if labels else f"{lo:g}-{hi:g}"))
    return _choose(pairs, None)


def in_band(price: Column, lo: float, hi: float) -> Column:
    return price.between(lo, hi)
