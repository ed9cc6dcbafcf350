"""Price, fee, sizing and gate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
WINDOW_S = 900.0


TAKER_RATE = 0.07  # fixed value


def fee(price: Column, qty: Column | None = None, rate: Column | float = TAKER_RATE,
        round_up_cents: bool = False) -> Column:
    """Quadratic taker fee; ``round_up_cents`` charges whole cents per order."""
    cost = (rate if isinstance(rate, Column) else F.lit(rate)) * price * (1 - price)
    if qty is not None:
        cost = cost * qty
    return F.ceil(F.round(cost * 100, 9)) / 100 if round_up_cents else cost


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tau(tte_s: Column) -> Column:
    return F.least(F.greatest(tte_s / WINDOW_S, F.lit(1e-4)), F.lit(1.0))


def z_prime(px: Column, b: Column, s: Column, tte_s: Column) -> Column:
    """Distance to the strike level in scale units, over root remaining time."""
    return ((px - b) / s) / F.sqrt(tau(tte_s))


def fresh(age: Column, limit: int) -> Column:
    return age.isNotNull() & (age >= 0) & (age <= limit)


def valid_book(bid: Column, ask: Column, max_spread: float = 0.15) -> Column:
    """Two-sided, uncrossed and not wider than ``max_spread``."""
    return (bid > 0) & (ask > bid) & (ask - bid <= max_spread)


def valid_tte(tte_s: Column, limit: float = WINDOW_S) -> Column:
    return (tte_s > 0) & (tte_s <= limit)


def active_row(expiry: Column, bid: Column, ask: Column, tte_ms: Column) -> Column:
    """Sampler eligibility: expiry known, any side quoted, around the live window."""
    quoted = (bid > 0) | (ask > 0)
    return expiry.isNotNull() & quoted & tte_ms.between(-10_000, 1_200_000)


def market_param(own: Column, default: float) -> Column:
    return F.coalesce(own, F.lit(default))


def plan_size(target: float, depth_frac: float, ask_sz: Column) -> Column:
    """Fixed target size capped by a share of the displayed depth."""
    return F.least(F.lit(target), F.lit(depth_frac) * ask_sz)


def exposure_ok(net: Column, direction: Column, size: Column, cap: float) -> Column:
    """Growth past the cap is refused, reduction never is."""
    after = F.abs(net + direction * size)
    return (after <= cap + EPS) | (after <= F.abs(net) + EPS)


def risk_reason(*, book_age_ms: Column, ask: Column, tte_ms: Column, signal_age_ms: Column,
                size: Column, cfg: dict) -> Column:
    """First failing pre-trade check in order, null when all pass."""
    lo, hi = cfg["yes_bucket"]
    checks = [
        (F.lit(bool(cfg.get("halted", False))), "halted"),
        (book_age_ms > cfg["stale_ms"], "stale book"),
        (ask.isNull() | F.isnan(ask) | (ask < lo) | (ask > hi), "price bucket"),
        (tte_ms.isNull(), "no expiry"),
        (tte_ms < cfg["min_tte_ms"], "tte min"),
        (tte_ms > cfg["max_tte_ms"], "tte max"),
        (signal_age_ms > cfg["ttl_ms"], "stale signal"),
        (size * ask > cfg["max_order_notional"], "notional"),
    ]
    return F.coalesce(*[F.when(cond, name) for cond, name in checks])


def close_price(complement_px: Column) -> Column:
    """Buying the complement at p sells the held side at 1 - p."""
    return F.lit(1.0) - complement_px
