"""Model inputs by feature name.

All lags of one series are range frames over the same ``(key, chunk)`` window, so any
number of features costs a single shuffle. Frames are only as wide as a lag tolerance.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import chunks as C
from tickloom.operators import grid as G
from tickloom.operators.asof import asof_join
from tickloom.operators.stats import clip
from tickloom.functions import ladders as L

# Lag tolerances and staleness limits, in seconds.
LAG_TOL_S, CB_STALE_S, VOL_TOL_S, DEPTH_STALE_S = 2, 5, 5, 2


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    args: tuple[int, ...] = ()


# most specific prefix first: imb1 and imb1avg before imb, the p-momenta before mom
GRAMMAR = [("basis", r"basis"), ("imb1", r"imb1"), ("imb1avg", r"imb1avg(\d+)"),
           ("imb", r"imb(\d+)"), ("dbasis", r"dbasis(\d+)"), ("band", r"band(\d+)"),
           ("pcbmom", r"pcbmom(\d+)"), ("pkrmom", r"pkrmom(\d+)"), ("pmom", r"pmom(\d+)"),
           ("mom", r"mom(\d+)"), ("vsurge", r"vsurge(?:(\d+)_(\d+))?")]


def parse(name: str) -> Feature:
    for kind, pattern in GRAMMAR:
        m = re.fullmatch(pattern, name)
        if m:
            args = tuple(int(g) for g in m.groups() if g is not None)
            return Feature(name, kind, args or ((60, 600) if kind == "vsurge" else ()))
    raise ValueError(f"unknown feature {name!r}")


def row_features(rows: DataFrame, names: Sequence[str], *, second: int, chunk: int,
                 by: Sequence[str] = ("ticker",), ts: str = "ts", spot: str = "spot",
                 cb: str = "cb_mid", kr: str = "kr_mid") -> DataFrame:
    """Features from a row table's own columns (the replay of recorded rows).

    A lag takes the youngest row at least k seconds old and at most ``LAG_TOL_S`` older
    than that. Names that are columns of the table are used as they are.
    """
    wanted = [f for f in (Feature(n, "column") if n in rows.columns and n != "imb1" else parse(n)
                          for n in names)]
    lags = {"mom": spot, "pmom": spot, "pcbmom": cb, "pkrmom": kr}
    reach = max([f.args[0] for f in wanted if f.kind in lags or f.kind == "dbasis"] or [0])
    base = rows
    if any(f.kind in ("basis", "dbasis") for f in wanted):
        base = base.withColumn("_basis", F.col(cb) - F.col(spot))
    if reach:
        base = C.with_halo(base, ts, chunk, before=(reach + LAG_TOL_S) * second)
    win = C.chunk_window(by, ts) if reach else None

    def lag(column: str, k: int) -> Column:
        frame = win.rangeBetween(-(k + LAG_TOL_S) * second, -k * second)
        return F.last(column).over(frame)

    for f in wanted:
        if f.kind == "column":
            continue
        if f.kind in ("pmom", "pcbmom", "pkrmom"):
            past = lag(lags[f.kind], f.args[0])
            value = (F.col(lags[f.kind]) - past) / F.when(past != 0, past)
        elif f.kind == "mom":
            value = F.col(spot) - lag(spot, f.args[0])
        elif f.kind == "basis":
            value = F.col("_basis")
        elif f.kind == "dbasis":
            value = F.col("_basis") - lag("_basis", f.args[0])
        elif f.kind == "imb1":
            value = F.col("imb1")
        else:
            raise ValueError(f"{f.name} needs the feed tables or a column of that name")
        base = base.withColumn(f.name, value)
    base = base.drop("_basis")
    return C.drop_halo(base) if reach else base


def feed_features(probes: DataFrame, names: Sequence[str], *, second: int, chunk: int,
                  perp: DataFrame, cb: DataFrame, volume: DataFrame | None = None,
                  depth: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Features at ``probes`` from the recorded feeds, as the live reconstruction sees them.

    ``perp(ts, mid, bid_sz, ask_sz)``, ``cb(ts, mid)``, ``volume(ts, cum)`` and
    ``depth(ts, bids, asks)`` are one series each. A feature that cannot be built is null.
    """
    out = probes
    s = second

    def add(right, take, at=None, tol=None):
        nonlocal out
        out = asof_join(out, right, ts=ts, at=at, tol=tol, take=take, chunk=chunk)

    add(perp, {"mid": "_p", "bid_sz": "_bs", "ask_sz": "_as"})
    add(cb, {"mid": "_c"}, tol=CB_STALE_S * s)
    wanted = [parse(n) for n in names]
    if any(f.kind == "dbasis" for f in wanted):
        ticks = perp.select(ts, F.col("mid").alias("_pm"), F.lit(None).cast("double").alias("_cm"))
        ticks = ticks.unionByName(cb.select(ts, F.lit(None).cast("double").alias("_pm"),
                                            F.col("mid").alias("_cm")))
        ticks = C.fill_forward(ticks, {"_pm": "_pf", "_cm": "_cf"}, by=[], ts=ts, chunk=chunk)
        basis = ticks.select(ts, (F.col("_cf") - F.col("_pf")).alias("basis")).filter(
            F.col("basis").isNotNull())
    if any(f.kind == "imb1avg" for f in wanted):
        sized = perp.filter(F.col("bid_sz") + F.col("ask_sz") > 0).withColumn("imb1", (
            F.col("bid_sz") - F.col("ask_sz")) / (F.col("bid_sz") + F.col("ask_sz")))
        sampled = G.bucket_pick(sized, ["imb1"], by=[], ts=ts, step=s, which="first")
    temps = []
    for f in wanted:
        k = f.args[0] if f.args else 0
        at = F.col(ts) - k * s
        tmp = f"_l_{f.name}"
        temps.append(tmp)
        if f.kind == "basis":
            value = F.col("_c") - F.col("_p")
        elif f.kind == "dbasis":
            add(basis, {"basis": tmp}, at=at, tol=LAG_TOL_S * s)
            value = F.col("_c") - F.col("_p") - F.col(tmp)
        elif f.kind == "imb1":
            total = F.col("_bs") + F.col("_as")
            value = F.when(total > 0, (F.col("_bs") - F.col("_as")) / F.when(total > 0, total))
        elif f.kind == "imb1avg":
            out = _window_mean(out, sampled, "imb1", tmp, ts=ts, span=k * s, chunk=chunk)
            value = F.col(tmp)
        elif f.kind in ("mom", "pmom"):
            add(perp, {"mid": tmp}, at=at, tol=LAG_TOL_S * s)
            value = F.col("_p") - F.col(tmp)
            if f.kind == "pmom":
                value = value / F.when(F.col(tmp) > 0, F.col(tmp))
        elif f.kind == "pcbmom":
            add(cb, {"mid": tmp}, at=at, tol=CB_STALE_S * s)
            value = (F.col("_c") - F.col(tmp)) / F.when(F.col(tmp) > 0, F.col(tmp))
        elif f.kind == "vsurge":
            short, long = f.args
            add(volume, {"cum": f"{tmp}0"})
            add(volume, {"cum": f"{tmp}s"}, at=F.col(ts) - short * s, tol=VOL_TOL_S * s)
            add(volume, {"cum": f"{tmp}l"}, at=F.col(ts) - long * s, tol=VOL_TOL_S * s)
            temps += [f"{tmp}{x}" for x in "0sl"]
            den = F.col(f"{tmp}0") - F.col(f"{tmp}l")
            value = F.when(den > 0, (F.col(f"{tmp}0") - F.col(f"{tmp}s")) / F.when(den > 0, den))
        elif f.kind in ("imb", "band"):
            add(depth, {"bids": f"{tmp}b", "asks": f"{tmp}a"}, tol=DEPTH_STALE_S * s)
            temps += [f"{tmp}b", f"{tmp}a"]
            fn = L.imbalance if f.kind == "imb" else L.band_imbalance
            value = fn(F.col(f"{tmp}b"), F.col(f"{tmp}a"), k, require_coverage=True)
        else:
            raise ValueError(f"{f.name} is not available from the feeds")
        ready = F.col("_p").isNotNull() & F.col("_c").isNotNull()
        out = out.withColumn(f.name, F.when(ready, value))
    return out.drop("_p", "_bs", "_as", "_c", *temps)


def _window_mean(probes: DataFrame, series: DataFrame, value: str, out: str, *, ts: str,
                 span: int, chunk: int) -> DataFrame:
    """Mean of the series over ``[ts - span, ts]``: probes join the series' own window."""
    whole = F.struct(*[F.col(c) for c in probes.columns])
    rows = probes.select(F.col(ts).alias("_t"), whole.alias("_row"))
    both = rows.unionByName(series.select(F.col(ts).alias("_t"), F.col(value).alias("_v")),
                            allowMissingColumns=True)
    both = C.trailing(both, {out: ("avg", "_v")}, by=[], ts="_t", span=span, chunk=chunk)
    return both.filter(F.col("_row").isNotNull()).select("_row.*", out)


def standardize(df: DataFrame, names: Sequence[str], mu: Sequence[float], sd: Sequence[float],
                limit: float = 5.0) -> DataFrame:
    """z-score by the model's own moments, clipped."""
    for name, m, s in zip(names, mu, sd):
        df = df.withColumn(name, clip((F.col(name) - F.lit(m)) / F.lit(s), -limit, limit))
    return df


def complete_rows(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every input present, and one row of kept and dropped counts."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    counts = df.agg(F.count(F.when(ok, 1)).alias("kept"), F.count(F.when(~ok, 1)).alias("dropped"))
    return df.filter(ok), counts
