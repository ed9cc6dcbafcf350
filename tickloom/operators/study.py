"""Event studies: paths around reference moves, trade tape, lead-lag, probe and feed statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import buckets as B
from tickloom.operators import chunks as C
from tickloom.operators import stats as S
from tickloom.operators.asof import asof_join
from tickloom.operators.folds import fold_groups
from tickloom.operators.ranges import window_totals
from tickloom.session import materialize

# ── paths around events ──────────────────────────────────────────────────────


def event_timeline(events: DataFrame, series: DataFrame, offsets: Sequence[int], *, base: int,
                   value: str = "px", by: Sequence[str] = (), log: bool = False,
                   scale: float = 1.0, tie: str = "seq", chunk: int) -> DataFrame:
    """Signed move of the series from ``t0 + base`` to each ``t0 + offset``, one row per offset.

    Look-ups are strictly before the instant. ``log`` gives log returns times ``scale``.
    """
    kw = dict(by=by, right_ts="ts", strict=True, tie=tie, chunk=chunk)
    # the base price is looked up as one more offset, so each event is probed in one join
    marks = F.array(*[F.lit(o).cast("long") for o in dict.fromkeys([base, *offsets])])
    rows = events.withColumn("offset", F.explode(marks))
    rows = asof_join(rows, series, ts="t0", at=F.col("t0") + F.col("offset"),
                     take={value: "_v"}, **kw)
    keys = [c for c in events.columns]
    packed = F.collect_list(F.struct("offset", "_v"))  # a handful of offsets per event
    rows = rows.groupBy(*keys).agg(packed.alias("_o"))
    first = F.get(F.filter("_o", lambda o: o["offset"] == base), F.lit(0))["_v"]
    rows = rows.withColumn("base", first).filter(F.col("base").isNotNull())
    rows = rows.select(*keys, "base", F.explode("_o").alias("_p")).filter(
        F.col("_p.offset").isin(*offsets) & F.col("_p._v").isNotNull())
    v = F.col("_p._v")
    move = (F.log(v) - F.log("base")) if log else v - F.col("base")
    return rows.select(*keys, "base", F.col("_p.offset").alias("offset"), v.alias("level"),
                       (F.col("dir") * move * scale).alias("move"))


def event_path(timeline: DataFrame, final: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean path with standard error, and share of the move at the ``final`` offset."""
    path = timeline.groupBy(*by, "offset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("move").alias("mean"),
        (F.stddev_pop("move") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    w = Window.partitionBy(*(by or [F.lit(0)]))  # one row per offset
    last = F.max(F.when(F.col("offset") == final, F.col("mean"))).over(w)
    return path.withColumn("pct_final", F.when(F.abs(last) > 1e-9, 100 * F.col("mean") / F.when(
        F.abs(last) > 1e-9, last)))


def rise_time(path: DataFrame, levels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """First offset reaching each share of the final move, and the interpolated crossing."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("offset")  # one row per offset
    p = F.col("pct_final")
    rows = path.withColumn("_po", F.lag("offset").over(w)).withColumn("_pv", F.lag(p).over(w))
    aggs = []
    for level in levels:
        hit = F.when(p >= level, F.col("offset"))
        cross = (F.col("_pv") < level) & (p >= level) & (p != F.col("_pv"))
        at = F.col("_po") + (level - F.col("_pv")) / (p - F.col("_pv")) * (
            F.col("offset") - F.col("_po"))
        aggs += [F.min(hit).alias(f"reach_{level}"),
                 F.min_by(F.when(cross, at), F.when(cross, F.col("offset"))).alias(f"cross_{level}")]
    return rows.groupBy(*by).agg(*aggs)


def response_by(obs: DataFrame, bucket: Column, values: Sequence[str],
                min_rows: int = 1) -> DataFrame:
    rows = obs.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]).filter(
        F.col("n") >= min_rows)


def bucket_net(obs: DataFrame, lo: float = 0.05, hi: float = 0.95, width: float = 0.1,
               min_rows: int = 5) -> DataFrame:
    """Edge per price bucket after spread and fees, in cents.

    Taker pays the spread and both legs' fees at the bucket midpoint, maker one leg's fee.
    """
    i = F.floor((F.col("p0") - lo) / width + 1e-9)
    rows = obs.filter((F.col("p0") >= lo) & (F.col("p0") < hi)).withColumn("bucket", i)
    out = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("edge_c").alias("edge_c"),
                                     F.avg("spread_c").alias("spread_c"))
    p = lo + (F.col("bucket") + 0.5) * width
    fee = 7 * p * (1 - p)
    return out.filter(F.col("n") >= min_rows).select(
        "bucket", "n", "edge_c", "spread_c", fee.alias("fee_c"),
        (F.col("edge_c") - F.col("spread_c") - 2 * fee).alias("net_taker"),
        (F.col("edge_c") - fee).alias("net_maker"))


def lag_vs_moved(events: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Forward means of events whose target had not moved in the window, and of the others."""
    group = F.when(F.col("pre") <= 0, "lag").otherwise("moved")
    return events.groupBy(group.alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pre").alias("pre"),
        *[F.avg(h).alias(h) for h in horizons])


def direction_hits(events: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Per horizon: mean move, share in the right direction among movers, share flat."""
    long = events.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).alias("r"))
                                             for h in horizons])).alias("_h")).select("_h.*")
    moved = F.col("r") != 0
    return long.filter(F.col("r").isNotNull()).groupBy("horizon").agg(
        F.avg("r").alias("mean"), F.avg(F.when(moved, (F.col("r") > 0).cast("int"))).alias("hit"),
        F.avg((~moved).cast("int")).alias("flat"), F.count(F.when(moved, 1)).alias("movers"))


def catch_up(events: DataFrame, horizon: str) -> DataFrame:
    """Share of the move up to ``horizon`` that comes after the event."""
    total = F.avg("pre") + F.avg(horizon)
    return events.agg(F.count(F.lit(1)).alias("n"), F.when(
        F.abs(total) > 1e-9, F.avg(horizon) / F.when(F.abs(total) > 1e-9, total)).alias("after"))


# ── trade tape ───────────────────────────────────────────────────────────────

def counted_from(ranks: np.ndarray, upto: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many of the first ``upto`` ranks are ``least`` or more, for many queries at once.

    A wavelet matrix: ranks are split stably by one bit at a time, highest first, and a query follows
    its bound; wherever the bound has a 0, ranks with a 1 are above it.
    """
    low, high, out = np.zeros_like(upto), upto.copy(), np.zeros_like(upto)
    for bit in range(int(max(ranks.max(initial=0), least.max(initial=0))).bit_length() - 1, -1, -1):
        ones = ranks >> bit & 1
        before = np.append(0, np.cumsum(ones))
        one_low, one_high = before[low], before[high]
        wants = (least >> bit & 1).astype(bool)
        out += np.where(wants, 0, one_high - one_low)
        zeros = len(ranks) - int(before[-1])
        low = np.where(wants, zeros + one_low, low - one_low)
        high = np.where(wants, zeros + one_high, high - one_high)
        ranks = ranks[np.argsort(ones, kind="stable")]
    return out + (high - low)


def repeats_in_windows(events: DataFrame, ticks: DataFrame, *, pre: int, post: int, before: str, chunk: int,
                       event_id: str, ts: str = "ts") -> DataFrame:
    """Per event how many ticks of ``[t0 - pre, t0 + post)`` have their ``before`` time in it as well.

    A two-sided rank count (time below the window's end, ``before`` at or above its start), made per
    time chunk; ticks are copied into the chunks whose windows reach them, events stay one row.
    """
    window = pre + post
    rows = C.with_halo(ticks.select(F.col(ts).alias("_t"), F.col(before).alias("_b")).filter("_b is not null"),
                       "_t", chunk, after=window).drop(C.HOME)
    asked = C.with_chunk(events.select(event_id, (F.col("t0") - pre).alias("_t")), "_t", chunk).withColumn("_asks", F.lit(True))
    both = asked.unionByName(rows.withColumn("_asks", F.lit(False)), allowMissingColumns=True)

    def count(key, d):
        asks = d["_asks"].astype(bool)
        if not asks.any():
            return None
        times, start = d["_t"][~asks].astype("int64"), d["_t"][asks].astype("int64")
        known = d["_b"][~asks].astype("int64")
        values = np.unique(known)
        n = counted_from(np.searchsorted(values, known), np.searchsorted(times, start + window), np.searchsorted(values, start))
        return {event_id: d[event_id][asks], "repeats": n}

    schema = T.StructType([events.schema[event_id], T.StructField("repeats", T.LongType())])
    return fold_groups(both, [C.CHUNK], ["_t"], count, schema)


def tape_stats(events: DataFrame, trades: DataFrame, *, pre: int, post: int, chunk: int,
               event_id: str = "event_id", order: str = "seq") -> DataFrame:
    """Trades around each move: count, volume, price levels, aligned share, sweep flag.

    Fills sharing an exchange time at two or more prices are one taker sweeping levels. No
    event-trade pairs are formed: counts and volumes are differences of running totals; a level
    counts once, at the trade whose previous trade at that price lies before the window; and a
    window has a sweep where the latest partner (a fill of the same instant at another price) of
    any trade before its end is not older than its start.
    """
    tape = materialize(trades.select("ts", order, "exch_ts", "qty", "side", F.round("px", 4).alias("_level")), "tape")
    tape = C.previous(tape, {"ts": "_same"}, by=["_level"], ts="ts", order=[order], chunk=chunk)
    burst = Window.partitionBy("exch_ts").orderBy("ts", order)
    other = F.when(F.lag("_level").over(burst) != F.col("_level"), F.lag("ts").over(burst))
    tape = materialize(tape.withColumn("_other", other).withColumn("_other", F.last("_other", ignorenulls=True).over(burst)), "tape")

    buys = F.when(F.col("side") == "Buy", F.col("qty")).otherwise(0.0)
    sells = F.when(F.col("side") == "Sell", F.col("qty")).otherwise(0.0)
    out = window_totals(events, tape, {"trades": F.lit(1), "volume": F.col("qty"), "_buys": buys, "_sells": sells},
                        start=F.col("t0") - pre, end=F.col("t0") + post, by=[], chunk=chunk).filter("trades > 0")
    twice = repeats_in_windows(events, tape, pre=pre, post=post, before="_same", chunk=chunk, event_id=event_id)
    partners = C.fill_max(tape.filter("_other is not null").select("ts", order, "_other"), "_other", "_partner", ts="ts",
                          order=[order], chunk=chunk)
    out = asof_join(out, partners, by=[], at=F.col("t0") + post, strict=True, take={"_partner": "_partner"}, tie=order, ts="t0",
                    right_ts="ts", chunk=chunk)
    aligned = F.when(F.col("dir") > 0, F.col("_buys")).otherwise(F.col("_sells"))
    return out.join(twice, event_id).select(
        event_id, "trades", "volume", (F.col("trades") - F.col("repeats")).alias("levels"),
        (aligned / F.col("volume")).alias("aligned"), F.coalesce(F.col("_partner") >= F.col("t0") - pre, F.lit(False)).alias("swept"))


def sweep_timing(events: DataFrame, trades: DataFrame, *, pre: int, post: int,
                 bucket: int) -> DataFrame:
    """Time from the move to the first trade and to the sweep with most aligned volume.

    A cluster is the trades of one ``exch_ts`` that lie in ``[t0 - pre, t0 + post)``, a sweep one of
    two trades and two levels at least. Events are placed by time buckets, trades copied into the
    buckets that reach them. Within a bucket a cluster is a stretch of sorted trades, cut by the
    edges of a window at either end; its numbers are totals running in from its ends, so an event
    meets the clusters of its window but not their trades.
    """
    moves = events.filter(F.col("t0").isNotNull()).groupBy("event_id", "t0").agg(
        F.count(F.lit(1)).alias("_m"), F.count_if(F.col("dir") > 0).alias("_up"))
    moves = C.with_chunk(moves, "t0", bucket)
    side = lambda name: F.coalesce(F.col("side") == name, F.lit(False))
    slim = trades.select(
        "ts", F.coalesce("exch_ts", F.lit((1 << 63) - 1)).alias("exch"), (F.round("px", 4) + 0.0).alias("level"), "qty",
        side("Buy").alias("buy"), side("Sell").alias("sell"))
    slim = C.with_halo(slim, "ts", bucket, before=pre, after=post).drop(C.HOME)
    schema = T.StructType([events.schema["event_id"], *[T.StructField(n, t) for n, t in (
        ("first_trade", T.LongType()), ("main_sweep", T.LongType()), ("sweep_volume", T.DoubleType()),
        ("sweep_levels", T.LongType()))]])

    def timed(left, right):
        return _sweeps(left, right, pre, post)

    return moves.groupBy(C.CHUNK).cogroup(slim.groupBy(C.CHUNK)).applyInArrow(timed, schema)


def _sweeps(events: pa.Table, trades: pa.Table, pre: int, post: int) -> pa.Table:
    """One bucket of ``sweep_timing``: its events, and all trades that they reach."""
    events = events.sort_by("t0")
    t0, many, up = (events.column(n).to_numpy() for n in ("t0", "_m", "_up"))
    start, end = t0 - pre, t0 + post
    ts, exch = (trades.column(n).to_numpy() for n in ("ts", "exch"))
    times = np.append(np.sort(ts), 0)
    met = np.searchsorted(times[:-1], start) < np.searchsorted(times[:-1], end)
    first = times[np.searchsorted(times[:-1], start)] - t0

    order = np.lexsort((ts, exch))
    ts, exch = ts[order], exch[order]
    level = trades.column("level").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(
        zero_copy_only=False)[order]
    qty = trades.column("qty").cast("double").to_numpy()[order]
    unknown = trades.column("qty").is_null().to_numpy()[order]
    # per direction: what a trade adds to the aligned volume, and whether it adds a number at all
    aligned = [(np.where(own & ~unknown, qty, 0.0), ~(own & unknown)) for own in (
        trades.column(n).to_numpy()[order] for n in ("buy", "sell"))]

    size = len(t0)
    found, known = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    volume, at, levels = np.zeros(size), np.zeros(size, dtype="int64"), np.zeros(size, dtype="int64")
    cuts = np.r_[0, np.flatnonzero(np.diff(exch)) + 1, len(exch)] if size and len(exch) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):  # ascending times of the exchange: of equal volumes the earliest stays
        codes = level[a:b]
        codes = np.unique(codes, return_inverse=True)[1] - int(codes.min() < 0)  # unknown levels do not count
        if codes.max() < 1:
            continue
        t = ts[a:b]
        e = slice(np.searchsorted(t0, t[0] - post, side="right"), np.searchsorted(t0, t[-1] + pre, side="right"))
        lo, hi = np.searchsorted(t, start[e]), np.searchsorted(t, end[e])
        n_levels = _distinct_between(codes, lo, hi)
        sums = [[_sum_between(v[a:b], lo, hi) for v in pair] for pair in aligned]
        ups, downs = up[e], many[e] - up[e]
        total = ups * sums[0][0] + downs * sums[1][0]
        some = (ups * sums[0][1] + downs * sums[1][1]) > 0  # a sum of nothing but unknown sizes is unknown
        sweep = ((hi - lo) * many[e] >= 2) & (n_levels >= 2)
        better = sweep & (~found[e] | (some & ~known[e]) | (some & known[e] & (total > volume[e])))
        ix = np.flatnonzero(better) + e.start
        found[ix], known[ix], volume[ix] = True, some[better], total[better]
        at[ix], levels[ix] = t[lo[better]] - t0[ix], n_levels[better]
    keep = np.flatnonzero(met)
    none = ~found[keep]
    return pa.table({
        "event_id": events.column("event_id").take(pa.array(keep)),
        "first_trade": pa.array(first[keep]), "main_sweep": pa.array(at[keep], mask=none),
        "sweep_volume": pa.array(volume[keep], mask=none | ~known[keep]),
        "sweep_levels": pa.array(levels[keep], mask=none)})


def _sum_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of ``values[lo:hi]``: totals from the nearer end; where both ends are cut off, a difference."""
    up = np.append(0, np.cumsum(values))
    down = np.append(np.cumsum(values[::-1])[::-1], 0)
    out = np.where(lo == 0, up[hi], down[lo])
    inner = (lo > 0) & (hi < len(values))
    if inner.any():
        wide = np.append(0, np.cumsum(values.astype(np.longdouble)))
        out[inner] = (wide[hi[inner]] - wide[lo[inner]]).astype(out.dtype)
    return out


def _distinct_between(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Different codes, those below 0 left out, in ``codes[lo:hi]``."""
    n = len(codes)
    new, last = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")
    new[np.unique(codes, return_index=True)[1]] = 1
    last[n - 1 - np.unique(codes[::-1], return_index=True)[1]] = 1
    new[codes < 0] = last[codes < 0] = 0
    out = np.where(lo == 0, np.append(0, np.cumsum(new))[hi], np.append(np.cumsum(last[::-1])[::-1], 0)[lo])
    inner = np.flatnonzero((lo > 0) & (hi < n) & (lo < hi))
    if len(inner):
        out[inner] = 0
        places = np.argsort(codes, kind="stable")
        for p in np.split(places, np.flatnonzero(np.diff(codes[places])) + 1):
            if codes[p[0]] >= 0:
                out[inner] += np.searchsorted(p, lo[inner]) < np.searchsorted(p, hi[inner])
    out[lo >= hi] = 0
    return out


# ── lead-lag ─────────────────────────────────────────────────────────────────

def lagged_pairs(grid: DataFrame, lags: Sequence[int], *, by: Sequence[str], ts: str, step: int,
                 chunk: int, y: str = "y") -> DataFrame:
    """``y`` at each lag next to ``x``, as columns ``_y0.._yn``; ends are null, never wrapped."""
    rows = C.with_halo(grid, ts, chunk, before=max(0, -min(lags)) * step,
                       after=max(0, max(lags)) * step)
    win = C.chunk_window(by, ts)
    for i, lag in enumerate(lags):
        rows = rows.withColumn(f"_y{i}", F.lead(y, lag).over(win))
    return C.drop_halo(rows)


def pooled_xcorr(grid: DataFrame, lags: Sequence[int], *, by: Sequence[str], window: str, ts: str,
                 step: int, chunk: int, min_points: int = 20) -> DataFrame:
    """Uncentred correlation of x with y shifted by each lag, pooled over windows.

    Windows with fewer than ``min_points`` pairs at a lag do not count at that lag.
    """
    rows = lagged_pairs(grid, lags, by=by, ts=ts, step=step, chunk=chunk)
    aggs = []
    for i in range(len(lags)):
        x, y = F.col("x"), F.col(f"_y{i}")
        both = x.isNotNull() & y.isNotNull()
        aggs += [F.sum(F.when(both, x * y)).alias(f"_xy{i}"),
                 F.sum(F.when(both, x * x)).alias(f"_xx{i}"),
                 F.sum(F.when(both, y * y)).alias(f"_yy{i}"),
                 F.count(F.when(both, 1)).alias(f"_n{i}")]
    sums = rows.groupBy(*dict.fromkeys([*by, window])).agg(*aggs)
    long = sums.select(*by, F.explode(F.array(*[F.struct(
        F.lit(lag).alias("lag"), F.col(f"_xy{i}").alias("xy"), F.col(f"_xx{i}").alias("xx"),
        F.col(f"_yy{i}").alias("yy"), F.col(f"_n{i}").alias("n")) for i, lag in enumerate(lags)]))
        .alias("_l")).select(*by, "_l.*")
    group = [b for b in by if b != window]
    pooled = long.filter(F.col("n") >= min_points).groupBy(*group, "lag").agg(
        F.sum("xy").alias("_xy"), (F.sum("xx") * F.sum("yy")).alias("_d"), F.sum("n").alias("n"))
    return pooled.filter("_d > 0").select(
        *group, "lag", "n", (F.col("_xy") / F.sqrt("_d")).alias("corr"))


def centred_xcorr(grid: DataFrame, lags: Sequence[int], *, by: Sequence[str], ts: str, step: int,
                  chunk: int) -> DataFrame:
    """Pearson correlation of x with y at each lag, per key."""
    rows = lagged_pairs(grid, lags, by=by, ts=ts, step=step, chunk=chunk)
    wide = rows.groupBy(*by).agg(*[F.corr("x", f"_y{i}").alias(f"_c{i}")
                                   for i in range(len(lags))])
    pairs = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"_c{i}").alias("corr"))
                      for i, lag in enumerate(lags)])
    return wide.select(*by, F.explode(pairs).alias("_l")).select(*by, "_l.*").filter(
        F.col("corr").isNotNull() & ~F.isnan("corr"))


def peak(xcorr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lag with the highest correlation per source, earliest on a tie; most leading first."""
    best = xcorr.groupBy(*by).agg(F.max_by(F.struct("lag", "corr"), F.struct(
        F.col("corr"), -F.col("lag"))).alias("_b")).select(*by, "_b.*")
    return best.orderBy("lag", *by)


# ── probes, feeds, small regressions ─────────────────────────────────────────

def chase_curve(chase: DataFrame, pnl: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Fill rate and result for each chase allowance: fills need a drift within it."""
    rows = chase.join(pnl.select("trade_id", "pnl_net"), "trade_id", "left")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(levels):
        hit = F.col("drift_c") <= c + 1e-9
        aggs += [F.count(F.when(hit, 1)).alias(f"_f{i}"),
                 F.coalesce(F.sum(F.when(hit, F.col("pnl_net"))), F.lit(0.0)).alias(f"_p{i}"),
                 F.avg(F.when(hit, F.col("drift_c"))).alias(f"_d{i}")]
    wide = rows.agg(*aggs)
    long = wide.select("_n", F.explode(F.array(*[F.struct(
        F.lit(float(c)).alias("chase_c"), F.col(f"_f{i}").alias("fills"),
        F.col(f"_p{i}").alias("total"), F.col(f"_d{i}").alias("drift"))
        for i, c in enumerate(levels)])).alias("_c")).select("_n", "_c.*")
    return long.select(
        "chase_c", "fills", (F.col("fills") / F.col("_n")).alias("fill_rate"), "total",
        S.ratio(F.col("total"), F.col("fills")).alias("pnl_fill"),
        (F.col("total") / F.col("_n")).alias("pnl_signal"), "drift")


def hold_curve(probes: DataFrame) -> DataFrame:
    """Return by holding time; the one with the best mean is marked."""
    out = probes.groupBy("hold_ms").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gross_c").alias("gross_c"),
        F.avg("net_c").alias("net_c"), F.avg("exit").alias("exit"))
    med = S.quantiles(probes, F.col("net_c"), {"net_median_c": 0.5}, by=["hold_ms"])
    best = out.agg(F.max_by("hold_ms", F.struct(F.col("net_c"), -F.col("hold_ms"))).alias("_b"))
    return out.join(med, "hold_ms").withColumn("best", F.col("hold_ms") == best.scalar())


def maker_mix(probes: DataFrame) -> DataFrame:
    total = probes.agg(F.count(F.lit(1)).alias("_all"))
    out = probes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"),
                                        F.avg("gain_c").alias("gain_c"))
    return C.attach_row(out, total).select(
        "outcome", "n", (F.col("n") / F.col("_all")).alias("share"), "gain_c")


def feed_quality(ticks: DataFrame, *, by: Sequence[str], recv: str, exch: str,
                 order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Inter-update time and receive latency: median, p99, mean and population deviation."""
    rows = C.previous(ticks, {recv: "_p"}, by=by, ts=recv, order=order, chunk=chunk)
    rows = rows.withColumn("gap", F.col(recv) - F.col("_p")).withColumn(
        "latency", F.col(recv) - F.col(exch))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("gap_mean"),
        F.avg("latency").alias("latency_mean"), F.stddev_pop("latency").alias("jitter"))
    for c in ("gap", "latency"):
        q = S.quantiles(rows, F.col(c), {f"{c}_p50": 0.5, f"{c}_p99": 0.99}, by=by)
        out = out.join(q, list(by))
    return out


def spread_stats(book: DataFrame, by: str = "instrument") -> DataFrame:
    rows = book.withColumn("spread", F.col("ask") - F.col("bid"))
    mid = (F.col("ask") + F.col("bid")) / 2
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("spread").alias("mean"), F.min("spread").alias("min"),
        F.avg(F.try_divide(F.col("spread"), mid) * 1e4).alias("bps"))
    med = S.quantiles(rows, F.col("spread"), {"median": 0.5}, by=[by])
    return out.join(med, by)


def reaction_by_move(moves: DataFrame, changes: DataFrame, edges: Sequence[float], *,
                     chunk: int, min_rows: int = 6) -> DataFrame:
    """Time from each reference sample to the next target change, by size of the move."""
    rows = asof_join(moves, changes, direction="forward", strict=True, take={}, chunk=chunk,
                     match_ts="_next").filter(F.col("_next").isNotNull())
    rows = rows.withColumn("react", F.col("_next") - F.col("ts")).withColumn(
        "bucket", B.edge_bucket(F.col("move"), edges)).filter(F.col("bucket").isNotNull())
    out = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("react").alias("mean"))
    med = S.quantiles(rows, F.col("react"), {"median": 0.5}, by=["bucket"])
    return out.filter(F.col("n") >= min_rows).join(med, "bucket")


def atm_slope(ladder: DataFrame, *, event: str = "event") -> DataFrame:
    """Median slope of P over strike across the money, over adjacent strikes of all events."""
    w = Window.partitionBy(event).orderBy("strike")  # the strikes of one event
    rows = ladder.withColumn("_k", F.lead("strike").over(w)).withColumn("_p", F.lead("p").over(w))
    near = rows.filter((F.col("p") >= 0.4) & (F.col("_p") <= 0.6) & (F.col("_k") > F.col("strike")))
    slope = F.abs(F.col("_p") - F.col("p")) / (F.col("_k") - F.col("strike"))
    return S.quantiles(near, slope, {"slope": 0.5}, by=[])


def gap_slope(rows: DataFrame, by: Sequence[str] = (), big: float = 0.05) -> DataFrame:
    """Slope of the later move on the gap, and mean capture where the gap is large."""
    large = F.abs("gap") > big
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("move", "gap").alias("slope"),
        F.count(F.when(large, 1)).alias("n_big"),
        F.avg(F.when(large, F.signum("gap") * F.col("move"))).alias("capture"))


def heartbeat(events: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Messages per venue and interval; works on tables and on streams."""
    return events.groupBy(F.window("at", every).alias("_w"), "venue").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), "venue", "n")
