"""Strategy tables: episodes, entries, exits, fills, ledger and audits over recorded tables."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import instruments as I
from tickloom.functions import ladders as L
from tickloom.functions import prices as P
from tickloom.operators import chunks as C
from tickloom.operators import folds
from tickloom.operators.asof import asof_join
from tickloom.operators.grid import run_length
from tickloom.operators.passage import first_passage
from tickloom.schema import struct_of
from tickloom.session import materialize

EPS = 1e-6
MAX_ENTRY = 0.99  # fixed value: asks from here on are not bought
WHOLE_KEY = 50_000  # fills of an instrument that one task walks from end to end


def latency_book(rows: DataFrame, *, latency: int, slack: int, chunk: int, by: str = "ticker",
                 ts: str = "ts") -> DataFrame:
    """Quotes an order meets: the first row at or after ``ts + latency``.

    Where that row comes too late (more than ``slack`` past the latency) or is missing,
    the signal row's own quotes stand.
    """
    quotes = rows.select(by, ts, "ybid", "yask")
    out = asof_join(rows, quotes, by=[by], ts=ts, at=F.col(ts) + latency, direction="forward",
                    tol=slack, take={"ybid": "_b", "yask": "_a"}, chunk=chunk)
    return (out.withColumn("fill_bid", F.coalesce("_b", "ybid"))
            .withColumn("fill_ask", F.coalesce("_a", "yask")).drop("_b", "_a"))


# ── episodes and gates ───────────────────────────────────────────────────────

def with_lookback(rows: DataFrame, columns: Sequence[str], *, second: int, chunk: int,
                  by: str = "ticker", ts: str = "ts", youngest: float = 1.0,
                  oldest: float = 10.0) -> DataFrame:
    """Columns of the youngest row between ``youngest`` and ``oldest`` seconds ago, as then_*."""
    past = rows.select(by, ts, *columns)
    lo, hi = int(youngest * second), int(oldest * second)
    return asof_join(rows, past, by=[by], ts=ts, at=F.col(ts) - lo, tol=hi - lo,
                     take={c: f"then_{c}" for c in columns}, chunk=chunk)


def gap_crossings(rows: DataFrame, delta: float, *, rearm: float, sig: str = "gap",
                  by: Sequence[str] = ("ticker",), ts: str = "ts", order: Sequence[str] = ("seq",),
                  tte_min: float | None = None, cap: int = 0, chunk: int) -> DataFrame:
    """One row per episode: the crossing that disarms, with the time of the one before.

    ``cap`` counts crossings, not fills, so gates applied later do not free a slot.
    """
    hits = materialize(folds.hysteresis(rows, sig, enter=delta, leave=rearm, by=by, ts=ts,
                                        order=order, chunk=chunk), "crossings")
    if tte_min is not None:
        hits = hits.filter(F.col("tte_s") > tte_min)
    hits = C.previous(hits, {ts: "prev_cross"}, by=by, ts=ts, order=order, chunk=chunk)
    if cap:
        hits = C.running_sum(hits, F.lit(1), "_k", by=by, ts=ts, order=order, chunk=chunk)
        hits = hits.filter(F.col("_k") <= cap).drop("_k")
    hits = hits.withColumn("delta", F.lit(delta)).withColumn(
        "side_yes", (F.col(sig) > 0).cast("int"))
    return materialize(hits, "crossings")


def move_crossings(rows: DataFrame, delta: float, *, dominance: float = 2.0, rearm: float = 0.5,
                   by: Sequence[str] = ("ticker",), ts: str = "ts",
                   order: Sequence[str] = ("seq",), tte_min: float | None = None,
                   chunk: int) -> DataFrame:
    """Episodes of the fair moving without the market: |dfair| >= delta and >= k |dmid|.

    Disarms on a hit, re-arms once |dfair| <= delta * rearm. ``dfair`` and ``dmid`` are the
    one-second moves; a missing move counts as none.
    """
    size = F.abs(F.coalesce("dfair", F.lit(0.0)))
    hit = (size >= delta) & F.col("dmid").isNotNull() & (size >= dominance * F.abs("dmid"))
    out = folds.first_per_island(rows, size <= delta * rearm, hit, by=by, ts=ts, order=order,
                                 chunk=chunk)
    if tte_min is not None:
        out = out.filter(F.col("tte_s") > tte_min)
    return out.withColumn("delta", F.lit(delta)).withColumn(
        "side_yes", (F.col("dfair") > 0).cast("int"))


def ride_terms(rows: DataFrame, *, open_min: float | None = None, share_min: float = 0.75):
    """push, pull and share of the last second's move, and whether the gap was opened by the model.

    ``open_min`` defaults to the row's threshold.
    """
    s = F.when(F.col("side_yes") == 1, 1.0).otherwise(-1.0)
    push, pull = s * F.col("dfair"), -s * F.col("dmid")
    total = push + pull
    share = push / F.when(total != 0, total)
    least = F.lit(open_min) if open_min is not None else F.col("delta")
    ride = F.coalesce((total > least) & (share > share_min), F.lit(False))
    return (rows.withColumn("push", push).withColumn("pull", pull).withColumn("ride_share", share)
            .withColumn("is_ride", ride))


def gate(kind: str, *, overreact_k: float = 2.0, flip: float = 0.01) -> Column:
    """Entry gate on ride terms: ride, fade, none or overreact."""
    if kind == "none":
        return F.lit(True)
    if kind == "ride":
        return F.col("is_ride")
    if kind == "fade":
        return ~F.col("is_ride")
    if kind == "overreact":
        s = F.when(F.col("side_yes") == 1, 1.0).otherwise(-1.0)
        before = F.col("gap") - F.col("dfair") + F.col("dmid")
        return F.coalesce(
            (F.col("dfair") * F.col("dmid") > 0)
            & (F.abs("dmid") >= overreact_k * F.abs("dfair")) & (s * before <= -flip),
            F.lit(False))
    raise ValueError(f"unknown gate {kind}")


def veto(*, stale_ms: float = 0, cooldown: int = 0, ts: str = "ts") -> Column:
    """Why a passing crossing is not traded: a stale second price, or too soon after another."""
    none = F.lit(None).cast("string")
    stale = F.when(F.col("cb_age_ms") > stale_ms, "stale") if stale_ms > 0 else none
    soon = F.when(F.col(ts) - F.col("prev_cross") < cooldown, "cooldown") if cooldown else none
    return F.coalesce(stale, soon)


def entries(hits: DataFrame, *, chase: float | None = None) -> DataFrame:
    """Entry price, cost with fee, and ``status``: filled, missed or skipped.

    Without ``chase`` the signal row's own ask is paid. With it the post-latency ask is,
    unless it ran more than the allowance above the signal ask (a miss).
    """
    yes = F.col("side_yes") == 1
    ask = F.when(yes, F.col("yask")).otherwise(1.0 - F.col("ybid"))
    late = F.when(yes, F.col("fill_ask")).otherwise(1.0 - F.col("fill_bid")) if (
        chase is not None) else ask
    missed = late > ask + (chase or 0.0) + 1e-9
    status = F.when(missed, "missed").when(late >= MAX_ENTRY, "skipped").otherwise("filled")
    return (hits.withColumn("status", status).withColumn("entry", late)
            .withColumn("slip", late - ask).withColumn("cost", late + P.fee(late)))


def settle_result(filled: DataFrame, outcome: str = "outc") -> DataFrame:
    """Hold to settlement: won, net of cost."""
    won = F.when(F.col("side_yes") == 1, F.col(outcome) == 1).otherwise(F.col(outcome) == 0)
    return filled.withColumn("won", won.cast("int")).withColumn(
        "net", won.cast("int") - F.col("cost"))


def closure_point(hits: DataFrame, rows: DataFrame, *, eps: float, cap: int | None = None,
                  by: str = "ticker", ts: str = "ts", chunk: int) -> DataFrame:
    """Moves from entry to the first later row with |gap| < eps, and at min(closure, cap)."""
    closed = rows.filter(F.abs("gap") < eps).select(by, ts, "fair", "mid")
    out = asof_join(hits, closed, by=[by], ts=ts, direction="forward", strict=True,
                    take={"fair": "_cf", "mid": "_cm"}, match_ts="close_ts", chunk=chunk)
    out = out.withColumn("close_dfair", F.col("_cf") - F.col("fair")).withColumn(
        "close_dmid", F.col("_cm") - F.col("mid"))
    if cap is not None:
        at = F.least(F.col(ts) + cap, F.coalesce("close_ts", F.lit(1 << 62)))
        out = asof_join(out, rows.select(by, ts, "fair", "mid"), by=[by], ts=ts, at=at,
                        take={"fair": "_kf", "mid": "_km"}, match_ts="_kt", chunk=chunk)
        later = F.col("_kt") > F.col(ts)
        out = out.withColumn("cap_dfair", F.when(later, F.col("_kf") - F.col("fair"))).withColumn(
            "cap_dmid", F.when(later, F.col("_km") - F.col("mid")))
        out = out.withColumn("cap_s", F.when(later, F.col("_kt") - F.col(ts))).drop(
            "_kf", "_km", "_kt")
    return out.drop("_cf", "_cm")


def persistent(rows: DataFrame, delta: float, n: int, *, by: Sequence[str] = ("ticker",),
               ts: str = "ts", order: Sequence[str] = ("seq",), chunk: int) -> DataFrame:
    """Marks rows on which |gap| has held the threshold for at least ``n`` rows."""
    out = run_length(rows, F.abs("gap") >= delta, "_run", by=by, ts=ts, order=order, chunk=chunk)
    return out.withColumn("held", F.col("_run") >= n).drop("_run")


REVERT = ("delta DOUBLE, ts BIGINT, seq BIGINT, side_yes INT, entry DOUBLE, gap DOUBLE, won INT, exit_ts BIGINT, "
          "hold BIGINT, ret_taker DOUBLE, ret_maker DOUBLE, how STRING")


def revert_trades(rows: DataFrame, deltas: Sequence[float], *, eps: float, horizon: int, persist: int = 1,
                  cap: int | None = None, min_tte: float | None = None, chunk: int | None = None,
                  keep: Sequence[str] = (), by: str = "ticker", ts: str = "ts", outcome: str = "outc") -> DataFrame:
    """Enter once |gap| >= delta has held ``persist`` rows, leave when it closes to eps or after
    ``horizon``, else settle.

    An entry disarms; a row within eps arms again, a revert exit does so by itself. Asks too dear
    to buy use up the episode. Entries stop at the first one wanted with ``min_tte`` or less to go,
    and after ``cap`` of them (dear ones count). ``gap`` is its size at entry; ``keep`` names
    columns of the entry row to carry along. An unknown outcome has no settlement return.

    A chunk hands on, per delta, whether the rule is armed (with the rows its run has lasted),
    waits, or holds (with the entry). The rule forgets at every crossing back to eps, so chunks
    are read from guesses until these are right (``converge``). ``chunk`` None: a key is one chunk.
    """
    length = chunk if chunk is not None else 1 << 60
    slim = materialize(C.with_chunk(rows.select(
        by, ts, "seq", "gap", "ybid", "yask", F.coalesce(F.col(outcome).cast("int"), F.lit(-1)).alias("won")),
        ts, length), "scored")
    fields = struct_of(REVERT).names

    def fee(p):
        return P.TAKER_RATE * p * (1 - p)

    def run(key, d, opening, before, last):
        t, gap, bid, ask = d[ts].tolist(), np.abs(d["gap"]), d["ybid"], d["yask"]
        n = len(t)
        flats = np.flatnonzero(gap <= eps)
        states, out = [], []

        def closed(delta, held, j, how):
            """One finished trade; ``j`` is its exit row here, None at settlement."""
            at, seq, yes, entry, size, won = held
            cost = entry + fee(entry)
            if j is None:
                ret = (float(won == yes) - cost if won >= 0 else None,) * 2
            else:
                sell, rest = (bid[j], ask[j]) if yes else (1 - ask[j], 1 - bid[j])
                ret = (sell - fee(sell) - cost, rest - cost)
            out.append((delta, at, seq, yes, entry, size, won if won >= 0 else None, None if j is None else t[j],
                        None if j is None else t[j] - at, *ret, how))

        for delta, (mode, lasted, held) in zip(deltas, json.loads(opening)):
            narrow = np.append(np.flatnonzero(~(gap >= delta)), n)
            edges = np.append(-1, narrow)
            stretches = edges[:-1][np.diff(edges) > persist] + 1  # wide long enough
            k = 0
            while k < n:
                if mode == "waits":
                    i = np.searchsorted(flats, k)
                    if i == len(flats):
                        break
                    k, mode, lasted = int(flats[i]) + 1, "armed", 0
                elif mode == "armed":
                    stop = int(narrow[np.searchsorted(narrow, k)])
                    if stop - k + lasted >= persist:
                        k += persist - lasted - 1
                    else:
                        i = np.searchsorted(stretches, stop)
                        if i == len(stretches):
                            lasted = n - 1 - int(narrow[-2]) if len(narrow) > 1 and narrow[-2] >= k else lasted + n - k
                            break
                        k = int(stretches[i]) + persist - 1
                    yes = int(d["gap"][k] > 0)
                    entry = float(ask[k] if yes else 1 - bid[k])
                    held = [t[k], int(d["seq"][k]), yes, entry, float(gap[k]), int(d["won"][k])]
                    mode = "holds"
                    if not entry < MAX_ENTRY:
                        if last is not None:
                            closed(delta, held, k, "skipped")
                        mode = "waits"
                    k, lasted = k + 1, 0
                else:
                    i = np.searchsorted(flats, k)
                    late = int(np.searchsorted(d[ts], held[0] + horizon, side="left"))
                    j = min(int(flats[i]) if i < len(flats) else n, max(late, k))
                    if j >= n:
                        break
                    mode, lasted = ("armed", 0) if gap[j] <= eps else ("waits", 0)
                    if last is not None:
                        closed(delta, held, j, "revert" if gap[j] <= eps else "horizon")
                    k = j + 1
            if last and mode == "holds":
                closed(delta, held, None, "settle")
            states.append([mode, min(lasted, persist) if mode == "armed" else 0, held if mode == "holds" else None])
        if last is None or not out:
            return json.dumps(states), None
        res = {f: list(v) for f, v in zip(fields, zip(*out))}
        res[by] = [key[0]] * len(out)
        for name in ("won", "exit_ts", "hold", "ret_taker", "ret_maker"):
            res[name] = np.array(res[name], dtype=object)
        return json.dumps(states), res

    start = json.dumps([["armed", 0, None] for _ in deltas])
    trades = folds.converge(slim, by=[by], order=[ts, "seq"], start=start, run=run,
                            schema=struct_of(REVERT, rows.schema[by]))
    if keep or min_tte is not None:
        named = [*keep, *(["tte_s"] if min_tte is not None and "tte_s" not in keep else [])]
        trades = trades.join(rows.select(by, ts, "seq", *named), [by, ts, "seq"])
    if min_tte is not None:
        trades = trades.filter(F.col("tte_s") > min_tte)
        trades = trades if "tte_s" in keep else trades.drop("tte_s")
    if cap is not None:
        trades = C.running_sum(materialize(trades, "trades"), F.lit(1), "_entries", by=[by, "delta"], ts=ts, order=["seq"],
                               chunk=length).filter(F.col("_entries") <= cap).drop("_entries")
    return trades.filter("how <> 'skipped'")


def maker_entries(hits: DataFrame, rows: DataFrame, *, rest: int | None, chunk: int, by: str = "ticker",
                  ts: str = "ts", order: str = "seq") -> DataFrame:
    """Resting bids at our side's best: filled if the opposing ask crosses down within ``rest``.

    ``rest=None`` rests to settlement. Fee-free; the first crossing row decides, found as the first
    passage of our side's ask, turned upside down, through the limit.
    """
    yes = F.col("side_yes") == 1
    bid = F.when(yes, F.col("ybid")).otherwise(1.0 - F.col("yask"))
    live = hits.withColumn("limit", bid).filter(F.col("limit") > 0.005)
    asks = rows.select(by, ts, F.explode(F.array(
        F.struct(F.lit(1).alias("side_yes"), F.col("yask").alias("_ask")),
        F.struct(F.lit(0).alias("side_yes"), (1.0 - F.col("ybid")).alias("_ask")))).alias("_x")).select(by, ts, "_x.*")
    out = first_passage(live.withColumn("side_yes", F.col("side_yes").cast("int")), asks, value=-F.col("_ask"),
                        level=-(F.col("limit") + 1e-9), by=[by, "side_yes"], ident=[order, "delta"], chunk=chunk, ts=ts,
                        rest=rest, out="fill_ts")
    return out.withColumn("filled", F.col("fill_ts").isNotNull())


# ── legs and trades ──────────────────────────────────────────────────────────

def leg_summary(fills: DataFrame, by: Sequence[str]) -> DataFrame:
    qty = F.sum("qty")
    return fills.groupBy(*by).agg(
        qty.alias("qty"), F.when(qty > 0, F.sum(F.col("qty") * F.col("px")) / F.when(qty > 0, qty))
        .otherwise(0.0).alias("vwap"), F.sum("fee").alias("fees"),
        F.count(F.lit(1)).alias("n_fills"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))


def trade_record(plans: DataFrame, entry: DataFrame, exit_: DataFrame, *, unit_ms: int) -> DataFrame:
    """Round trips from leg summaries: results, slippage in cents, holding and latency."""
    names = ("qty", "vwap", "fees", "n_fills", "first_ts", "last_ts")
    legs = [leg.select("trade_id", *[F.col(c).alias(f"{p}_{c}") for c in names])
            for p, leg in (("entry", entry), ("exit", exit_))]
    rows = plans.join(legs[0], "trade_id").join(legs[1], "trade_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    x = zero("exit_qty") * zero("exit_vwap")
    e = F.col("entry_qty") * F.col("entry_vwap")
    hold = F.greatest(F.coalesce("exit_last_ts", "entry_first_ts"), F.col("entry_first_ts"))
    open_qty = F.col("entry_qty") - zero("exit_qty")
    return (rows.withColumn("pnl_gross", x - e)
            .withColumn("pnl_net", x - zero("exit_fees") - e - F.col("entry_fees"))
            .withColumn("slippage_entry_c", (F.col("entry_vwap") - F.col("signal_ask")) * 100)
            .withColumn("slippage_exit_c", F.when(zero("exit_qty") > 0, (
                F.col("exit_ref_bid") - F.col("exit_vwap")) * 100).otherwise(0.0))
            .withColumn("hold_ms", F.floor((hold - F.col("entry_first_ts")) / unit_ms))
            .withColumn("lat_signal_ms", F.greatest(F.col("entry_first_ts") - F.col("signal_ts"),
                                                    F.lit(0)) / unit_ms)
            .withColumn("outcome", F.when(open_qty <= EPS, "Closed")
                        .otherwise("PendingResolution")))


# ── position ledger ──────────────────────────────────────────────────────────

def effective_fills(reports: DataFrame) -> DataFrame:
    """Fill reports to signed ledger entries, in order: apply once, undo on failure.

    A first Matched or Confirmed applies the fill; a Failed after an applied one reverses
    it; replays, late confirmations and failures of unapplied fills change nothing. An id
    has a handful of reports.
    """
    w = Window.partitionBy("venue_trade_id").orderBy("ts", "seq")
    good = F.col("status").isin("Matched", "Confirmed")
    rows = reports.withColumn("_good", good).withColumn("_was", F.lag("_good").over(w))
    apply_ = F.col("_good") & ~F.coalesce("_was", F.lit(False))
    undo = ~F.col("_good") & F.coalesce("_was", F.lit(False))
    sign = F.when(apply_, 1.0).when(undo, -1.0)
    return rows.withColumn("sign", sign).filter(F.col("sign").isNotNull()).drop("_good", "_was")


def _accepted(qty: float, step: float) -> bool:
    """May the position move by ``step``? Long only, up to rounding."""
    return round(qty + step, 6) >= -EPS


def position_ledger(fills: DataFrame, *, chunk: int, by: str = "instrument", ts: str = "ts",
                    order: str = "seq") -> DataFrame:
    """Average-cost position after every fill, for any number of fills per instrument.

    A fill that would sell more than is held (or undo more than was bought) is refused and
    flagged; it moves nothing, the next one is judged by itself, and a refused fill has
    nothing to undo later. A flat position keeps its last average cost, so a closing sell can
    be undone.

    An instrument of at most ``WHOLE_KEY`` fills is walked once, in order; many of them share a task.
    Only busier ones are cut into chunks.

    A chunk read from one opening quantity tells what it does to all quantities around it: up to
    the first sell that would be judged otherwise, it shifts them all alike. So a reading is three
    numbers (closing quantity, and how far the opening one may differ); chained, they give every
    chunk's opening, and only chunks that open outside their range are read again (``openings``).
    A refusal matters to another chunk only where that one undoes the same fill; refused fills
    that are undone elsewhere are found by a pass over their chunks, joined to the undoing rows,
    and the quantities are settled again until no more come up.

    Each counted buy then maps the average cost to ``a * cost + b`` and what a sell realises is
    linear in it: chunks are reduced to these numbers, chained, and each finished from the state
    it opens with.
    """
    named = "venue_trade_id" in fills.columns and "sign" in fills.columns
    signed = F.col("sign") if "sign" in fills.columns else F.lit(1.0)
    buy = F.col("side") == "Buy"
    slim = fills.select(
        by, ts, order, C.chunk_start(F.col(ts), chunk).alias(C.CHUNK), buy.alias("buy"),
        (signed * F.col("qty")).alias("q"), (signed * F.col("qty") * F.col("px")).alias("value"),
        (signed * F.col("fee")).alias("fee"), (signed < 0).alias("undo"),
        (F.col("venue_trade_id") if named else F.lit("")).alias("fill"))
    slim = materialize(slim.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()), "ledger")
    double = T.DoubleType()
    schema = T.StructType([fills.schema[by], T.StructField(ts, T.LongType()), fills.schema[order], *[
        T.StructField(n, double) for n in ("qty_after", "avg_cost", "realized", "fees_paid", "cash")],
        T.StructField("violation", T.BooleanType())])

    def walk_whole(batches):
        """Rows of whole instruments, one after the other; what is held never exceeds one state."""
        current = object()
        for pdf in batches:
            out = []
            for key, is_buy, q, value, fee, undo, fill in zip(*[
                    pdf[n].tolist() for n in (by, "buy", "q", "value", "fee", "undo", "fill")]):
                if key != current:
                    current, refused = key, set()
                    qty = cost = gain = fees = money = 0.0
                step = q if is_buy else -q
                skip = undo and fill in refused
                bad = not skip and not _accepted(qty, step)
                if bad and named and not undo:
                    refused.add(fill)
                if not skip and not bad:
                    now = max(qty + step, 0.0)
                    fees += fee
                    if is_buy:
                        money -= value + fee
                        if now > EPS:
                            cost = (cost * qty + value + fee) / now
                    else:
                        gain, money = gain + value - fee - q * cost, money + value - fee
                    qty = now
                out.append((qty, cost, gain, fees, money, bad))
            if out:
                yield pd.DataFrame({by: pdf[by], ts: pdf[ts], order: pdf[order],
                                    **dict(zip(schema.names[3:], map(list, zip(*out))))})

    busy = materialize(slim.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > WHOLE_KEY).select(by), "busy")
    if busy.isEmpty():
        return folds.together(slim, [by]).sortWithinPartitions(by, ts, order).mapInPandas(walk_whole, schema)
    whole = folds.together(slim.join(busy, by, "left_anti"), [by]).sortWithinPartitions(by, ts, order).mapInPandas(
        walk_whole, schema)
    slim = slim.join(busy, by, "left_semi")
    if named:  # fills that one chunk applies and another one undoes
        same = Window.partitionBy(by, "fill")
        slim = slim.withColumn("apart", F.max("undo").over(same) & (F.min(C.CHUNK).over(same) != F.max(C.CHUNK).over(same)))
    slim = materialize(slim, "ledger")
    key_field, order_field = fills.schema[by], fills.schema[order]
    place = [by, C.CHUNK]

    def fields(kind, *extra):
        return T.StructType([key_field, T.StructField(C.CHUNK, T.LongType()),
                             *[T.StructField(n, kind) for n in extra]])

    def walk(d, qty):
        """Rows of a chunk with the quantity before and after each; refused ones say so."""
        q = d["q"].astype(float)
        steps = np.where(d["buy"], q, -q).tolist()
        refused = set()
        for step, is_buy, undo, void, fill in zip(steps, *[d[n].tolist() for n in ("buy", "undo", "void", "fill")]):
            skip = undo and named and (void or fill in refused)
            bad = not skip and not _accepted(qty, step)
            after = qty if skip or bad else max(qty + step, 0.0)
            if bad and not undo and named:
                refused.add(fill)
            yield is_buy, step, skip or bad, bad, qty, after
            qty = after

    def read(key, d, opening, before, last):
        qty, low, high = json.loads(opening), float("-inf"), float("inf")
        for _, step, skip, bad, was, qty in walk(d, qty):
            if bad:  # with so much more it would be accepted; half a unit of rounding away from that
                high = min(high, -(was + step) - 2 * EPS)
            elif not skip and step < 0:
                low = max(low, -(was + step))
                if was + step < 0:
                    high = min(high, 0.0)
        return json.dumps([qty, min(low, 0.0), max(high, 0.0)]), None

    def link(opened, closed):
        qty, out = 0.0, []
        for opening, closing in zip(opened, closed):
            after, low, high = json.loads(closing)
            shift = qty - json.loads(opening)
            out.append((json.dumps(qty), not low <= shift <= high))
            qty = max(after + shift, 0.0)
        return out

    def refusals(key, d):
        out = [(f, t, o) for (*_, bad, _, _), f, t, o, undo, apart in zip(
            walk(d, json.loads(d["_open"][0])), *[d[n].tolist() for n in ("fill", ts, order, "undo", "apart")])
            if bad and apart and not undo]
        if not out:
            return None
        return {by: [key[0]] * len(out), **dict(zip(("fill", ts, order), map(list, zip(*out))))}

    refused, kept = None, [by, "fill", "_since"]
    while True:
        rows = slim.withColumn("void", F.lit(False))
        if refused is not None:
            rows = materialize(slim.join(refused, [by, "fill"], "left").withColumn(
                "void", F.coalesce(F.col("undo") & (F.col("_since") < F.struct(ts, order)), F.lit(False))).drop("_since"), "ledger")
        quantities = materialize(folds.openings(rows, by=[by], order=[ts, order], start="0.0", run=read, link=link,
                                                hand=lambda closing: json.dumps(json.loads(closing)[0])), "opening")
        counted = rows.join(quantities, place)
        if not named:
            break
        found = folds.fold_groups(
            counted.join(slim.filter("apart").select(*place).distinct(), place, "left_semi"), place, [ts, order], refusals,
            T.StructType([key_field, slim.schema["fill"], T.StructField(ts, T.LongType()), order_field]))
        found = materialize(found.groupBy(by, "fill").agg(F.min(F.struct(ts, order)).alias("_since")), "refused")
        news = found if refused is None else found.select(kept).exceptAll(refused.select(kept)).unionByName(
            refused.select(kept).exceptAll(found.select(kept)))
        if news.isEmpty():
            break
        refused = found

    def entries(d):
        """Counted state changes with the money each row moves."""
        money = zip(*[d[n].tolist() for n in ("q", "value", "fee")])
        for row, (q, value, fee) in zip(walk(d, json.loads(d["_open"][0])), money):
            yield row, q, value, fee

    def reduce_cost(key, d):
        a, b, g0, g1, fees, money = 1.0, 0.0, 0.0, 0.0, 0.0, 0.0
        for (is_buy, _, skip, _, was, now), q, value, fee in entries(d):
            if skip:
                continue
            fees += fee
            if is_buy:
                money -= value + fee
                if now > EPS:
                    a, b = a * was / now, (b * was + value + fee) / now
            else:
                g0, g1, money = g0 + value - fee - q * b, g1 - q * a, money + value - fee
        return {by: [key[0]], C.CHUNK: [key[1]], "a": [a], "b": [b], "g0": [g0], "g1": [g1],
                "fees": [fees], "money": [money]}

    def chain_cost(key, d):
        cost = gain = fees = money = 0.0
        out = []
        for a, b, g0, g1, f, m in zip(*[d[n].tolist() for n in ("a", "b", "g0", "g1", "fees", "money")]):
            out.append((cost, gain, fees, money))
            gain, cost, fees, money = gain + g0 + g1 * cost, a * cost + b, fees + f, money + m
        cols = dict(zip(("o_cost", "o_gain", "o_fees", "o_money"), map(list, zip(*out))))
        return {by: [key[0]] * len(out), C.CHUNK: d[C.CHUNK], **cols}

    def finish(key, d):
        cost, gain, fees, money = (float(d[n][0]) for n in ("o_cost", "o_gain", "o_fees", "o_money"))
        out = []
        for (is_buy, _, skip, bad, was, now), q, value, fee in entries(d):
            if not skip:
                fees += fee
                if is_buy:
                    money -= value + fee
                    if now > EPS:
                        cost = (cost * was + value + fee) / now
                else:
                    gain, money = gain + value - fee - q * cost, money + value - fee
            out.append((now, cost, gain, fees, money, bad))
        cols = dict(zip(("qty_after", "avg_cost", "realized", "fees_paid", "cash", "violation"),
                        map(list, zip(*out))))
        return {by: [key[0]] * len(out), ts: d[ts], order: d[order], **cols}

    parts = folds.fold_groups(counted, place, [ts, order], reduce_cost,
                              fields(double, "a", "b", "g0", "g1", "fees", "money"))
    opening = folds.fold_groups(parts, [by], [C.CHUNK], chain_cost,
                                fields(double, "o_cost", "o_gain", "o_fees", "o_money"))
    return whole.unionByName(folds.fold_groups(counted.join(opening, place), place, [ts, order], finish, schema))


def settle_positions(positions: DataFrame, markets: DataFrame) -> DataFrame:
    """Resolved markets pay 1 per share of the winning outcome and 0 of the other."""
    keyed = positions.withColumn("market_id", I.market_id(F.col("instrument")))
    won = markets.select(I.market_id(F.col("winner")).alias("market_id"), "winner")
    rows = keyed.join(won, "market_id").filter(F.abs("qty") >= EPS)
    payout = (F.col("instrument") == F.col("winner")).cast("double")
    return rows.withColumn("payout", payout).withColumn(
        "settle_pnl", F.col("qty") * (payout - F.col("avg_cost"))).withColumn(
        "settle_cash", F.col("qty") * payout)


def join_market(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Market facts, keyed on the yes side in the catalog, joined to either outcome."""
    facts = meta.withColumn("market_id", I.market_id(F.col("instrument"))).drop("instrument")
    return rows.withColumn("market_id", I.market_id(F.col("instrument"))).join(
        facts, "market_id", "left")


def mark_positions(positions: DataFrame, tops: DataFrame, *, chunk: int) -> DataFrame:
    """Positions marked at the best bid in force, with unrealised profit."""
    out = asof_join(positions, tops, by=["instrument"], take={"bid": "mark"}, chunk=chunk)
    open_ = (F.col("qty") > 0) & F.col("mark").isNotNull()
    return out.withColumn("upnl", F.when(open_, F.col("qty") * (
        F.col("mark") - F.col("avg_cost"))).otherwise(0.0))


def daily_totals(ledger: DataFrame, fills: DataFrame, *, by: str = "instrument",
                 order: str = "seq", ts: str = "ts", chunk: int) -> DataFrame:
    """Realised result, fees and fills per UTC day over the account."""
    ledger = materialize(ledger.select(by, ts, order, "realized", "fees_paid", "cash"), "ledger")  # read twice below
    prev = C.previous(ledger, {"realized": "_r", "fees_paid": "_f", "cash": "_c"}, by=[by], ts=ts,
                      order=[order], chunk=chunk)
    d = lambda c, p: F.col(c) - F.coalesce(p, F.lit(0.0))
    rows = prev.select(F.date_format(F.timestamp_micros(ts), "yyyy-MM-dd").alias("date"),
                       d("realized", "_r").alias("r"), d("fees_paid", "_f").alias("f"),
                       d("cash", "_c").alias("c"))
    return rows.groupBy("date").agg(F.sum("r").alias("realized"), F.sum("f").alias("fees"),
                                    F.sum("c").alias("cash"), F.count(F.lit(1)).alias("n"))


# ── probes ───────────────────────────────────────────────────────────────────

def hold_returns(trades: DataFrame, books: DataFrame, offsets: dict[int, int], *, rate: float,
                 chunk: int) -> DataFrame:
    """Return of selling the held quantity into the recorded bids at each offset, in cents.

    ``offsets`` maps the label (ms) to ticks of the table's clock. Both legs pay the fee.
    """
    ladder = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(v).cast("long").alias("v"))
                                 for h, v in offsets.items()]))
    rows = trades.withColumn("_o", ladder)
    rows = asof_join(rows, books, by=["instrument"], at=F.col("ts") + F.col("_o.v"),
                     take={"bids": "_bids"}, tie="seq", chunk=chunk)
    rows = rows.withColumn("_x", L.sweep(F.col("_bids"), F.col("qty"), F.lit(0.0), "sell"))
    rows = rows.filter(F.col("_x.qty") > EPS)
    gross = F.col("_x.vwap") - F.col("entry")
    net = gross - P.fee(F.col("_x.vwap"), rate=rate) - P.fee(F.col("entry"), rate=rate)
    return rows.select(
        "trade_id", "instrument", F.col("_o.h").alias("hold_ms"), F.col("_x.qty").alias("filled"),
        F.col("_x.vwap").alias("exit"), (gross * 100).alias("gross_c"), (net * 100).alias("net_c"))


def price_path(signals: DataFrame, books: DataFrame, offsets: Sequence[int], *,
               chunk: int) -> DataFrame:
    """Quotes, depth and moves from the signal's references at each offset, filled or not."""
    rows = signals.withColumn("offset", F.explode(F.array(*[
        F.lit(o).cast("long") for o in offsets])))
    rows = asof_join(rows, books, by=["instrument"], at=F.col("ts") + F.col("offset"),
                     take={"bids": "_b", "asks": "_a"}, tie="seq", chunk=chunk)
    b, a = F.col("_b"), F.col("_a")
    mid = L.mid(b, a)
    return rows.filter(b.isNotNull()).select(
        "signal_id", "offset", L.best(b).alias("bid"), L.best(a).alias("ask"), mid.alias("mid"),
        ((mid - F.col("ref_mid")) * 100).alias("dmid_c"),
        ((L.best(a) - F.col("ref_ask")) * 100).alias("dask_c"),
        L.total_qty(b).alias("bid_depth"), F.size(b).alias("bid_levels"),
        L.total_qty(a).alias("ask_depth"), F.size(a).alias("ask_levels"))


def ask_move(signals: DataFrame, tops: DataFrame, *, pre: int, chunk: int) -> DataFrame:
    """Move of the ask over the look-back before the signal, in cents."""
    out = signals
    for name, at in (("_a1", F.col("ts")), ("_a0", F.col("ts") - pre)):
        out = asof_join(out, tops, by=["instrument"], at=at, take={"ask": name}, tie="seq",
                        chunk=chunk)
    return out.withColumn("pre_move_c", (F.col("_a1") - F.col("_a0")) * 100).drop("_a0", "_a1")


def maker_exit(exits: DataFrame, tops: DataFrame, *, rest: int, rate: float, chunk: int,
               ident: Sequence[str] = ("ts",)) -> DataFrame:
    """Shadow of a post-only sell at ``offer`` against crossing at the bid.

    Rejected when the bid is already there, filled at the offer when the bid reaches it
    within ``rest``, else crossed at the bid in force when the time is up. ``ident`` names columns
    that tell the exits of an instrument apart.
    """
    edge = F.col("offer") - 1e-9
    # bids at or above the offer: compare on whole cents, the tick of the venue
    cents = lambda c: F.ceil(F.round(c * 100, 6)).cast("long")
    rows = first_passage(exits, tops, value=F.col("bid") * 100, level=cents(F.col("offer")) - 1e-6, by=["instrument"],
                         ident=ident, chunk=chunk, rest=rest, out="_hit")
    rows = asof_join(rows, tops, by=["instrument"], at=F.col("ts") + rest, take={"bid": "_end"},
                     chunk=chunk)
    outcome = F.when(F.col("bid0") >= edge, "reject").when(
        F.col("_hit").isNotNull(), "maker_fill").otherwise("timeout")
    cross = F.when(outcome == "reject", F.col("bid0")).when(
        outcome == "maker_fill", F.col("offer")).otherwise(F.col("_end"))
    maker = F.when(outcome == "maker_fill", F.col("offer")).otherwise(
        cross - P.fee(cross, rate=rate))
    taker = F.col("bid0") - P.fee(F.col("bid0"), rate=rate)
    return rows.withColumn("outcome", outcome).withColumn("cross", cross).withColumn(
        "gain_c", (maker - taker) * 100).drop("_hit", "_end")


def expiry_cleanup(positions: DataFrame, tops: DataFrame, *, window: int, rate: float,
                   chunk: int) -> DataFrame:
    """Residuals sold at the bid in force ``window`` before expiry, never more than is held."""
    rows = positions.filter(F.col("qty") > EPS)
    rows = asof_join(rows, tops, by=["instrument"], at=F.col("expiry") - window,
                     take={"bid": "px"}, chunk=chunk).filter(F.col("px") > 0)
    sold = F.least(F.coalesce("wanted", "qty"), F.col("qty"))
    return rows.withColumn("sold", sold).withColumn("fee", P.fee(F.col("px"), sold, rate=rate))


def chase_entries(signals: DataFrame, books: DataFrame, *, chase: float, delays: Sequence[int],
                  rate: float, chunk: int) -> DataFrame:
    """Bounded entry attempts: each may pay up to its own ask plus ``chase``; first fill counts.

    Attempt i is sent against the book at ``delays[i]`` and meets the one at
    ``delays[i + 1]``; the drift in cents of the first attempt is kept for all signals.
    """
    tries = len(delays) - 1
    rows = signals.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    pick = lambda i: F.get(F.array(*[F.lit(d).cast("long") for d in delays]), i)
    for name, i in (("_seen", F.col("attempt")), ("_met", F.col("attempt") + 1)):
        rows = asof_join(rows, books, by=["instrument"], at=F.col("ts") + pick(i),
                         take={"asks": name}, tie="seq", chunk=chunk)
    cap = L.best(F.col("_seen")) + chase
    rows = rows.withColumn("_x", L.sweep(F.col("_met"), F.col("size"), cap, "buy"))
    px = F.when(F.col("_x.qty") > EPS, F.col("_x.vwap")).otherwise(L.best(F.col("_met")))
    drift = (px - F.col("signal_ask")) * 100
    keys = [c for c in signals.columns]
    out = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("attempt") == 0, drift)).alias("drift_c"),
        F.min_by(F.struct("attempt", "_x"), F.when(F.col("_x.qty") > EPS, F.col("attempt")))
        .alias("_f"))
    qty, vwap = F.col("_f._x.qty"), F.col("_f._x.vwap")
    return out.select(*keys, "drift_c", F.col("_f.attempt").alias("attempt"), qty.alias("qty"),
                      vwap.alias("vwap"), P.fee(vwap, qty, rate=rate).alias("fee"))


def translate_closes(closes: DataFrame) -> DataFrame:
    """Buys of the complement booked as fee-free sells of the held side at 1 - p."""
    return closes.select(
        F.concat_ws("-cl", "order_id", F.col("seq").cast("string")).alias("venue_trade_id"),
        "order_id", I.complement(F.col("instrument")).alias("instrument"),
        F.lit("Sell").alias("side"), "qty", P.close_price(F.col("px")).alias("px"),
        F.lit(0.0).alias("fee"), "ts", "seq")


# ── attribution and audits ───────────────────────────────────────────────────

def attribute_fills(fills: DataFrame, orders: DataFrame, signals: DataFrame) -> DataFrame:
    """Fill to order to trade to signal; the trade id heads the client id."""
    parts = F.split("client_id", ":")
    sent = orders.select("order_id", "client_id", F.get(parts, F.lit(0)).alias("trade_id"),
                         F.get(parts, F.lit(1)).alias("leg"),
                         F.get(parts, F.lit(2)).try_cast("int").alias("attempt"))
    return fills.join(sent, "order_id").join(signals, "trade_id", "left")


def lost_acks(fills: DataFrame, orders: DataFrame) -> DataFrame:
    return fills.join(orders, "order_id", "left_anti")


def audit_positions(ours: DataFrame, venue: DataFrame, eps: float = EPS) -> DataFrame:
    """Markets whose net quantity differs from the venue's, missing ones counting as zero."""
    both = ours.select("market_id", F.col("net").alias("ours")).join(
        venue.select("market_id", F.col("net").alias("venue")), "market_id", "full")
    gap = F.coalesce("ours", F.lit(0.0)) - F.coalesce("venue", F.lit(0.0))
    return both.withColumn("diff", gap).filter(F.abs("diff") > eps)


def conflicting_fills(reports: DataFrame) -> DataFrame:
    """Ids reported with more than one quantity or price."""
    return reports.groupBy("venue_trade_id").agg(
        F.min("qty").alias("min_qty"), F.max("qty").alias("max_qty"), F.min("px").alias("min_px"),
        F.max("px").alias("max_px")).filter(
        (F.col("min_qty") != F.col("max_qty")) | (F.col("min_px") != F.col("max_px")))


def signal_funnel(signals: DataFrame, rejects: DataFrame, attempts: DataFrame,
                  fills: DataFrame) -> DataFrame:
    """Each signal ends in one stage: rejected by a reason, attempted, filled or unexplained."""
    why = rejects.groupBy("trade_id").agg(F.min("reason").alias("reason"))
    tried = attempts.select("trade_id").distinct().withColumn("_t", F.lit(True))
    done = fills.select("trade_id").distinct().withColumn("_f", F.lit(True))
    rows = (signals.join(why, "trade_id", "left").join(tried, "trade_id", "left")
            .join(done, "trade_id", "left"))
    stage = F.when(F.col("_f"), "filled").when(F.col("_t"), "attempted").when(
        F.col("reason").isNotNull(), F.concat(F.lit("rejected: "), F.col("reason"))
    ).otherwise("unexplained")
    return rows.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def latency_of_signals(samples: DataFrame, signals: DataFrame) -> DataFrame:
    """Latency samples joined back to their signal by origin time, strategy and target."""
    keyed = signals.withColumnRenamed("ts_ns", "origin_ts_ns")
    return samples.join(keyed, ["origin_ts_ns", "strategy", "target"])


def rate_limited(signals: DataFrame, *, limit: int, span: int, by: Sequence[str],
                 ts: str = "ts", order: str = "seq", chunk: int) -> DataFrame:
    """Accepted flag under at most ``limit`` accepted signals per sliding ``span``.

    Only accepted ones count. What a chunk hands on is the times it accepted within ``span`` of
    its end; chunks are read from a guess of these until all guesses are right (``converge``),
    and a repeated reading stops where the window has become what it was before.
    """
    keys = list(by)
    rows = materialize(C.with_chunk(signals.select(*keys, ts, order), ts, chunk), "signals")

    def run(key, d, opening, before, last):
        kept = deque(json.loads(opening), maxlen=limit)
        shadow = deque(json.loads(before[0]), maxlen=limit) if before else None
        ok = np.zeros(len(d[ts]), dtype=bool)
        for i, t in enumerate(d[ts].tolist()):
            for window in (kept,) if shadow is None else (kept, shadow):
                while window and window[0] < t - span:
                    window.popleft()
            if kept == shadow:
                return before[1], None
            ok[i] = len(kept) < limit
            for window in (kept,) if shadow is None else (kept, shadow):
                if len(window) < limit:
                    window.append(t)
        closing = json.dumps([t for t in kept if t >= key[-1] + chunk - span])
        return closing, None if last is None else {
            **{k: [v] * len(ok) for k, v in zip(keys, key)}, order: d[order], "accepted": ok}

    schema = T.StructType([*[signals.schema[k] for k in keys], signals.schema[order],
                           T.StructField("accepted", T.BooleanType())])
    return folds.converge(rows, by=keys, order=[ts, order], start="[]", run=run, schema=schema)
