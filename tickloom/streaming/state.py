"""Stateful stream operators, each with the same result as its batch form.

State is keyed by instrument or event and bounded: a few values, or a ring as long as the
rule looks back. Rows of a micro-batch are put in time order before they are applied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.signals import conflate


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], ignore_index=True)


class Throttle(StatefulProcessor):
    """Keep a row when at least ``gap`` has passed since the last one kept of its key.

    Rows wait until the watermark has passed them and are then taken in time order, so files may
    come in any order within the watermark's delay. ``per_ms`` is the number of ticks of ``ts`` in a
    millisecond of event time. A key's state is its waiting rows and one time; it is let go
    ``ttl_ms`` after the last of its rows.
    """

    def __init__(self, gap: int, fields: str, per_ms: float = 1000, ttl_ms: int = 0):
        self.gap, self.fields, self.per_ms, self.ttl_ms = gap, fields, per_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts BIGINT")
        self.held = handle.getListState("held", self.fields)
        self.names = [f.split()[0] for f in self.fields.split(",")]

    def _due(self, ts: int) -> int:
        return int(-(-ts // self.per_ms))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        pdf = _ordered(rows)[self.names].astype(object)
        self.held.appendList([tuple(r) for r in pdf.itertuples(index=False)])
        self.handle.registerTimer(self._due(int(pdf["ts"].iloc[-1])))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        if not rows:
            self.last.clear()  # the farewell timer of a key without waiting rows
            return
        pdf = pd.DataFrame(rows, columns=self.names).sort_values(["ts", "seq"], ignore_index=True)
        ready = (pdf["ts"].map(self._due) <= now).to_numpy()
        times = pdf["ts"].to_numpy()[ready]
        last = self.last.get()[0] if self.last.exists() else None
        at = 0 if last is None else int(np.searchsorted(times, last + self.gap, side="left"))
        kept = []
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + self.gap, side="left"))
        waiting = [r for r in pdf[~ready].astype(object).itertuples(index=False, name=None)]
        if waiting:
            self.held.put(waiting)
        else:
            self.held.clear()
            if self.ttl_ms:
                self.handle.registerTimer(now + self.ttl_ms)
        if kept:
            self.last.update((int(times[kept[-1]]),))
            yield pdf.iloc[kept]

    def close(self) -> None:
        pass


class Episodes(StatefulProcessor):
    """Hysteresis crossings: fire at |sig| >= enter while armed, re-arm on sig * side <= leave."""

    def __init__(self, enter: float, leave: float, sig: str):
        self.enter, self.leave, self.sig = enter, leave, sig

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.side = handle.getValueState("side", "side INT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        pdf = _ordered(rows)
        side = self.side.get()[0] if self.side.exists() else 0
        fired = []
        for i, v in enumerate(pdf[self.sig].to_numpy()):
            if np.isnan(v):
                continue
            if side:
                if v * side <= self.leave:
                    side = 0
            elif abs(v) >= self.enter:
                side = 1 if v > 0 else -1
                fired.append(i)
        self.side.update((side,))
        if fired:
            yield pdf.iloc[fired]

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """Latest non-null value of each field per key, one row out per key and micro-batch.

    Every field keeps the (ts, seq) of its value, so a late row fills what it is newest for and
    nothing else. ``version`` counts a key's rows; ``current`` picks the last one of each key.
    """

    def __init__(self, fields: list[str], key: str):
        self.fields, self.key = fields, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        cols = ", ".join(f"{f} DOUBLE, {f}_ts BIGINT, {f}_seq BIGINT" for f in self.fields)
        self.now = handle.getValueState("now", f"version BIGINT, ts BIGINT, seq BIGINT, {cols}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        pdf = _ordered(rows)
        old = tuple(self.now.get()) if self.now.exists() else (0, None, None, *[None] * 3 * len(self.fields))
        newer = lambda at, was: was[0] is None or at >= was
        at = int(pdf["ts"].iloc[-1]), int(pdf["seq"].iloc[-1])
        state = [old[0] + 1, *(at if newer(at, old[1:3]) else old[1:3])]
        for i, f in enumerate(self.fields):
            value, *was = old[3 + 3 * i:6 + 3 * i]
            seen = pdf[pdf[f].notna()]
            if len(seen):
                last = seen.iloc[-1]
                at = int(last["ts"]), int(last["seq"])
                if newer(at, tuple(was)):
                    value, was = float(last[f]), at
            state += [value, *was]
        self.now.update(tuple(state))
        yield pd.DataFrame([[key[0], state[0], *state[1:3], *state[3::3]]],
                           columns=[self.key, "version", "ts", "seq", *self.fields])

    def close(self) -> None:
        pass


def current(rows: DataFrame, key: str) -> DataFrame:
    """The last version of every key of a ``Latest`` output."""
    names = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("now")).select(key, "now.*")


class Moves(StatefulProcessor):
    """Reference-move signals: rows of the reference, target quotes and lifecycle together.

    ``kind`` is ref, quote or meta; the state is a ring of mid changes one window long, the
    linked target with its quote and expiry, and the time of the last signal.
    """

    def __init__(self, window: int, threshold_bps: float, band: tuple[float, float], min_tte: int,
                 cooldown: int):
        self.window, self.bps, self.band = window, threshold_bps, band
        self.min_tte, self.cooldown = min_tte, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ts BIGINT, mid DOUBLE")
        self.quotes = handle.getMapState("quotes", "instrument STRING", "mid DOUBLE")
        self.link = handle.getValueState("link", "instrument STRING, expiry BIGINT")
        self.last = handle.getValueState("last", "ts BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        pdf = _ordered(rows)
        ring = [(r[0], r[1]) for r in self.ring.get()] if self.ring.exists() else []
        link = tuple(self.link.get()) if self.link.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        quotes: dict[str, float] = {}
        out = []

        def quote(name):
            if name not in quotes and self.quotes.containsKey((name,)):
                quotes[name] = self.quotes.getValue((name,))[0]
            return quotes.get(name)

        for r in pdf.itertuples(index=False):
            if r.kind == "quote":
                quotes[r.instrument] = float(r.mid)
            elif r.kind == "meta":
                if r.status == "Live":
                    link = (r.instrument, int(r.expiry))
                elif r.status in ("Expired", "Resolved") and link and link[0] == r.instrument:
                    link = None
            else:
                ts, mid = int(r.ts), float(r.mid)
                if not ring or abs(mid - ring[-1][1]) > 1e-9:
                    ring.append((ts, mid))
                while len(ring) > 1 and ring[1][0] <= ts - self.window:
                    ring.pop(0)
                if last is not None and ts - last < self.cooldown:
                    continue
                if ring[0][0] > ts - self.window or abs(ring[0][1]) <= 1e-12:
                    continue
                move = (mid / ring[0][1] - 1) * 1e4
                yes = quote(link[0]) if link else None
                if (abs(move) < self.bps or yes is None or not self.band[0] <= yes <= self.band[1]
                        or link[1] - ts < self.min_tte):
                    continue
                last = ts
                out.append((ts, int(r.seq), link[0], move, yes, 1 if move > 0 else -1))
        self.ring.put(ring)
        for name, v in quotes.items():
            self.quotes.updateValue((name,), (v,))
        if link:
            self.link.update(link)
        else:
            self.link.clear()
        if last is not None:
            self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["ts", "seq", "target", "move_bps", "yes_price", "direction"])

    def close(self) -> None:
        pass


class Refits(StatefulProcessor):
    """Boundary-scheduled calibration: samples are kept per event, fitted once a boundary is reached.

    As in the batch fit a boundary needs enough rows; the event waits at it until it has them.
    """

    def __init__(self, model, px: list[str], tte_max: int, step: int, window: float, min_rows: int,
                 steps: tuple[int, int]):
        self.model, self.px, self.tte_max, self.step = model, px, tte_max, step
        self.window, self.min_rows, self.steps = window, min_rows, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        cols = ", ".join(f"{p} DOUBLE" for p in self.px)
        self.samples = handle.getListState("samples", f"tte DOUBLE, mid DOUBLE, {cols}")
        self.fitted = handle.getValueState("fitted", "boundary INT, d_b DOUBLE, d_rho DOUBLE, done BOOLEAN")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        from tickloom.operators.surface import fit

        pdf = _ordered(rows)
        kept = [tuple(r) for r in self.samples.get()] if self.samples.exists() else []
        boundary, db, dr, done = (tuple(self.fitted.get()) if self.fitted.exists()
                                  else (self.tte_max, 0.0, 0.0, False))
        out = []
        strike = float(pdf["strike"].iloc[0])
        for r in pdf[["tte_s", "mid", *self.px]].itertuples(index=False):
            if r[0] <= boundary and boundary >= self.step:
                use = np.array([k for k in kept if k[0] > boundary and (
                    self.window <= 0 or k[0] <= boundary + self.window)])
                if len(use) >= self.min_rows:
                    db, dr = fit(self.model, use[:, 2:], use[:, 0], use[:, 1], strike,
                                 (db, dr) if done else (0.0, 0.0), self.steps[1 if done else 0])
                    out.append((key[0], float(boundary), len(use), db, dr))
                    boundary, done = boundary - self.step, True
            kept.append(tuple(float(v) for v in r))
            if self.window > 0:
                kept = [k for k in kept if k[0] <= boundary + self.window]
        self.samples.put(kept)
        self.fitted.update((int(boundary), db, dr, done))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "boundary", "rows", "d_b", "d_rho"])

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema, *,
          time_mode: str = "None") -> DataFrame:
    """Run a processor over the stream, one state per key; ``EventTime`` needs a watermark."""
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode=time_mode)


def throttled(stream: DataFrame, key: str, gap: int, schema, *, at, late: str, per_ms: float = 1000,
              ttl_ms: int = 0) -> DataFrame:
    """Rows of the stream thinned per key in event time ``at``, whatever order they come in within ``late``."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    timed = stream.withColumn("_at", at).withWatermark("_at", late)
    return keyed(timed, key, Throttle(gap, fields, per_ms, ttl_ms), schema, time_mode="EventTime")


def conflated(stream: DataFrame, keys: list[str], sink: Callable[[DataFrame, int], None]):
    """Writer that hands each micro-batch's latest message per key to ``sink``."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(conflate(df, keys), i))


def dedupe_fills(stream: DataFrame, *, at: str = "at", late: str = "5 seconds") -> DataFrame:
    """Each (id, status) once, remembered for as long as the watermark allows."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["venue_trade_id", "status"])


def dedupe_trades(stream: DataFrame, *, at: str = "at", late: str = "1 minute") -> DataFrame:
    """Overlapping polls merged on the trade id, so trades sharing a time are all kept."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["instrument", "trade_id"])


def late_volume(trades: DataFrame, *, at: str = "exch_at", late: str = "5 seconds",
                every: str = "1 second") -> DataFrame:
    """Traded volume by exchange time; trades may arrive up to ``late`` after."""
    return (trades.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), "instrument")
            .agg(F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("start"), "instrument", "volume", "n"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into a parquet table."""
    (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())
