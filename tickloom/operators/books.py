"""Order books from snapshots and level updates.

Updates carry ``instrument, ts, seq, epoch, side ('bid'|'ask'), px_micro, qty``; an epoch
starts with a snapshot and ends where the sequence breaks. A level's size holds from one
update to the next, so the table of level lifetimes answers any instant with a join, and
opens any time chunk without replaying what came before it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import ladders as L
from tickloom.functions.instruments import int_div
from tickloom.operators import chunks as C
from tickloom.operators.asof import asof_join
from tickloom.operators.folds import fold_groups, fold_stream
from tickloom.schema import struct_of
from tickloom.session import materialize

LEVEL = ["instrument", "epoch", "side", "px_micro"]
MICRO = 1_000_000


def absolute_sizes(deltas: DataFrame, *, chunk: int) -> DataFrame:
    """Signed size changes to resting sizes, never below zero.

    ``max(0, size + change)`` step by step equals the running total minus its lowest point
    (or zero): two running aggregates instead of a fold. Sizes are rounded to 1e-6, so a
    fully consumed level is exactly gone.
    """
    kw = dict(by=LEVEL, ts="ts", order=["seq"], chunk=chunk)
    rows = C.running_sum(deltas, F.col("delta"), "_s", **kw)
    rows = rows.withColumn("_s", F.round("_s", 6))
    rows = C.with_chunk(rows, "ts", chunk)
    rows = C.chunk_carry(rows, LEVEL, {"_m": F.min("_s")}, {"_before": ("_m", "min")})
    frame = C.chunk_window(LEVEL, "ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    low = F.least(F.min("_s").over(frame), F.coalesce("_before", F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("qty", F.round(F.col("_s") - low, 6)).drop(
        "_s", "_before", C.CHUNK)


def bid_epochs(messages: DataFrame, *, chunk: int) -> DataFrame:
    """Epoch and validity of snapshot/delta messages (``kind``, ``book_seq``).

    Deltas before the first snapshot have epoch 0 and are invalid; a sequence gap makes
    the rest of its epoch invalid, since only a new snapshot can repair it.
    """
    kw = dict(by=["instrument"], ts="ts", order=["seq"], chunk=chunk)
    snap = F.col("kind") == "snapshot"
    rows = C.running_sum(messages, snap.cast("long"), "epoch", **kw)
    rows = C.previous(rows, {"book_seq": "_p"}, **kw)
    gap = ~snap & F.coalesce(F.col("book_seq") != F.col("_p") + 1, F.lit(False))
    rows = rows.withColumn("gap", gap)
    rows = _valid_until_gap(rows.drop("_p"), "ts", "seq")
    return rows.withColumn("valid", (F.col("epoch") > 0) & F.col("valid"))


def _valid_until_gap(rows: DataFrame, *order: str) -> DataFrame:
    """Rows before the first gap of their epoch; gaps are rare, so this is a small join."""
    at = F.struct(*order)
    first = rows.filter(F.col("gap")).groupBy("instrument", "epoch").agg(F.min(at).alias("_gap"))
    out = rows.join(first, ["instrument", "epoch"], "left")
    return out.withColumn("valid", F.coalesce(at < F.col("_gap"), F.lit(True))).drop("_gap")


def depth_epochs(snapshots: DataFrame, updates: DataFrame, *, chunk: int) -> DataFrame:
    """Depth updates tied to the snapshot they extend, in update-id order.

    An update belongs to the latest snapshot id it is not covered by. The first one kept
    must straddle that id, each later one must name its predecessor; from the first break
    on, the epoch is invalid.
    """
    snaps = snapshots.select("instrument", F.col("last_update_id").alias("_id"))
    rows = asof_join(updates, snaps, by=["instrument"], ts="last_id", right_ts="_id",
                     take={"_id": "epoch"}, chunk=chunk)
    rows = materialize(rows.filter(F.col("epoch").isNotNull()), "epochs")  # both steps below read their rows twice
    kw = dict(by=["instrument", "epoch"], ts="last_id", chunk=chunk)
    rows = C.previous(rows, {"last_id": "_p"}, **kw)
    first = F.col("_p").isNull()
    bad = F.when(first, F.col("first_id") > F.col("epoch")).otherwise(
        F.col("prev_id") != F.col("_p"))
    rows = materialize(rows.withColumn("gap", bad).drop("_p"), "gaps")
    return _valid_until_gap(rows, "last_id")


def level_lifetimes(updates: DataFrame, *, chunk: int) -> DataFrame:
    """Each update with the time its size stops holding (next update of the level or epoch)."""
    rows = updates.withColumn("_neg", -F.col("ts")).withColumn("_negseq", -F.col("seq"))
    rows = C.previous(rows, {"ts": "_next", "seq": "_nextseq"}, by=LEVEL, ts="_neg",
                      order=["_negseq"], chunk=chunk)
    epochs = updates.groupBy("instrument", "epoch").agg(F.min("ts").alias("_from"),
                                                        F.max("ts").alias("_seen"))
    w = Window.partitionBy("instrument").orderBy("epoch")  # a few epochs per instrument
    ends = epochs.select("instrument", "epoch", F.coalesce(
        F.lead("_from").over(w), F.lit((1 << 62))).alias("_end"))
    rows = rows.join(ends, ["instrument", "epoch"])
    return rows.withColumn("until", F.least(F.coalesce("_next", "_end"), "_end")).drop(
        "_neg", "_negseq", "_next", "_nextseq", "_end")


class SideLevels:
    """Sizes of one side by price, the prices kept sorted."""

    def __init__(self):
        self.sizes, self.prices = {}, []

    def put(self, px: int, qty: float) -> None:
        if qty > 0:
            if px not in self.sizes:
                insort(self.prices, px)
            self.sizes[px] = qty
        elif px in self.sizes:
            del self.sizes[px]
            self.prices.pop(bisect_left(self.prices, px))

    def best_first(self, side: str, n: int | None) -> tuple[list[int], list[float]]:
        if side == "bid":
            prices = self.prices[::-1] if n is None else self.prices[:-n - 1:-1]
        else:
            prices = self.prices[:n]
        return prices, [self.sizes[p] for p in prices]


def _empty_book() -> dict[str, SideLevels]:
    return {"bid": SideLevels(), "ask": SideLevels()}


OPENED, UPDATED, ASKED = 0, 1, 2


def _opening(updates: DataFrame, wanted: DataFrame, *, chunk: int) -> DataFrame:
    """Levels alive at the start of the wanted ``(instrument, chunk)`` places, as rows of those chunks."""
    lives = level_lifetimes(updates, chunk=chunk).filter(F.col("qty") > 0)
    first = C.chunk_start(F.col("ts"), chunk) + chunk
    spans = wanted.groupBy("instrument").agg(F.max(C.CHUNK).alias("_last"))
    stop = F.least(F.col("until"), F.col("_last"))
    rows = lives.join(spans, "instrument").filter(first <= stop).select(
        *LEVEL, "qty", "until", F.explode(F.sequence(first, C.chunk_start(stop, chunk), F.lit(chunk)))
        .alias(C.CHUNK)).filter(F.col("until") > F.col(C.CHUNK))
    return rows.join(wanted, ["instrument", C.CHUNK], "left_semi").select(*LEVEL, "qty", C.CHUNK)


def sweep_rows(instants: DataFrame, updates: DataFrame, *, chunk: int) -> DataFrame:
    """What the sweep of each chunk that holds instants reads: opening levels, updates, instants.

    One row per update and instant, and one per level alive at a chunk's start; chunks without
    instants are left out.
    """
    probes = C.with_chunk(instants.select("instrument", "ts").distinct(), "ts", chunk)
    wanted = probes.select("instrument", C.CHUNK).distinct()
    own = C.with_chunk(updates.select(*LEVEL, "qty", "ts", "seq"), "ts", chunk).join(
        wanted, ["instrument", C.CHUNK], "left_semi")
    opened = _opening(updates, wanted, chunk=chunk)
    none = F.lit(0)
    cols = ["instrument", C.CHUNK, "ts", "_kind", "epoch", "seq", "side", "px_micro", "qty"]
    rows = own.withColumn("_kind", F.lit(UPDATED)).select(*cols)
    rows = rows.unionByName(opened.withColumns(
        {"ts": F.col(C.CHUNK), "seq": none, "_kind": F.lit(OPENED)}).select(*cols))
    return rows.unionByName(probes.withColumns(
        {"epoch": none, "seq": none, "side": F.lit(""), "px_micro": none, "qty": F.lit(0.0),
         "_kind": F.lit(ASKED)}).select(*cols))


SWEPT = struct_of("instrument STRING, ts BIGINT, bid_px ARRAY<BIGINT>, bid_sz ARRAY<DOUBLE>, "
                  "ask_px ARRAY<BIGINT>, ask_sz ARRAY<DOUBLE>")


class _Sweep:
    """Levels of one chunk as its rows pass in time order; an instant gives what stands then."""

    def __init__(self, instrument: str, n: int | None):
        self.instrument, self.n = instrument, n
        self.book, self.epoch = _empty_book(), None

    def step(self, d):
        out = {c: [] for c in SWEPT.names}
        for kind, ts, epoch, side, px, qty in zip(*[d[c].tolist() for c in (
                "_kind", "ts", "epoch", "side", "px_micro", "qty")]):
            if kind == ASKED:
                out["instrument"].append(self.instrument)
                out["ts"].append(ts)
                for s in ("bid", "ask"):
                    prices, sizes = self.book[s].best_first(s, self.n)
                    out[f"{s}_px"].append(prices)
                    out[f"{s}_sz"].append(sizes)
                continue
            if self.epoch is None or epoch > self.epoch:
                self.book, self.epoch = _empty_book(), epoch
            if epoch == self.epoch:  # what is left of an older epoch no longer counts
                self.book[side].put(px, qty)
        return out if out["ts"] else None

    def end(self):
        return None


def book_at(instants: DataFrame, updates: DataFrame, *, chunk: int, n: int | None = None) -> DataFrame:
    """Levels of each side at each ``(instrument, ts)`` instant, all of them or the top ``n``.

    Updates at the instant itself count. Every chunk is one sweep in time order, in which the
    instants stand among the updates: no instant-level pairs, and work per chunk in proportion
    to its rows and to the levels given out. Instants before the first update have empty sides.
    """
    rows = sweep_rows(instants, updates, chunk=chunk)
    books = fold_stream(rows, ["instrument", C.CHUNK],
                        ["ts", "_kind", "epoch", "seq", "side", "px_micro"],
                        lambda key: _Sweep(key[0], n), SWEPT)
    return books.select("instrument", "ts", *[
        F.zip_with(f"{s}_px", f"{s}_sz", lambda p, q: L.level(p / MICRO, q)).alias(f"{s}s")
        for s in ("bid", "ask")])


TOP = struct_of("instrument STRING, ts BIGINT, seq BIGINT, bid DOUBLE, bid_sz DOUBLE, "
                "ask DOUBLE, ask_sz DOUBLE, crossed BOOLEAN")


def replay_tops(updates: DataFrame, *, chunk: int) -> DataFrame:
    """Best quotes after every update, each time chunk replayed on its own.

    A chunk opens with the levels alive at its start, so a busy instrument is replayed by
    as many tasks as it has chunks.
    """
    own = C.with_chunk(updates.select(*LEVEL, "qty", "ts", "seq"), "ts", chunk)
    opening = _opening(updates, own.select("instrument", C.CHUNK).distinct(), chunk=chunk)
    opening = opening.withColumns({"ts": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long")})

    def replay(key, d):
        book, epoch, rows = _empty_book(), None, []
        for side, px, qty, ts, seq, ep in zip(d["side"], d["px_micro"], d["qty"], d["ts"],
                                              d["seq"], d["epoch"]):
            if ep != epoch:
                book, epoch = _empty_book(), ep
            book[side].put(px, qty)
            if seq < 0:
                continue
            bids, asks = book["bid"], book["ask"]
            b, a = bids.prices[-1] if bids.prices else None, asks.prices[0] if asks.prices else None
            rows.append((ts, seq, None if b is None else b / MICRO, bids.sizes.get(b),
                         None if a is None else a / MICRO, asks.sizes.get(a),
                         b is not None and a is not None and b >= a))
        if not rows:
            return None
        out = dict(zip(("ts", "seq", "bid", "bid_sz", "ask", "ask_sz", "crossed"), zip(*rows)))
        out = {k: list(v) for k, v in out.items()}
        out["instrument"] = [key[0]] * len(rows)
        return out

    return fold_groups(own.unionByName(opening), ["instrument", C.CHUNK],
                       ["epoch", "ts", "seq", "side", "px_micro"], replay, TOP)


def top_of_book(books: DataFrame, *, chunk: int, order: str = "seq") -> DataFrame:
    """Best quotes per book row; a missing side keeps its previous value.

    The mid is null until both sides have been quoted.
    """
    side = lambda c: F.when(F.size(c) > 0, F.get(c, F.lit(0)))
    rows = books.withColumn("_b", side("bids")).withColumn("_a", side("asks"))
    rows = C.fill_forward(rows, {"_b": "_fb", "_a": "_fa"}, by=["instrument"], ts="ts",
                          order=[order], chunk=chunk)
    bid, ask = F.col("_fb.px"), F.col("_fa.px")
    keep = [c for c in books.columns if c not in ("bids", "asks")]
    return rows.select(
        *keep, bid.alias("bid"), F.col("_fb.qty").alias("bid_sz"), ask.alias("ask"),
        F.col("_fa.qty").alias("ask_sz"),
        F.when((bid > 0) & (ask > 0), (bid + ask) / 2).alias("mid"),
        (F.coalesce(ask, F.lit(0.0)) - F.coalesce(bid, F.lit(0.0))).alias("spread"))


def l2_features(snapshots: DataFrame, *, ks=(1, 5, 20, 100), bands=(5, 10, 25)) -> DataFrame:
    """Per-second features of the last snapshot in each second (ladders as JSON text).

    Of snapshots received at the same instant the one with the greatest text counts.
    """
    sec = int_div(F.col("recv_ts_ns"), 1_000_000_000)
    last = snapshots.groupBy(sec.alias("t")).agg(
        F.max(F.struct("recv_ts_ns", "bids_json", "asks_json")).alias("_s"))
    pairs = {s: L.from_pairs(F.from_json(F.col(f"_s.{s}_json"), "ARRAY<ARRAY<DOUBLE>>"))
             for s in ("bids", "asks")}
    both = F.explode(F.array(F.struct(*[v.alias(k) for k, v in pairs.items()])))
    rows = last.select("t", both.alias("_l")).filter((F.size("_l.bids") > 0)
                                                     & (F.size("_l.asks") > 0))
    b, a = F.col("_l.bids"), F.col("_l.asks")
    return rows.select(
        "t", L.mid(b, a).alias("mid"), L.spread_bps(b, a).alias("spread_bps"),
        *[L.imbalance(b, a, k).alias(f"imb{k}") for k in ks],
        *[L.band_imbalance(b, a, w).alias(f"band{w}") for w in bands],
        L.micro_offset_bps(b, a).alias("moff_bps"))


def l1_fast(snapshots: DataFrame) -> DataFrame:
    """Top imbalance and mid from the first level of the text only, every snapshot."""
    first = r"^\s*\[\s*\[\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)"
    one = lambda c, i: F.regexp_extract(c, first, i).try_cast("double")
    rows = snapshots.select(
        F.expr("recv_ts_ns div 1000000").alias("t_ms"),
        *[one(f"{s}s_json", i).alias(f"_{s}{n}") for s in ("bid", "ask")
          for i, n in ((1, "p"), (2, "q"))])
    total = F.col("_bidq") + F.col("_askq")
    return rows.filter(total > 0).select(
        "t_ms", ((F.col("_bidq") - F.col("_askq")) / total).alias("imb1"),
        ((F.col("_bidp") + F.col("_askp")) / 2).alias("mid"))
