"""Small cases with known numbers."""

import pytest
from pyspark.sql import functions as F

from tickloom.functions import instruments as I
from tickloom.functions import ladders as L
from tickloom.functions import prices as P
from tickloom.operators import books as K
from tickloom.operators import grid as G
from tickloom.operators import reports as R
from tickloom.operators import signals as SG
from tickloom.operators import trades as T
from tickloom.operators.asof import asof_join
from tickloom.sources import feeds

MS = 1_000_000
BASE = 1_000_000_000_000


def one(df):
    return df.collect()[0]


def test_window_move(frame):
    ticks = frame([(BASE + k * 100 * MS, k, 100.0 * (1 + k / 10_000)) for k in range(11)],
                  "ts LONG, seq LONG, mid DOUBLE")
    series = G.changes(ticks, "mid", by=[], ts="ts", order=["seq"], chunk=500 * MS)
    out = asof_join(ticks, series, at=F.col("ts") - 1000 * MS, take={"mid": "past"}, chunk=500 * MS)
    rows = {r.ts: r for r in out.collect()}
    assert rows[BASE + 500 * MS].past is None
    last = rows[BASE + 1000 * MS]
    assert (last.mid / last.past - 1) * 1e4 == pytest.approx(10, abs=0.1)


@pytest.mark.parametrize("linked,expected", [(True, 1), (False, 0)])
def test_reference_move_fires_once(frame, linked, expected):
    ref = frame([(BASE + k * 100 * MS, k, 100.0 * (1 + 0.5 * k / 10_000)) for k in range(13)],
                "ts LONG, seq LONG, mid DOUBLE")
    quotes = frame([("t.A.YES", BASE, 1, 0.5)], "instrument STRING, ts LONG, seq LONG, mid DOUBLE")
    start = BASE if linked else BASE + 10**12
    links = frame([("k", "t.A.YES", start, 1, None, BASE + 10**12)],
                  "kind STRING, instrument STRING, from_ts LONG, seq LONG, to_ts LONG, expiry LONG")
    out = SG.move_signals(ref, quotes, links, window=1000 * MS, threshold_bps=3.0, yes_band=(0.2, 0.8),
                          min_tte=60_000 * MS, cooldown=2000 * MS, chunk=10_000 * MS)
    assert out.count() == expected


def test_gap_summary(frame):
    rows = frame([(i / 1000,) for i in range(1, 101)], "gap DOUBLE")
    r = one(R.gap_summary(rows, 0.03, []))
    assert (r.n, r.ge_delta) == (100, 71)
    assert r.mean == pytest.approx(0.0505) and r.max == pytest.approx(0.1)


def test_gap_summary_signed_and_empty(frame):
    rows = frame([(-0.02,), (0.02,), (-0.04,), (0.04,)], "gap DOUBLE")
    r = one(R.gap_summary(rows, 0.03, []))
    assert r.mean == pytest.approx(0) and r.abs_mean == pytest.approx(0.03) and r.ge_delta == 2
    assert R.gap_summary(rows.filter("gap > 1"), 0.03, []).count() == 0


def test_reflected_books(frame):
    raw = frame([('{"seq":1,"msg":{"market_ticker":"M","yes_dollars_fp":[["0.47","20"],["0.48","10"]],'
                  '"no":[[51,5],["50",8],[49,0]]}}', 1)], "raw STRING, recv_ts_ns LONG")
    books = {r.instrument: r for r in feeds.bid_books(feeds.bid_snapshot(raw)).collect()}
    yes, no = books["kalshi.M.YES"], books["kalshi.M.NO"]
    assert [tuple(x) for x in yes.bids] == [(0.48, 10.0), (0.47, 20.0)]
    assert [tuple(x) for x in yes.asks] == [(0.49, 5.0), (0.5, 8.0)]
    assert [tuple(x) for x in no.asks] == [(0.52, 10.0), (0.53, 20.0)]


def test_signed_deltas_remove_level_and_flag_gap(frame):
    rows = frame([("m", 1, "yes", 480_000, t, t, d) for t, d in ((1, 10.0), (2, 3.0), (3, -13.0))],
                 "instrument STRING, epoch LONG, side STRING, px_micro LONG, ts LONG, seq LONG, delta DOUBLE")
    sizes = {r.seq: r.qty for r in K.absolute_sizes(rows, chunk=2).collect()}
    assert sizes == {1: 10.0, 2: 13.0, 3: 0.0}
    msgs = frame([("m", 1, 1, "snapshot", 1), ("m", 2, 2, "delta", 2), ("m", 3, 3, "delta", 3),
                  ("m", 4, 4, "delta", 5), ("m", 5, 5, "delta", 6)],
                 "instrument STRING, ts LONG, seq LONG, kind STRING, book_seq LONG")
    out = {r.seq: (r.gap, r.valid) for r in K.bid_epochs(msgs, chunk=2).collect()}
    assert out == {1: (False, True), 2: (False, True), 3: (False, True), 4: (True, False),
                   5: (False, False)}


@pytest.mark.parametrize("updates,valid", [
    ([(97, 99, 96), (100, 102, 99), (103, 104, 102)], [True, True]),
    ([(103, 104, 102)], [False]),
    ([(100, 101, 99), (102, 103, 102)], [True, False])])
def test_sequenced_depth(frame, updates, valid):
    snap = frame([("b", 100)], "instrument STRING, last_update_id LONG")
    ups = frame([("b", *u) for u in updates],
                "instrument STRING, first_id LONG, last_id LONG, prev_id LONG")
    out = K.depth_epochs(snap, ups, chunk=2).orderBy("last_id").collect()
    assert [r.valid for r in out] == valid


def test_replay_keeps_best_quotes_and_flags_crossing(frame):
    ups = frame([("b", 1, "bid", 50_000_500_000, 1, 1, 1.0), ("b", 1, "ask", 50_001_000_000, 2, 2, 1.0),
                 ("b", 1, "bid", 50_000_500_000, 3, 3, 0.0), ("b", 1, "bid", 50_002_000_000, 4, 4, 1.0)],
                "instrument STRING, epoch LONG, side STRING, px_micro LONG, ts LONG, seq LONG, qty DOUBLE")
    out = K.replay_tops(ups, chunk=2).orderBy("seq").collect()
    assert [(r.bid, r.crossed) for r in out] == [
        (50000.5, False), (50000.5, False), (None, False), (50002.0, True)]


LEDGER = "instrument STRING, venue_trade_id STRING, status STRING, side STRING, qty DOUBLE, px DOUBLE, fee DOUBLE, ts LONG, seq LONG"


def ledger(frame, rows):
    df = frame([("i", v, s, side, q, p, 0.0, n, n) for n, (v, s, side, q, p) in enumerate(rows)], LEDGER)
    return T.position_ledger(T.effective_fills(df), chunk=2).orderBy("seq").collect()


def test_ledger_round_trip(frame):
    last = ledger(frame, [("a", "Confirmed", "Buy", 20.0, 0.40), ("b", "Confirmed", "Sell", 20.0, 0.45)])[-1]
    assert last.realized == pytest.approx(1.0) and 1000 + last.cash == pytest.approx(1001)
    assert last.qty_after == 0 and not last.violation


def test_ledger_replay_applies_once(frame):
    rows = ledger(frame, [("a", "Matched", "Buy", 20.0, 0.40), ("a", "Matched", "Buy", 20.0, 0.40),
                          ("a", "Confirmed", "Buy", 20.0, 0.40)])
    assert len(rows) == 1 and rows[0].qty_after == 20


def test_ledger_reversal(frame):
    last = ledger(frame, [("a", "Matched", "Buy", 20.0, 0.40), ("a", "Failed", "Buy", 20.0, 0.40)])[-1]
    assert 1000 + last.cash == pytest.approx(1000) and last.qty_after == 0


def test_ledger_oversell_is_flagged(frame):
    rows = ledger(frame, [("a", "Confirmed", "Buy", 10.0, 0.40), ("b", "Confirmed", "Sell", 20.0, 0.45)])
    assert [r.violation for r in rows] == [False, True] and rows[-1].qty_after == 10


def test_ledger_goes_on_after_an_oversell(frame):
    last = ledger(frame, [("a", "Confirmed", "Buy", 10.0, 0.40), ("b", "Confirmed", "Sell", 11.0, 0.45),
                          ("c", "Confirmed", "Buy", 5.0, 0.50), ("d", "Confirmed", "Sell", 5.0, 0.60)])[-1]
    assert last.qty_after == 10 and last.realized == pytest.approx(5 * (0.6 - 6.5 / 15)) and not last.violation


def test_ledger_closing_sell_fails(frame):
    last = ledger(frame, [("a", "Confirmed", "Buy", 10.0, 0.40), ("b", "Matched", "Sell", 10.0, 0.60),
                          ("b", "Failed", "Sell", 10.0, 0.60)])[-1]
    assert (last.qty_after, last.realized, last.avg_cost) == (10, pytest.approx(0), pytest.approx(0.4))


def test_ledger_refused_fill_has_nothing_to_undo(frame):
    rows = ledger(frame, [("a", "Confirmed", "Buy", 10.0, 0.40), ("b", "Matched", "Sell", 11.0, 0.60),
                          ("b", "Failed", "Sell", 11.0, 0.60)])
    assert [r.violation for r in rows] == [False, True, False] and rows[-1].qty_after == 10 and rows[-1].cash == -4


def test_settlement(frame):
    pos = frame([("kalshi.M.YES", 20.0, 0.4), ("kalshi.M.NO", 5.0, 0.5)],
                "instrument STRING, qty DOUBLE, avg_cost DOUBLE")
    out = {r.instrument: r for r in T.settle_positions(pos, frame([("kalshi.M.YES",)], "winner STRING")).collect()}
    assert 1000 - 8 + out["kalshi.M.YES"].settle_cash == pytest.approx(1000 - 8 + 20)
    assert out["kalshi.M.NO"].settle_pnl == pytest.approx(-2.5)


def test_sweep_and_fee(frame):
    df = frame([([(0.40, 15.0), (0.38, 10.0), (0.30, 50.0)],)], "b ARRAY<STRUCT<px: DOUBLE, qty: DOUBLE>>")
    r = one(df.select(L.sweep(F.col("b"), F.lit(25.0), F.lit(0.35), "sell").alias("x"),
                      P.fee(F.lit(0.4), F.lit(20.0)).alias("fee")))
    assert r.x.qty == 25 and r.x.vwap == pytest.approx(0.392) and r.fee == pytest.approx(0.336)


def test_instruments_topics_and_dates(frame):
    df = frame([("kalshi.X.YES", "market.kalshi.X.book", 1781416438838654500)], "i STRING, t STRING, ns LONG")
    m = lambda p: I.topic_match(F.col("t"), p)
    r = one(df.select(
        I.traded_instrument(F.col("i"), F.lit(-1)).alias("down"),
        I.complement(F.lit("other.X.YES")).alias("other"), m("market.#").alias("all"),
        m("market.*.book").alias("short"), m("market.*.*.book").alias("exact"),
        I.topic_match(F.lit("market"), "market.#").alias("zero"),
        I.utc_date_ns(F.col("ns")).alias("d"), I.utc_date_ns(F.lit(0).cast("long")).alias("d0")))
    assert (r.down, r.other) == ("kalshi.X.NO", "other.X.YES")
    assert (r["all"], r.short, r.exact, r.zero) == (True, False, True, True)
    assert str(r.d) == "2026-06-14" and str(r.d0) == "1970-01-01"


def test_conflation_keeps_latest(frame):
    df = frame([("a", 1, 1, "a"), ("b", 2, 2, "b"), ("a", 3, 3, "a2")], "k STRING, ts LONG, seq LONG, v STRING")
    assert sorted(r.v for r in SG.conflate(df, ["k"]).collect()) == ["a2", "b"]


def test_exposure_cap(frame):
    df = frame([(0.0, 1, 10.0, True), (35.0, 1, 10.0, False), (35.0, -1, 10.0, True), (60.0, -1, 10.0, True),
                (-35.0, -1, 10.0, False)], "net DOUBLE, d INT, size DOUBLE, ok BOOLEAN")
    out = df.withColumn("got", P.exposure_ok(F.col("net"), F.col("d"), F.col("size"), 40.0)).collect()
    assert all(r.got == r.ok for r in out)


def test_lifecycle_links(frame):
    from tickloom.operators.ranges import link_asof, link_intervals
    meta = frame([("k", "A", 10, 1, "Live"), ("k", "B", 20, 2, "Upcoming"), ("k", "B", 30, 3, "Live"),
                  ("k", "A", 35, 4, "Expired"), ("k", "B", 40, 5, "Expired")],
                 "kind STRING, instrument STRING, ts LONG, seq LONG, status STRING")
    ticks = frame([("k", t) for t in (5, 12, 32, 37, 45)], "kind STRING, ts LONG")
    out = link_asof(ticks, link_intervals(meta), by=["kind"], chunk=10).orderBy("ts").collect()
    assert [r.target for r in out] == [None, "A", "B", "B", None]


def test_closure_at_a_horizon_counts_trades_that_never_close(frame):
    from tickloom.operators import reports

    trades = frame([("m", 1, 5.0, 0.06, 0.02, -0.04, -0.01, 1, 0.5), ("m", 0, 9.0, 0.04, 0.01, 0.02, None, 0, -0.4),
                    ("m", 1, None, 0.9, None, None, None, 1, 0.9), ("none", 1, None, 0.9, None, None, None, 1, 0.9)],
                   "model STRING, side_yes INT, cap_s DOUBLE, gap DOUBLE, cap_dmid DOUBLE, cap_dfair DOUBLE, "
                   "cap_dfair_fx DOUBLE, won INT, net DOUBLE")
    r = one(reports.capped_closure(trades, ["model"]))
    assert (r.model, r.trades, r.n, r.n_fx) == ("m", 3, 2, 1)
    assert (r.gap0, r.mkt_move, r.fair_move) == (pytest.approx(5), pytest.approx(0.5), pytest.approx(-3))
    assert (r.fx_move, r.refit_move, r.residual) == (pytest.approx(-1), pytest.approx(-3), pytest.approx(1.5))
    assert (r.net_won, r.net_lost) == (0.5, -0.4)


def test_snapshots_of_one_instant_have_a_fixed_winner(frame):
    rows = [(1_000_000_000, "[[10, 1]]", "[[11, 1]]"), (1_500_000_000, "[[10, 2]]", "[[12, 1]]"),
            (1_500_000_000, "[[10, 3]]", "[[12, 1]]")]
    for some in (rows, rows[::-1]):
        out = K.l2_features(frame(some, "recv_ts_ns LONG, bids_json STRING, asks_json STRING"), ks=(1,), bands=()).collect()
        assert [(r.t, r.imb1) for r in out] == [(1, 0.5)]
