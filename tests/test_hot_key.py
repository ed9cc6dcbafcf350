"""Chunked operators against plain Python on one hot series: edges, ties, odd chunk sizes."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

from tickloom.operators import chunks as C
from tickloom.operators import folds
from tickloom.operators import grid as G
from tickloom.operators import ranges as R
from tickloom.operators import stats as S
from tickloom.operators import trades as T
from tickloom.operators.asof import asof_join

CHUNKS = [7, 100_000]
TICK = "key STRING, ts LONG, seq LONG, v DOUBLE"


def series(n=400, seed=3, span=900, ties=True):
    rng = random.Random(seed)
    ts = sorted(rng.randrange(span) if ties else i * 2 + rng.randrange(2) for i in range(n))
    return [("hot", t, i, round(rng.uniform(-1, 1), 3)) for i, t in enumerate(ts)]


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True),
                                              ("forward", False), ("forward", True)])
@pytest.mark.parametrize("tol", [None, 5])
def test_asof(frame, chunk, direction, strict, tol):
    left, right = series(120, 1), series(60, 2)
    out = asof_join(frame(left, TICK), frame(right, TICK), by=["key"], take={"seq": "hit"}, tol=tol,
                    direction=direction, strict=strict, tie="seq", chunk=chunk)
    times = [r[1] for r in right]

    def expect(t):
        if direction == "backward":
            i = (bisect.bisect_left if strict else bisect.bisect_right)(times, t) - 1
            return None if i < 0 or (tol is not None and t - times[i] > tol) else right[i][2]
        i = (bisect.bisect_right if strict else bisect.bisect_left)(times, t)
        if i == len(times) or (tol is not None and times[i] - t > tol):
            return None
        return right[i][2]

    got = {r.seq: r.hit for r in out.collect()}
    assert got == {r[2]: expect(r[1]) for r in left}


@pytest.mark.parametrize("chunk", CHUNKS)
def test_running_previous_fill_trailing(frame, chunk):
    rows = series()
    df = frame(rows, TICK).withColumn("sparse", F.when(F.col("seq") % 3 == 0, F.col("v")))
    kw = dict(by=["key"], ts="ts", order=["seq"], chunk=chunk)
    df = C.running_sum(df, F.col("v"), "total", **kw)
    df = C.running_sum_min(df, F.col("v"), "total2", "low", **kw)
    df = C.previous(df, {"v": "prev"}, **kw)
    df = C.fill_forward(df, {"sparse": "filled"}, **kw)
    df = C.trailing(df, {"mean": F.avg("v")}, by=["key"], ts="ts", span=20, until=3, chunk=chunk)
    df = G.run_length(df, F.col("v") > -0.5, "run", **kw)
    got = {r.seq: r for r in df.collect()}
    total, low, filled, run = 0.0, float("inf"), None, 0
    for i, (_, t, seq, v) in enumerate(rows):
        total += v
        low = min(low, total)
        filled = v if seq % 3 == 0 else filled
        run = run + 1 if v > -0.5 else 0
        near = [x[3] for x in rows if t - 20 <= x[1] <= t - 3]
        r = got[seq]
        assert r.total == pytest.approx(total) and r.low == pytest.approx(low)
        assert r.prev == (rows[i - 1][3] if i else None) and r.filled == filled and r.run == run
        assert r["mean"] == (pytest.approx(sum(near) / len(near)) if near else None)


@pytest.mark.parametrize("span,until", [(20, 0), (20, 3), (0, 0), (5000, 0)])
def test_trailing_totals(frame, span, until):
    rows = [(k, t, i, v if i % 4 else None) for i, (k, t, _, v) in enumerate(series() + [("", -5, 0, 1.0), (None, 3, 0, 2.0)])]
    df = frame(rows + [("hot", None, 999, 1.0)], TICK)
    out = C.trailing(df, {"mean": ("avg", "v"), "total": ("sum", "v"), "n": ("count", "v"), "high": F.max("v")}, by=["key"],
                     ts="ts", span=span, until=until, chunk=100)
    assert out.columns == ["key", "ts", "seq", "v", "mean", "total", "n", "high"]
    got = {r.seq: r for r in out.collect()}
    assert set(got) == {r[2] for r in rows}
    for key, t, seq, _ in rows:
        near = [x[3] for x in rows if x[0] == key and t - span <= x[1] <= t - until and x[3] is not None]
        r = got[seq]
        assert (r.n, r.high) == (len(near), max(near, default=None))
        assert r.total == (pytest.approx(sum(near)) if near else None)
        assert r["mean"] == (pytest.approx(sum(near) / len(near)) if near else None)


@pytest.mark.parametrize("name", ["trailing_mean", "union_variants", "feed_features"])
def test_means_of_windows_walk_no_window_per_row(spark, capsys, name):
    contract.queries()[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "specifiedwindowframe(RangeFrame, -" not in plan


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("gap", [1, 9, 30])
def test_refractory(frame, chunk, gap):
    rows = series(300, 5)
    out = folds.refractory(frame(rows, TICK), by=["key"], ts="ts", gap=gap, order=["seq"], chunk=chunk)
    kept, last = [], None
    for _, t, seq, _ in rows:
        if last is None or t - last >= gap:
            kept.append(seq)
            last = t
    assert sorted(r.seq for r in out.collect()) == kept


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("enter,leave", [(0.5, 0.2), (0.3, 0.0), (0.9, 0.8)])
def test_hysteresis(frame, chunk, enter, leave):
    rows = series(500, 11)
    out = folds.hysteresis(frame(rows, TICK), "v", enter=enter, leave=leave, by=["key"], ts="ts",
                           order=["seq"], chunk=chunk)
    state, fired = 0, []
    for _, _, seq, v in rows:
        if state:
            if v * state <= leave:
                state = 0
        elif abs(v) >= enter:
            state = 1 if v > 0 else -1
            fired.append(seq)
    assert sorted(r.seq for r in out.collect()) == fired


@pytest.mark.parametrize("chunk", CHUNKS)
def test_islands_and_edges(frame, chunk):
    rows = series(300, 8)
    kw = dict(by=["key"], ts="ts", order=["seq"], chunk=chunk)
    isl = folds.first_per_island(frame(rows, TICK), F.abs("v") <= 0.2, F.abs("v") >= 0.6, **kw)
    edge = folds.rising_edges(frame(rows, TICK), F.col("v") > 0.4, **kw)
    armed, hits, was, edges = True, [], False, []
    for _, _, seq, v in rows:
        if abs(v) <= 0.2:
            armed = True
        elif armed and abs(v) >= 0.6:
            hits.append(seq)
            armed = False
        if v > 0.4 and not was:
            edges.append(seq)
        was = v > 0.4
    assert sorted(r.seq for r in isl.collect()) == hits
    assert sorted(r.seq for r in edge.collect()) == edges


@pytest.mark.parametrize("chunk", [9, 10_000])
def test_ledger(frame, chunk):
    """Oversells are refused one by one; reversals undo only what was applied."""
    rng = random.Random(4)
    rows = []
    for i in range(250):
        side = "Sell" if rng.random() < 0.5 else "Buy"
        rows.append(("hot", i // 2, i, f"f{i}", side, float(rng.randint(1, 9)), round(rng.random(), 3), 0.01, 1.0))
    for i in rng.sample(range(200), 40):  # undone a few rows later, across chunk edges too
        k, t, _, fill, side, q, px, fee, _ = rows[i]
        rows.append((k, t + 7, 1000 + i, fill, side, q, px, fee, -1.0))
    rows.sort(key=lambda r: (r[1], r[2]))
    df = frame(rows, "instrument STRING, ts LONG, seq LONG, venue_trade_id STRING, side STRING, qty DOUBLE, px DOUBLE,"
                     " fee DOUBLE, sign DOUBLE")
    got = {r.seq: r for r in T.position_ledger(df, chunk=chunk).collect()}
    qty = avg = gain = cash = 0.0
    refused, flags = set(), 0
    for _, _, seq, fill, side, q, px, fee, sign in rows:
        step, bad = sign * q if side == "Buy" else -sign * q, False
        if not (sign < 0 and fill in refused):
            bad = qty + step < -1e-6
            if bad:
                refused |= {fill} if sign > 0 else set()
            elif side == "Buy":
                cash -= sign * (q * px + fee)
                avg = (qty * avg + sign * (q * px + fee)) / (qty + step) if qty + step > 1e-6 else avg
                qty += step
            else:
                gain, qty, cash = gain + sign * (q * (px - avg) - fee), qty + step, cash + sign * (q * px - fee)
        r = got[seq]
        flags += bad
        assert r.violation == bad and r.qty_after == pytest.approx(qty) and r.realized == pytest.approx(gain)
        assert r.cash == pytest.approx(cash) and r.avg_cost == pytest.approx(avg)
    assert flags > 10


@pytest.mark.parametrize("chunk", [11, 10_000])
def test_greedy_matching(frame, chunk):
    a, b = series(80, 21, 600), series(90, 22, 600)
    out = R.match_signals(frame(a, TICK), frame(b, TICK), tol=4, by=["key"], chunk=chunk)
    used, pairs = set(), set()
    for _, t, i, _ in a:
        for _, u, j, _ in b:
            if j not in used and abs(u - t) <= 4:
                used.add(j)
                pairs.add((i, j))
                break
    assert {(r.a_id, r.b_id) for r in out.collect()} == pairs


@pytest.mark.parametrize("chunk", [13, 10_000])
def test_rate_limit_and_window_totals(frame, chunk):
    rows = series(200, 31, 500)
    df = frame(rows, TICK)
    got = {r.seq: r.accepted for r in T.rate_limited(df, limit=3, span=20, by=["key"], chunk=chunk).collect()}
    kept = []
    for _, t, seq, _ in rows:
        ok = sum(1 for k in kept if k >= t - 20) < 3
        assert got[seq] == ok
        if ok:
            kept.append(t)
    events = df.filter("seq % 10 = 0").select("key", F.col("ts").alias("t0"), F.col("seq").alias("event_id"))
    out = R.window_totals(events, df, {"n": F.lit(1), "v": F.col("v")}, start=F.col("t0") - 15,
                          end=F.col("t0") + 10, by=["key"], chunk=chunk)
    near = R.near_events(df, events.select("key", "t0"), pad=3, by=["key"], chunk=chunk)
    for r in out.collect():
        inside = [x[3] for x in rows if r.t0 - 15 <= x[1] < r.t0 + 10]
        assert r.n == len(inside) and r.v == pytest.approx(sum(inside))
    t0s = [x[1] for x in rows if x[2] % 10 == 0]
    for r in near.collect():
        assert r.near == any(abs(r.ts - t) <= 3 for t in t0s)


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e9])
def test_order_statistics(frame, scale):
    vals = [round(random.Random(6).gauss(0, 1), 2) for _ in range(1)] + [
        round(np.random.default_rng(6).normal(), 2) for _ in range(1)]
    vals += [round(float(x), 2) for x in np.random.default_rng(7).normal(size=333)]
    vals = [v * scale for v in vals]  # all values close together, or far apart
    df = frame([("k", v) for v in vals], "key STRING, v DOUBLE")
    s = np.sort(vals)
    n = len(s)
    for p in (0.0, 0.5, 0.99):
        for method, want in (("linear", np.percentile(s, 100 * p)), ("truncate", s[int(p * (n - 1))]),
                             ("nearest", s[int(np.floor(p * (n - 1) + 0.5))])):
            r = S.quantiles(df, F.col("v"), {"q": p}, by=["key"], method=method).collect()[0]
            assert r.q == pytest.approx(want, rel=1e-9)


def plain_reverts(rows, delta, eps, horizon, persist=1, cap=None, min_tte=None):
    """The rule row by row; rows are (ts, seq, gap, bid, ask, won, tte)."""
    want, armed, run, entered, k = [], True, 0, 0, 0
    while k < len(rows):
        t, seq, gap, bid, ask, won, tte = rows[k]
        if not armed:
            armed, run, k = abs(gap) <= eps, 0, k + 1
            continue
        run = run + 1 if abs(gap) >= delta else 0
        if run < persist:
            k += 1
            continue
        if (min_tte is not None and tte <= min_tte) or (cap is not None and entered >= cap):
            break
        entered, run, armed = entered + 1, 0, False
        yes = gap > 0
        entry = ask if yes else 1 - bid
        if entry >= 0.99:
            k += 1
            continue
        cost = entry + 0.07 * entry * (1 - entry)
        j = next((j for j in range(k + 1, len(rows)) if abs(rows[j][2]) <= eps or rows[j][0] - t >= horizon), None)
        if j is None:
            want.append((seq, None, "settle", round(float(won == yes) - cost, 9)))
            break
        u, _, closing, b, a, _, _ = rows[j]
        sell = b if yes else 1 - a
        how = "revert" if abs(closing) <= eps else "horizon"
        want.append((seq, u, how, round(sell - 0.07 * sell * (1 - sell) - cost, 9)))
        armed, k = how == "revert", j + 1
    return want


@pytest.mark.parametrize("chunk,rule", [
    (None, dict(persist=2, cap=4)), (110, dict()), (110, dict(persist=3)), (250, dict(min_tte=60.0, cap=9)), (110, dict(eps=0.15))])
def test_revert_trades(frame, chunk, rule):
    rng = random.Random(9)
    rows, gap = [], 0.0
    for i in range(300):
        gap = round(gap * 0.8 + rng.uniform(-0.1, 0.1), 3) if rng.random() < 0.9 else 0.0
        bid = round(rng.choice([0.3, 0.48, 0.985]), 3)
        rows.append((i * 10 + i % 3, i, gap, bid, round(bid + 0.01, 3), 1, 300.0 - i))
    df = frame([("e", *r) for r in rows],
               "ticker STRING, ts LONG, seq LONG, gap DOUBLE, ybid DOUBLE, yask DOUBLE, outc INT, tte_s DOUBLE")
    rule = {"eps": 0.02, **rule}
    out = T.revert_trades(df, [0.1, 0.2], horizon=60, chunk=chunk, keep=["tte_s"], **rule).collect()
    for delta in (0.1, 0.2):
        got = sorted((r.seq, r.exit_ts, r.how, round(r.ret_taker, 9)) for r in out if r.delta == delta)
        want = plain_reverts(rows, delta, horizon=60, **rule)
        assert got == want and (len(want) > 2 or delta == 0.2)


@pytest.mark.parametrize("rule", ["rate", "match", "revert"])
def test_busy_key_takes_many_tasks(spark, frame, rule, monkeypatch):
    """One key without a quiet gap: every chunk is a group of its own, and guesses meet after a few rounds."""
    from tickloom.operators import folds

    n = 3000
    rng = random.Random(3)
    times = [2 * i for i in range(n)] if rule != "rate" else sorted(rng.randrange(2 * n) for _ in range(n))
    df = frame([("k", t, i, float(i)) for i, t in enumerate(times)], TICK)
    groups, rounds, plain = [], [], folds.fold_groups

    def watched(rows, keys, order, fn, schema):
        if "_from" in schema.names:
            rounds.append(rows.select(*keys).distinct().count())
        elif rounds:
            groups.append(rows.select(*keys).distinct().count())
        return plain(rows, keys, order, fn, schema)

    monkeypatch.setattr(folds, "fold_groups", watched)
    if rule == "rate":
        out = T.rate_limited(df, limit=5, span=70, by=["key"], chunk=500)
        kept = []
        for t in times:
            if sum(1 for k in kept[-5:] if k >= t - 70) < 5:
                kept.append(t)
        assert out.filter("accepted").count() == len(kept)
    elif rule == "match":
        out = R.match_signals(df.filter("seq % 3 = 0"), df.withColumn("ts", F.col("ts") + 1), tol=2, by=["key"], chunk=500)
        assert out.count() == n / 3
    else:
        quotes = df.select(F.col("key").alias("ticker"), "ts", "seq", F.lit(0.4).alias("ybid"), F.lit(0.5).alias("yask"),
                           F.expr("if(seq % 10 < 4, 0.2D, 0.01D)").alias("gap"), F.lit(1).alias("outc"))
        out = T.revert_trades(quotes, [0.1], eps=0.02, horizon=900, chunk=500)
        assert out.count() == n / 10
    assert len(groups) == 1 and 12 <= groups[0] == rounds[0] <= 14 and len(rounds) <= (7 if rule == "rate" else 4)


def test_rule_that_never_forgets_is_walked(frame, monkeypatch):
    """A regular flow keeps the limit's phase for ever; guesses never meet."""
    from tickloom.operators import folds

    monkeypatch.setattr(folds, "ROUNDS", 1)
    df = frame([(k, 2 * i, i, 0.0) for k in "ab" for i in range(900)], TICK)
    out = T.rate_limited(df, limit=5, span=70, by=["key"], chunk=250)
    got = sorted((r.key, r.seq) for r in out.filter("accepted").collect())
    assert got == [(k, i) for k in "ab" for i in range(900) if i % 36 < 5]


@pytest.mark.parametrize("whole", [0, 60, 50_000])
def test_ledger_of_quiet_and_busy_keys(frame, monkeypatch, whole):
    """Quiet instruments are walked without a reading of chunks, busy ones by chunks, with the same rows."""
    from tickloom.operators import folds

    rng, rows, read = random.Random(9), [], []
    for key, n in (("a", 40), ("b", 200), ("c", 1), (None, 3)):
        for i in range(n):
            fill = (key, f"{key}{i}", rng.choice(["Buy", "Sell"]), float(rng.randint(1, 9)), round(rng.random(), 3), 0.01)
            rows.append((*fill, 1.0, i // 2, 2 * i))
            if rng.random() < 0.3:
                rows.append((*fill, -1.0, i // 2 + rng.randint(0, 9), 2 * i + 1))
    plain = folds.openings
    monkeypatch.setattr(folds, "openings", lambda rows, **kw: read.append({r[0] for r in rows.select("instrument").collect()})
                        or plain(rows, **kw))
    monkeypatch.setattr(T, "WHOLE_KEY", whole)
    df = frame(rows, "instrument STRING, venue_trade_id STRING, side STRING, qty DOUBLE, px DOUBLE, fee DOUBLE, sign DOUBLE, "
                     "ts LONG, seq LONG")
    got = {(r.instrument, r.seq): r for r in T.position_ledger(df, chunk=9).collect()}
    assert set().union(*read) == {k for k in "abc" if sum(r[0] == k for r in rows) > whole}
    assert len(got) == sum(r[0] is not None for r in rows)
    for key in "abc":
        qty = cost = gain = 0.0
        refused = set()
        for _, fill, side, q, px, fee, sign, _, seq in sorted((r for r in rows if r[0] == key), key=lambda r: r[7:]):
            step = sign * (q if side == "Buy" else -q)
            skip = sign < 0 and fill in refused
            bad = not skip and qty + step < 0
            if bad and sign > 0:
                refused.add(fill)
            if not skip and not bad:
                if side == "Buy" and qty + step > 0:
                    cost = (cost * qty + sign * (q * px + fee)) / (qty + step)
                elif side == "Sell":
                    gain += sign * (q * (px - cost) - fee)
                qty += step
            r = got[key, seq]
            assert (r.qty_after, r.violation) == (qty, bad)
            assert (r.avg_cost, r.realized) == (pytest.approx(cost), pytest.approx(gain))


def test_ledger_reads_a_busy_chunk_once(frame, monkeypatch):
    """100,000 sells of a chunk are refused in one linear reading, and a chunk hands on three numbers."""
    from tickloom.operators import folds

    n, texts, plain = 100_000, [], folds.materialize

    def watched(df, label="table"):
        out = plain(df, label)
        if label == "states":
            texts.append(out.agg(F.max(F.length("_to"))).first()[0])
        return out

    monkeypatch.setattr(folds, "materialize", watched)
    df = frame([("k", "Buy", 5.0, 0)], "instrument STRING, side STRING, qty DOUBLE, seq LONG").unionByName(
        frame([], "instrument STRING, side STRING, qty DOUBLE, seq LONG").sparkSession.range(1, n).select(
            F.lit("k").alias("instrument"), F.lit("Sell").alias("side"), F.lit(2.0).alias("qty"), F.col("id").alias("seq")))
    rows = df.select("*", F.lit(0.5).alias("px"), F.lit(0.0).alias("fee"), F.lit(1.0).alias("sign"),
                     F.concat(F.lit("f"), "seq").alias("venue_trade_id"), F.expr("seq div 2").alias("ts"))
    out = T.position_ledger(rows, chunk=40_000).agg(
        F.count_if("violation").alias("bad"), F.max_by("qty_after", "seq").alias("qty")).first()
    assert out.bad == n - 3 and out.qty == 1.0
    assert len(texts) <= 3 and max(texts) < 80


@pytest.mark.parametrize("chunk,fan,rest", [(13, 2, None), (13, 3, 40), (50, 64, None), (10_000, 64, 90)])
def test_first_passage(frame, chunk, fan, rest):
    from tickloom.operators.passage import first_passage

    rng = random.Random(12)
    rows = [(k, rng.randrange(600), i, round(rng.gauss(0, 1), 2) if rng.random() < 0.95 else None) for k in "ab" for i in range(250)]
    asked = [(k, rng.randrange(-20, 620), i, rng.choice([-1.0, 0.5, 1.5, 2.5, 9.0, None])) for k in "abc" for i in range(120)]
    out = first_passage(frame(asked, TICK), frame(rows, TICK), value=F.col("v"), level=F.col("v"), by=["key"], ident=["seq"],
                        chunk=chunk, rest=rest, fan=fan).collect()
    assert len(out) == len(asked)
    for r in out:
        later = [t for k, t, _, v in rows if k == r.key and t > r.ts and v is not None and r.v is not None and v >= r.v
                 and (rest is None or t <= r.ts + rest)]
        assert r.hit_ts == min(later, default=None)


def test_counts_from_a_rank_on():
    from tickloom.operators.study import counted_from

    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (50, 3), (400, 400)):
        ranks, upto, least = rng.integers(0, top, n), rng.integers(0, n + 1, 60), rng.integers(0, top + 2, 60)
        want = [int((ranks[:k] >= m).sum()) for k, m in zip(upto, least)]
        assert counted_from(ranks, upto, least).tolist() == want


@pytest.mark.parametrize("chunk", [37, 10_000])
def test_tape_of_one_hot_instant(frame, chunk):
    """Ties in time, windows across chunks, many trades at few prices: levels and sweeps as counted by hand."""
    from tickloom.operators import study

    rng = random.Random(14)
    trades = [(rng.randrange(400), i, rng.randrange(0, 400, 9), rng.choice([0.1, 0.2, 0.3, 0.30001]), float(rng.randrange(1, 5)),
               rng.choice(["Buy", "Sell"])) for i in range(500)]
    events = [(i, rng.randrange(-30, 430), rng.choice([1, -1])) for i in range(80)]
    tape = frame(trades, "ts LONG, seq LONG, exch_ts LONG, px DOUBLE, qty DOUBLE, side STRING")
    out = study.tape_stats(frame(events, "event_id LONG, t0 LONG, dir INT"), tape, pre=8, post=14, chunk=chunk)
    got = {r.event_id: r for r in out.collect()}
    for event, t0, direction in events:
        near = [t for t in trades if t0 - 8 <= t[0] < t0 + 14]
        assert (event in got) == bool(near)
        if near:
            r, bursts = got[event], {}
            for t in near:
                bursts.setdefault(t[2], set()).add(round(t[3], 4))
            want = sum(t[4] for t in near if t[5] == ("Buy" if direction > 0 else "Sell")) / sum(t[4] for t in near)
            assert (r.trades, r.levels, r.swept) == (len(near), len({round(t[3], 4) for t in near}), max(map(len, bursts.values())) > 1)
            assert r.aligned == pytest.approx(want)


POINT = "key STRING, ts LONG, seq LONG, run STRING, cum DOUBLE"


def restarting_counter(n=300, seed=4):
    rng, rows, cum, run = random.Random(seed), [], 0.0, 0
    ts = 0
    for i in range(n):
        ts += rng.randrange(4)
        if rng.random() < 0.06:
            cum, run = 0.0, run + 1
        cum += rng.randrange(0, 9)
        rows.append(("hot", ts, i, str(run), None if rng.random() < 0.1 else cum))
    return rows


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("session", [None, "run"])
def test_counter_that_restarts(frame, chunk, session):
    from tickloom.operators.volumes import rejoined_counter

    rows = restarting_counter()
    out = rejoined_counter(frame(rows, POINT), by=["key"], ts="ts", order=["seq"], chunk=chunk, session=session)
    got = {r.seq: r.total for r in out.collect()}
    total, before = 0.0, None
    for _, _, seq, run, cum in rows:
        if cum is not None:
            same = before is not None and (session is None or before[0] == run) and cum >= before[1]
            total += cum - before[1] if same else cum
            before = (run, cum)
        assert got[seq] == total


def test_counter_of_nothing(frame):
    from tickloom.operators.volumes import rejoined_counter

    rows = [("a", 1, 1, "0", None), ("a", 2, 2, "0", 3.0)]
    out = rejoined_counter(frame(rows, POINT), by=["key"], ts="ts", order=["seq"], chunk=1).orderBy("seq")
    assert [r.total for r in out.collect()] == [0.0, 3.0]
    assert rejoined_counter(frame([], POINT), by=["key"], ts="ts", order=["seq"], chunk=1).count() == 0


@pytest.mark.parametrize("chunk", [40, 100_000])
@pytest.mark.parametrize("session", [(), ("line",)])
def test_taker_volume_over_two_lines(frame, chunk, session):
    """One id from both lines counts once, trades without id always; extra columns travel along."""
    from tickloom.operators.volumes import taker_volume

    rng = random.Random(8)
    trades, n = [], 0
    for i in range(200):
        at, qty = rng.randrange(500), float(rng.randrange(1, 6))
        for line in range(rng.choice([1, 1, 2])):
            trades.append(("hot", at + 5 * line, n, line, None if i % 17 == 0 else i, qty))
            n += 1
    df = frame(trades, "key STRING, ts LONG, seq LONG, line INT, trade_id LONG, qty DOUBLE")
    out = taker_volume(df, by=["key"], ts="ts", order=["seq"], gap=9, chunk=chunk, session=session)
    seen, cum, last, want = set(), 0.0, {}, {}
    for t in sorted(trades, key=lambda t: (t[1], t[2])):
        if t[4] is not None and t[4] in seen:
            continue
        seen.add(t[4])
        cum += t[5]
        place = t[3] if session else 0
        if place not in last or t[1] - last[place] >= 9:
            last[place], want[t[2]] = t[1], cum
    assert {r.seq: r.cum for r in out.collect()} == want


LEVELS = "instrument STRING, epoch LONG, side STRING, px_micro LONG, ts LONG, seq LONG, qty DOUBLE"


@pytest.mark.parametrize("chunk", [13, 100_000])
@pytest.mark.parametrize("n", [None, 2])
def test_book_at_instants_of_one_hot_instrument(frame, chunk, n):
    """Ties in time, removals, epochs that end levels, instants before, between and long after the updates."""
    from tickloom.operators import books

    rng = random.Random(21)
    ups, epoch = [], 1
    for i, ts in enumerate(sorted(rng.randrange(20, 300) for _ in range(400))):
        epoch += rng.random() < 0.02
        side = rng.choice(["bid", "ask"])
        px = (100 - rng.randrange(12)) if side == "bid" else (101 + rng.randrange(12))
        ups.append(("hot", epoch, side, px * books.MICRO, ts, i, float(rng.choice([0, 0, 1, 2, 3]))))
    times = sorted({rng.randrange(0, 500) for _ in range(90)} | {u[4] for u in ups[::9]})
    instants = frame([("hot", t) for t in times] + [("cold", 5)], "instrument STRING, ts LONG")
    out = books.book_at(instants, frame(ups, LEVELS), chunk=chunk, n=n).collect()
    assert len(out) == len(times) + 1
    got = {r.ts: r for r in out if r.instrument == "hot"}
    for t in times:
        past = [u for u in ups if u[4] <= t]
        now = {}
        for u in past:
            if u[1] == past[-1][1]:
                now[u[2], u[3] // books.MICRO] = u[6]
        for side, sign in (("bid", -1), ("ask", 1)):
            want = sorted(((p, q) for (s, p), q in now.items() if s == side and q > 0), key=lambda v: sign * v[0])
            assert [(v.px, v.qty) for v in got[t][f"{side}s"]] == want[:n]
    cold = next(r for r in out if r.instrument == "cold")
    assert cold.bids == [] and cold.asks == []


def test_sweep_reads_no_pairs(frame):
    """Rows of the sweep: updates, instants, and the open levels per chunk; ten times the instants add only themselves."""
    from tickloom.operators import books

    ups = frame([("hot", 1, "bid", 50_000_000 + i % 10, i, i, float(i % 4)) for i in range(1000)], LEVELS)
    ask = lambda step: frame([("hot", t) for t in range(0, 1000, step)], "instrument STRING, ts LONG")
    few, many = (books.sweep_rows(ask(step), ups, chunk=100).count() for step in (10, 1))
    assert few <= 1000 + 100 + 10 * 10 and many - few == 900
    lone = books.sweep_rows(frame([("hot", 950)], "instrument STRING, ts LONG"), ups, chunk=100).count()
    assert lone <= 100 + 1 + 10


@pytest.mark.parametrize("spread,bucket", [(9, 7), (60, 25), (900, 25), (25, 10_000)])
def test_sweep_timing_against_pairs(frame, spread, bucket):
    """Clusters shorter and longer than the window, repeated and missing values, chunks without trades or events."""
    from tickloom.operators.study import sweep_timing

    rng = random.Random(spread)
    some = lambda v: None if rng.random() < 0.1 else v
    trades = [(ts, some(ts - ts % spread), some(rng.randrange(4) / 100), some(float(rng.randint(1, 5))),
               some(rng.choice(["Buy", "Sell"]))) for ts in [some(rng.randrange(300)) for _ in range(250)]
              if ts is not None]
    moves = [(some(i), some(rng.randrange(-20, 400)), some(rng.choice([1, -1]))) for i in range(120)]
    moves += moves[:30]
    out = sweep_timing(frame(moves, "event_id LONG, t0 LONG, dir INT"),
                       frame(trades + [(None, 3, 0.01, 1.0, "Buy")], "ts LONG, exch_ts LONG, px DOUBLE, qty DOUBLE, side STRING"),
                       pre=15, post=25, bucket=bucket)
    expect = []
    for event, t0 in {m[:2] for m in moves if m[1] is not None}:
        dirs = [m[2] for m in moves if m[:2] == (event, t0)]
        near = [x for x in trades if t0 - 15 <= x[0] < t0 + 25]
        best = None
        for exch in {x[1] for x in near}:
            own = [x for x in near if x[1] == exch]
            parts = [x[3] if x[4] == ("Buy" if (d or 0) > 0 else "Sell") else 0.0 for d in dirs for x in own]
            levels = len({x[2] for x in own} - {None})
            if len(own) * len(dirs) >= 2 and levels >= 2:
                known = [p for p in parts if p is not None]
                rank = (bool(known), sum(known), -exch if exch is not None else float("-inf"))
                if best is None or rank > best[0]:
                    best = rank, min(x[0] for x in own) - t0, sum(known) if known else None, levels
        if near:
            expect.append((event, min(x[0] for x in near) - t0, *(best[1:] if best else (None,) * 3)))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, out.collect())) == sorted(map(key, expect))
    assert any(r[2] is not None for r in expect)


def test_sweep_timing_pairs_no_trades(spark, capsys):
    contract.queries()["sweep_timing"](spark, "/root/testdata/sf0.001").explain()
    assert "Join" not in capsys.readouterr().out
