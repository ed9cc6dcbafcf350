"""Episodes, entries, exits, ledger, probes and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import ladders as L
from tickloom.operators import folds
from tickloom.operators import joint as J
from tickloom.operators import reports as R
from tickloom.operators import surface as U
from tickloom.operators import trades as T
from tickloom.plans.book_queries import BOOK_SQL, r6, snapshots
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, FILLS, HOUR, MINUTE, SCORED, TICKS, fills, micros, scored, table, ticks

SEC = 10 * MINUTE  # one strategy second on the stand-in clock
DELTA, REARM = 0.05, 0.02

EPISODES = f"""WITH RECURSIVE {SCORED},
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS n FROM scored),
w AS (SELECT ticker, n, CASE WHEN abs(gap) >= {DELTA}::DOUBLE THEN sign(gap) ELSE 0 END AS st,
    abs(gap) >= {DELTA}::DOUBLE AS hit FROM r WHERE n = 1
  UNION ALL
  SELECT r.ticker, r.n, CASE WHEN w.st = 0 THEN CASE WHEN abs(r.gap) >= {DELTA}::DOUBLE THEN sign(r.gap) ELSE 0 END
      WHEN r.gap * w.st <= {REARM}::DOUBLE THEN 0 ELSE w.st END,
    w.st = 0 AND abs(r.gap) >= {DELTA}::DOUBLE
  FROM w JOIN r ON r.ticker = w.ticker AND r.n = w.n + 1),
hits AS (SELECT r.*, lag(r.ts) OVER (PARTITION BY r.ticker ORDER BY r.ts, r.seq) AS prev_cross,
    row_number() OVER (PARTITION BY r.ticker ORDER BY r.ts, r.seq) AS k,
    CASE WHEN r.gap > 0 THEN 1 ELSE 0 END AS side_yes
  FROM w JOIN r USING (ticker, n) WHERE w.hit AND r.tte_s > 60)"""


def hits(spark, sf, cap=0):
    return T.gap_crossings(scored(spark, sf), DELTA, rearm=REARM, tte_min=60.0, cap=cap, chunk=DAY)


@query("gap_episodes", EPISODES + """
SELECT ticker, seq, prev_cross, side_yes FROM hits WHERE k <= 6""")
def gap_episodes(spark, sf):
    return hits(spark, sf, cap=6).select("ticker", "seq", "prev_cross", "side_yes")


@query("hysteresis_one_key", f"""WITH RECURSIVE {SCORED},
r AS (SELECT instrument, seq, gap, row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) AS n FROM scored),
w AS (SELECT instrument, n, seq, CASE WHEN abs(gap) >= 0.1::DOUBLE THEN sign(gap) ELSE 0 END AS st,
    abs(gap) >= 0.1::DOUBLE AS hit FROM r WHERE n = 1
  UNION ALL SELECT r.instrument, r.n, r.seq, CASE WHEN w.st = 0 THEN CASE WHEN abs(r.gap) >= 0.1::DOUBLE THEN sign(r.gap) ELSE 0 END
      WHEN r.gap * w.st <= 0.001::DOUBLE THEN 0 ELSE w.st END, w.st = 0 AND abs(r.gap) >= 0.1::DOUBLE
  FROM w JOIN r ON r.instrument = w.instrument AND r.n = w.n + 1)
SELECT instrument, seq FROM w WHERE hit""")
def hysteresis_one_key(spark, sf):
    return folds.hysteresis(scored(spark, sf), "gap", enter=0.1, leave=0.001, by=["instrument"],
                            ts="ts", order=["seq"], chunk=2 * DAY).select("instrument", "seq")


LOOK = f""", p AS (SELECT *, ts - {SEC} AS want FROM scored),
lk AS (SELECT p.ticker, p.seq, CASE WHEN p.want - q.ts <= {9 * SEC} THEN p.fair - q.fair END AS dfair,
    CASE WHEN p.want - q.ts <= {9 * SEC} THEN p.mid - q.mid END AS dmid
  FROM p ASOF LEFT JOIN scored q ON p.ticker = q.ticker AND p.want >= q.ts)"""


def moved(rows, lookup=None):
    out = T.with_lookback(rows, ["fair", "mid"], second=SEC, chunk=DAY) if lookup is None else lookup
    return out.withColumn("dfair", F.col("fair") - F.col("then_fair")).withColumn(
        "dmid", F.col("mid") - F.col("then_mid"))


def hits_with_moves(spark, sf):
    """Crossings with the moves since the look-back row of the full series."""
    from tickloom.operators.asof import asof_join
    past = scored(spark, sf).select("ticker", "ts", "fair", "mid")
    out = asof_join(hits(spark, sf), past, by=["ticker"], at=F.col("ts") - SEC, tol=9 * SEC,
                    take={"fair": "then_fair", "mid": "then_mid"}, chunk=DAY)
    return moved(None, out)


@query("ride_gates", EPISODES + LOOK + """, g AS (
  SELECT h.seq, h.gap, CASE WHEN side_yes = 1 THEN 1 ELSE -1 END AS s, dfair, dmid FROM hits h JOIN lk USING (ticker, seq)),
t AS (SELECT *, s * dfair AS push, -s * dmid AS pull FROM g)
SELECT seq, round(push, 6) + 0.0 AS push, round(pull, 6) + 0.0 AS pull,
  coalesce(push + pull > 0.05::DOUBLE AND push / nullif(push + pull, 0) > 0.75::DOUBLE, false) AS ride,
  NOT coalesce(push + pull > 0.05::DOUBLE AND push / nullif(push + pull, 0) > 0.75::DOUBLE, false) AS fade,
  coalesce(dfair * dmid > 0 AND abs(dmid) >= 2 * abs(dfair) AND s * (gap - dfair + dmid) <= -0.01::DOUBLE, false) AS overreact
FROM t""")
def ride_gates(spark, sf):
    rows = T.ride_terms(hits_with_moves(spark, sf))
    return rows.select("seq", *r6("push", "pull"), *[
        T.gate(k).alias(k) for k in ("ride", "fade", "overreact")])


@query("entry_vetoes", EPISODES + f"""
SELECT seq, CASE WHEN seq % 3000 > 2500 THEN 'stale' WHEN ts - prev_cross < {6 * SEC} THEN 'cooldown' END AS why FROM hits""")
def entry_vetoes(spark, sf):
    rows = hits(spark, sf).withColumn("cb_age_ms", F.pmod("seq", F.lit(3000)))
    return rows.select("seq", T.veto(stale_ms=2500, cooldown=6 * SEC).alias("why"))


ENTRY = EPISODES + f""", want AS (SELECT *, ts + {3 * SEC} AS w FROM hits),
fb AS (SELECT h.*, CASE WHEN q.ts - h.w <= {9 * SEC} THEN q.ybid ELSE h.ybid END AS fbid,
  CASE WHEN q.ts - h.w <= {9 * SEC} THEN q.yask ELSE h.yask END AS fask
  FROM want h ASOF LEFT JOIN scored q ON h.ticker = q.ticker AND h.w <= q.ts),
en AS (SELECT *, CASE WHEN side_yes = 1 THEN yask ELSE 1 - ybid END AS ask,
  CASE WHEN side_yes = 1 THEN coalesce(fask, yask) ELSE 1 - coalesce(fbid, ybid) END AS late FROM fb),
ent AS (SELECT *, CASE WHEN late > ask + 0.01::DOUBLE + 1e-9 THEN 'missed' WHEN late >= 0.99::DOUBLE THEN 'skipped' ELSE 'filled' END AS status,
  late + 0.07::DOUBLE * late * (1 - late) AS cost FROM en)"""


def entered(spark, sf):
    from tickloom.operators.asof import asof_join
    quotes = scored(spark, sf).select("ticker", "ts", "ybid", "yask")
    out = asof_join(hits(spark, sf), quotes, by=["ticker"], at=F.col("ts") + 3 * SEC, tol=9 * SEC,
                    direction="forward", take={"ybid": "_b", "yask": "_a"}, chunk=DAY)
    out = out.withColumn("fill_bid", F.coalesce("_b", "ybid")).withColumn(
        "fill_ask", F.coalesce("_a", "yask"))
    return T.entries(out, chase=0.01)


@query("entry_prices", ENTRY + """
SELECT seq, status, round(late, 6) AS entry, round(late - ask, 6) + 0.0 AS slip, round(cost, 6) AS cost FROM ent""")
def entry_prices(spark, sf):
    return entered(spark, sf).select("seq", "status", *r6("entry", "slip", "cost"))


@query("hold_to_settlement", ENTRY + """
SELECT seq, CASE WHEN side_yes = outc THEN 1 ELSE 0 END AS won,
  round(CASE WHEN side_yes = outc THEN 1 ELSE 0 END - cost, 6) + 0.0 AS net FROM ent WHERE status = 'filled'""")
def hold_to_settlement(spark, sf):
    return T.settle_result(entered(spark, sf).filter("status = 'filled'")).select(
        "seq", "won", *r6("net"))


@query("move_episodes", f"""WITH {SCORED}{LOOK},
m AS (SELECT s.ticker, s.ts, s.seq, coalesce(abs(dfair), 0) AS a, dmid FROM scored s JOIN lk USING (ticker, seq)),
i AS (SELECT *, sum((a <= 0.05::DOUBLE)::INT) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT ticker, min(seq) AS seq FROM (SELECT ticker, isl, first_value(seq) OVER (PARTITION BY ticker, isl ORDER BY ts, seq) AS seq
  FROM i WHERE a >= 0.1::DOUBLE AND a > 0.05::DOUBLE AND dmid IS NOT NULL AND a >= 0.5::DOUBLE * abs(dmid)) GROUP BY ticker, isl""")
def move_episodes(spark, sf):
    rows = moved(scored(spark, sf))
    return T.move_crossings(rows, 0.1, dominance=0.5, rearm=0.5, chunk=DAY).select("ticker", "seq")


@query("closure_points", EPISODES + f""", cl AS (SELECT ticker, ts, fair, mid FROM scored WHERE abs(gap) < 0.01::DOUBLE),
c AS (SELECT h.ticker, h.seq, h.ts, h.fair, h.mid, c.ts AS close_ts, c.fair AS cf, c.mid AS cm
  FROM hits h ASOF LEFT JOIN cl c ON h.ticker = c.ticker AND h.ts < c.ts),
k AS (SELECT *, least(ts + {20 * SEC}, coalesce(close_ts, 1::BIGINT << 62)) AS at FROM c)
SELECT k.seq, close_ts, round(cf - k.fair, 6) + 0.0 AS close_dfair, round(cm - k.mid, 6) + 0.0 AS close_dmid,
  round(CASE WHEN q.ts > k.ts THEN q.mid - k.mid END, 6) + 0.0 AS cap_dmid, CASE WHEN q.ts > k.ts THEN q.ts - k.ts END AS cap_s
FROM k ASOF LEFT JOIN scored q ON k.ticker = q.ticker AND k.at >= q.ts""")
def closure_points(spark, sf):
    rows = T.closure_point(hits(spark, sf), scored(spark, sf), eps=0.01, cap=20 * SEC, chunk=DAY)
    return rows.select("seq", "close_ts", "cap_s", *r6("close_dfair", "close_dmid", "cap_dmid"))


@query("closure_at_cap", EPISODES + f""", cl AS (SELECT ticker, ts FROM scored WHERE abs(gap) < 0.01::DOUBLE),
c AS (SELECT h.*, least(h.ts + {20 * SEC}, coalesce(c.ts, 1::BIGINT << 62)) AS at
  FROM hits h ASOF LEFT JOIN cl c ON h.ticker = c.ticker AND h.ts < c.ts),
k AS (SELECT c.instrument, c.seq, c.outc = c.side_yes AS won, abs(c.gap) AS gap, 2 * c.side_yes - 1 AS sg,
    CASE WHEN c.outc = c.side_yes THEN 1 ELSE 0 END - CASE WHEN c.side_yes = 1 THEN c.yask ELSE 1 - c.ybid END AS net,
    CASE WHEN q.ts > c.ts THEN q.mid - c.mid END AS m, CASE WHEN q.ts > c.ts THEN q.fair - c.fair END AS f
  FROM c ASOF LEFT JOIN scored q ON c.ticker = q.ticker AND c.at >= q.ts),
x AS (SELECT *, CASE WHEN seq % 3 > 0 THEN f / 2 END AS fx FROM k)
SELECT instrument, count(*) AS trades, count(m) AS n, round(avg(100 * gap) FILTER (m IS NOT NULL), 6) AS gap0,
  round(avg(100 * sg * m), 6) + 0.0 AS mkt_move, round(avg(100 * sg * f), 6) + 0.0 AS fair_move, count(fx) AS n_fx,
  round(avg(100 * sg * fx), 6) + 0.0 AS fx_move, round(avg(100 * sg * (f - fx)), 6) + 0.0 AS refit_move,
  round(avg(net) FILTER (m IS NOT NULL AND won), 6) + 0.0 AS net_won,
  round(avg(net) FILTER (m IS NOT NULL AND NOT won), 6) + 0.0 AS net_lost,
  round(avg(100 * gap) FILTER (m IS NOT NULL) - (avg(100 * sg * m) - avg(100 * sg * f)), 6) + 0.0 AS residual
FROM x GROUP BY 1 HAVING count(m) > 0""")
def closure_at_cap(spark, sf):
    """Every third trade has no fair value under the entry calibration; half the move stands for it."""
    rows = T.closure_point(hits(spark, sf), scored(spark, sf), eps=0.01, cap=20 * SEC, chunk=DAY)
    yes = F.col("side_yes") == 1
    won = (F.col("outc") == F.col("side_yes")).cast("int")
    rows = rows.withColumns({
        "cap_dfair_fx": F.when(F.col("seq") % 3 > 0, F.col("cap_dfair") / 2), "won": won, "gap": F.abs("gap"),
        "net": won - F.when(yes, F.col("yask")).otherwise(1 - F.col("ybid"))})
    return R.capped_closure(rows, ["instrument"]).select("instrument", "trades", "n", "n_fx", *r6(
        "gap0", "mkt_move", "fair_move", "fx_move", "refit_move", "net_won", "net_lost", "residual"))


@query("persistent_gaps", f"""WITH {SCORED}, i AS (SELECT *, row_number() OVER w AS n FROM scored
  WINDOW w AS (PARTITION BY ticker ORDER BY ts, seq)),
z AS (SELECT *, n - coalesce(max(CASE WHEN abs(gap) < 0.04::DOUBLE THEN n END) OVER (PARTITION BY ticker ORDER BY ts, seq
  ROWS UNBOUNDED PRECEDING), 0) AS run FROM i)
SELECT seq, run >= 3 AS held FROM z""")
def persistent_gaps(spark, sf):
    return T.persistent(scored(spark, sf), 0.04, 3, chunk=DAY).select("seq", "held")


def revert_sql(persist: int, cap: int, min_tte: float) -> str:
    """The rule row by row. ``mode``: 0 armed, 1 waits, 2 holds, 3 over; ``e``: the open entry."""
    return f"""WITH RECURSIVE {SCORED}{LOOK},
r AS (SELECT s.*, delta, row_number() OVER (PARTITION BY s.ticker, delta ORDER BY ts, s.seq) AS n, dfair, dmid,
    CASE WHEN gap > 0 THEN yask ELSE 1 - ybid END AS entry, (gap > 0)::INT AS yes, tte_s AS tte
  FROM scored s JOIN lk USING (ticker, seq), (SELECT unnest([0.05, 0.1])::DOUBLE AS delta)),
w AS (
  SELECT DISTINCT ticker, delta, 0::BIGINT AS n, 0 AS mode, 0 AS run, 0 AS entered, 0::BIGINT AS e, NULL::BIGINT AS x, NULL::VARCHAR AS how FROM r
  UNION ALL
  SELECT ticker, delta, n,
    CASE WHEN mode = 0 THEN CASE WHEN NOT fires THEN 0 WHEN over THEN 3 WHEN entry >= 0.99 THEN 1 ELSE 2 END
         WHEN mode = 1 THEN CASE WHEN flat THEN 0 ELSE 1 END
         WHEN mode = 2 THEN CASE WHEN flat THEN 0 WHEN late THEN 1 ELSE 2 END ELSE 3 END,
    CASE WHEN mode = 0 AND NOT fires THEN lasts ELSE 0 END,
    CASE WHEN mode = 0 AND fires AND NOT over THEN entered + 1 ELSE entered END,
    CASE WHEN mode = 0 AND fires AND NOT over AND entry < 0.99 THEN n ELSE e END,
    CASE WHEN mode = 2 AND (flat OR late) THEN e END, CASE WHEN mode = 2 AND flat THEN 'revert' WHEN mode = 2 AND late THEN 'horizon' END
  FROM (SELECT *, lasts >= {persist} AS fires, tte <= {min_tte} OR entered >= {cap} AS over FROM (
    SELECT r.ticker, r.delta, r.n, r.entry, r.tte, w.mode, w.entered, w.e, abs(r.gap) <= 0.02::DOUBLE AS flat,
      CASE WHEN abs(r.gap) >= r.delta THEN w.run + 1 ELSE 0 END AS lasts, r.ts - o.ts >= {24 * SEC} AS late
    FROM w JOIN r ON r.ticker = w.ticker AND r.delta = w.delta AND r.n = w.n + 1
    LEFT JOIN r o ON o.ticker = w.ticker AND o.delta = w.delta AND o.n = w.e))),
z AS (SELECT ticker, delta, max(n) AS n FROM w GROUP BY ALL),
done AS (SELECT ticker, delta, x AS e, n AS j, how FROM w WHERE how IS NOT NULL
  UNION ALL SELECT ticker, delta, e, NULL, 'settle' FROM w JOIN z USING (ticker, delta, n) WHERE mode = 2),
trades AS (SELECT d.how, i.*, o.ts AS exit_ts, i.entry + 0.07::DOUBLE * i.entry * (1 - i.entry) AS cost, (i.outc = i.yes)::INT AS paid,
    CASE WHEN i.yes = 1 THEN o.ybid ELSE 1 - o.yask END AS sell, CASE WHEN i.yes = 1 THEN o.yask ELSE 1 - o.ybid END AS rest
  FROM done d JOIN r i ON i.ticker = d.ticker AND i.delta = d.delta AND i.n = d.e
  LEFT JOIN r o ON o.ticker = d.ticker AND o.delta = d.delta AND o.n = d.j)
SELECT delta, ticker, seq, yes AS side_yes, outc AS won, exit_ts, exit_ts - ts AS hold, how, round(entry, 6) + 0.0 AS entry,
  round(abs(gap), 6) + 0.0 AS gap, round(dfair, 6) + 0.0 AS dfair, round(dmid, 6) + 0.0 AS dmid, round(tte, 6) + 0.0 AS tte_s,
  round(CASE WHEN how = 'settle' THEN paid - cost ELSE sell - 0.07::DOUBLE * sell * (1 - sell) - cost END, 6) + 0.0 AS ret_taker,
  round(CASE WHEN how = 'settle' THEN paid - cost ELSE rest - cost END, 6) + 0.0 AS ret_maker FROM trades"""


def reverted(spark, sf, **rule):
    out = T.revert_trades(moved(scored(spark, sf)), [0.05, 0.1], eps=0.02, horizon=24 * SEC, chunk=DAY // 4,
                          keep=["tte_s", "dfair", "dmid"], **rule)
    return out.select("delta", "ticker", "seq", "side_yes", "won", "exit_ts", "hold", "how",
                      *r6("entry", "gap", "dfair", "dmid", "tte_s", "ret_taker", "ret_maker"))


@query("revert_exits", revert_sql(1, 1 << 30, -1.0))
def revert_exits(spark, sf):
    return reverted(spark, sf)


@query("revert_exits_gated", revert_sql(2, 3, 120.0))
def revert_exits_gated(spark, sf):
    """Entries that two rows confirm, three of an event at most, none in its last two minutes."""
    return reverted(spark, sf, persist=2, cap=3, min_tte=120.0)


def maker_sql(rest: str) -> str:
    return EPISODES + f""", l AS (SELECT *, CASE WHEN side_yes = 1 THEN ybid ELSE 1 - yask END AS lim FROM hits),
f AS (SELECT l.seq, min(q.ts) AS fill_ts FROM l JOIN scored q ON q.ticker = l.ticker AND q.ts > l.ts{rest}
  WHERE CASE WHEN side_yes = 1 THEN q.yask <= lim + 1e-9 ELSE 1 - q.ybid <= lim + 1e-9 END GROUP BY 1)
SELECT l.seq, round(lim, 6) AS limit_px, fill_ts FROM l LEFT JOIN f USING (seq) WHERE lim > 0.005::DOUBLE"""


@query("maker_entries", maker_sql(f" AND q.ts <= l.ts + {12 * SEC}"))
def maker_entries(spark, sf):
    rows = T.maker_entries(hits(spark, sf), scored(spark, sf), rest=12 * SEC, chunk=DAY // 4)
    return rows.select("seq", F.round("limit", 6).alias("limit_px"), "fill_ts")


@query("maker_entries_to_settlement", maker_sql(""))
def maker_entries_to_settlement(spark, sf):
    rows = T.maker_entries(hits(spark, sf), scored(spark, sf), rest=None, chunk=DAY // 4)
    return rows.select("seq", F.round("limit", 6).alias("limit_px"), "fill_ts")


# ── ledger ───────────────────────────────────────────────────────────────────
def ledger_sql(entries: str) -> str:
    """Recursion over ``entries`` (signed fills): a fill that oversells is refused by itself."""
    return f"""WITH RECURSIVE {entries},
f AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) AS n,
  CASE WHEN side = 'Buy' THEN sign * qty ELSE -sign * qty END AS d, sign * (qty * px) AS v, sign * fee AS c FROM entries),
w AS (
  SELECT DISTINCT instrument, 0::BIGINT AS n, 0::BIGINT AS ts, 0::BIGINT AS seq, false AS bad, 0.0::DOUBLE AS q, 0.0::DOUBLE AS cost,
    0.0::DOUBLE AS realized, 0.0::DOUBLE AS fees, 0.0::DOUBLE AS cash, []::VARCHAR[] AS refused FROM f
  UNION ALL
  SELECT instrument, n, ts, seq, bad, CASE WHEN act THEN greatest(q + d, 0) ELSE q END,
    CASE WHEN act AND side = 'Buy' AND q + d > 1e-6 THEN (q * cost + v + c) / (q + d) ELSE cost END,
    CASE WHEN act AND side = 'Sell' THEN realized + v - sign * qty * cost - c ELSE realized END,
    CASE WHEN act THEN fees + c ELSE fees END,
    CASE WHEN NOT act THEN cash WHEN side = 'Buy' THEN cash - v - c ELSE cash + v - c END,
    CASE WHEN bad AND sign > 0 THEN list_append(refused, venue_trade_id) ELSE refused END
  FROM (SELECT *, NOT skip AND NOT bad AS act FROM (SELECT *, NOT skip AND round(q + d, 6) < -1e-6 AS bad FROM (
    SELECT f.*, w.q, w.cost, w.realized, w.fees, w.cash, w.refused,
      sign < 0 AND list_contains(w.refused, f.venue_trade_id) AS skip
    FROM w JOIN f ON f.instrument = w.instrument AND f.n = w.n + 1))))"""


LEDGER = ledger_sql(FILLS + ", entries AS (SELECT *, 1.0::DOUBLE AS sign FROM fills)")


def ledger(spark, sf):
    return T.position_ledger(fills(spark, sf), chunk=2 * 365 * DAY)


@query("position_ledger", LEDGER + """
SELECT instrument, seq, round(q, 6) AS qty_after, round(cost, 8) AS avg_cost,
  round(realized, 6) + 0.0 AS realized, round(fees, 6) AS fees_paid, round(cash, 6) + 0.0 AS cash, bad AS violation FROM w WHERE n > 0""")
def position_ledger(spark, sf):
    return ledger(spark, sf).select("instrument", "seq", "violation", F.round("avg_cost", 8).alias("avg_cost"),
                                    *r6("qty_after", "realized", "fees_paid", "cash"))


@query("daily_ledger_totals", LEDGER + """, d AS (SELECT *, lag(realized) OVER p AS pr, lag(fees) OVER p AS pf, lag(cash) OVER p AS pc
  FROM w WHERE n > 0 WINDOW p AS (PARTITION BY instrument ORDER BY ts, seq))
SELECT strftime(make_timestamp(ts), '%Y-%m-%d') AS date, round(sum(realized - coalesce(pr, 0)), 6) + 0.0 AS realized,
  round(sum(fees - coalesce(pf, 0)), 6) + 0.0 AS fees, round(sum(cash - coalesce(pc, 0)), 6) + 0.0 AS cash, count(*) AS n FROM d GROUP BY 1""")
def daily_ledger_totals(spark, sf):
    out = T.daily_totals(ledger(spark, sf), fills(spark, sf), chunk=2 * 365 * DAY)
    return out.select("date", "n", *r6("realized", "fees", "cash"))


REPORTS = FILLS + """, rep AS (SELECT venue_trade_id, seq, side, qty, px, fee, ts, instrument, unnest(CASE order_id % 4 WHEN 0 THEN ['Matched', 'Confirmed']
  WHEN 1 THEN ['Matched', 'Failed'] WHEN 2 THEN ['Failed', 'Confirmed', 'Confirmed'] ELSE ['Failed'] END) AS status,
  unnest(CASE order_id % 4 WHEN 2 THEN [0, 1, 2] WHEN 3 THEN [0] ELSE [0, 1] END) AS i FROM fills)"""
ENTRIES = REPORTS + """, g AS (SELECT *, status <> 'Failed' AS good,
  lag(status <> 'Failed') OVER (PARTITION BY venue_trade_id ORDER BY i) AS was FROM rep),
entries AS (SELECT * REPLACE (ts + i AS ts), CASE WHEN good THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM g
  WHERE (good AND NOT coalesce(was, false)) OR (NOT good AND coalesce(was, false)))"""


def fill_reports(spark, sf):
    f = fills(spark, sf)
    k = F.col("order_id") % 4
    arr = lambda *s: F.array(*[F.lit(x) for x in s])
    steps = F.when(k == 0, arr("Matched", "Confirmed")).when(k == 1, arr("Matched", "Failed")).when(
        k == 2, arr("Failed", "Confirmed", "Confirmed")).otherwise(arr("Failed"))
    rows = f.select("*", F.posexplode(steps).alias("i", "status"))
    return rows.withColumn("ts", F.col("ts") + F.col("i"))


@query("effective_fills", f"""WITH {REPORTS}, g AS (SELECT *, status <> 'Failed' AS good,
  lag(status <> 'Failed') OVER (PARTITION BY venue_trade_id ORDER BY i) AS was FROM rep)
SELECT venue_trade_id, i::INTEGER AS i, CASE WHEN good THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM g
WHERE (good AND NOT coalesce(was, false)) OR (NOT good AND coalesce(was, false))""")
def effective_fills(spark, sf):
    return T.effective_fills(fill_reports(spark, sf)).select("venue_trade_id", "i", "sign")


@query("ledger_with_reversals", ledger_sql(ENTRIES) + """
SELECT instrument, seq, bad AS violation, round(q, 6) AS qty_after, round(cost, 6) AS avg_cost, round(realized, 6) + 0.0 AS realized,
  round(cash, 6) + 0.0 AS cash FROM w WHERE n > 0""")
def ledger_with_reversals(spark, sf):
    entries = T.effective_fills(fill_reports(spark, sf))
    return T.position_ledger(entries, chunk=2 * 365 * DAY).select(
        "instrument", "seq", "violation", *r6("qty_after", "avg_cost", "realized", "cash"))


POS = """pos AS (SELECT 'kalshi.M' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.YES' ELSE '.NO' END AS instrument,
  epoch_us(o_orderdate) AS ts, CAST(o_orderkey % 7 AS DOUBLE) AS qty, 0.4::DOUBLE + (o_orderkey % 10) / 50.0::DOUBLE AS avg_cost,
  o_orderkey AS id, o_custkey AS m FROM orders)"""


def positions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("kalshi.M"), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, ".YES")
                 .otherwise(".NO")).alias("instrument"),
        micros("o_orderdate").alias("ts"), (k % 7).cast("double").alias("qty"),
        (0.4 + (k % 10) / 50.0).alias("avg_cost"), k.alias("id"), F.col("o_custkey").alias("m"))


def winners(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").filter(c % 5 != 0).select(F.concat(
        F.lit("kalshi.M"), c.cast("string"), F.when(c % 3 == 0, ".YES").otherwise(".NO")).alias("winner"))


@query("settlement_payouts", f"""WITH {POS}
SELECT id, CASE WHEN (m % 3 = 0) = (id % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS payout,
  round(qty * (CASE WHEN (m % 3 = 0) = (id % 2 = 0) THEN 1 ELSE 0 END - avg_cost), 6) + 0.0 AS settle_pnl
FROM pos JOIN customer ON c_custkey = m WHERE m % 5 <> 0 AND qty > 0""")
def settlement_payouts(spark, sf):
    return T.settle_positions(positions(spark, sf), winners(spark, sf)).select(
        "id", "payout", *r6("settle_pnl"))


@query("market_facts_for_either_side", f"""WITH {POS}
SELECT id, c_acctbal AS strike FROM pos LEFT JOIN customer ON c_custkey = m AND c_custkey % 4 = 0""")
def market_facts_for_either_side(spark, sf):
    c = F.col("c_custkey")
    meta = table(spark, sf, "customer").filter(c % 4 == 0).select(F.concat(
        F.lit("kalshi.M"), c.cast("string"), F.lit(".YES")).alias("instrument"),
        F.col("c_acctbal").alias("strike"))
    return T.join_market(positions(spark, sf), meta).select("id", "strike")


TOPS = TICKS + """, top AS (SELECT instrument, ts, seq, 0.3::DOUBLE + k / 250.0::DOUBLE AS bid, 0.31::DOUBLE + k / 250.0::DOUBLE AS ask FROM ticks)"""


def tops(spark, sf):
    return ticks(spark, sf).select("instrument", "ts", "seq", (0.3 + F.col("k") / 250.0).alias("bid"),
                                   (0.31 + F.col("k") / 250.0).alias("ask"))


def probe_rows(spark, sf):
    """Instants of interest: every tick, shifted off the quote times."""
    return ticks(spark, sf).select(
        "instrument", (F.col("ts") + MINUTE).alias("ts"), F.col("seq").alias("id"),
        (F.col("k") % 9 + 1).cast("double").alias("qty"))


PROBES = f""", pb AS (SELECT instrument, ts + {MINUTE} AS ts, seq AS id, (k % 9 + 1)::DOUBLE AS qty FROM ticks)"""


@query("mark_to_bid", f"""WITH {TOPS}{PROBES}
SELECT id, round(bid, 6) AS mark, round(CASE WHEN bid IS NOT NULL THEN qty * (bid - 0.4::DOUBLE) ELSE 0 END, 6) + 0.0 AS upnl
FROM pb ASOF LEFT JOIN top ON pb.instrument = top.instrument AND pb.ts >= top.ts""")
def mark_to_bid(spark, sf):
    p = probe_rows(spark, sf).withColumn("avg_cost", F.lit(0.4))
    return T.mark_positions(p, tops(spark, sf), chunk=2 * DAY).select("id", *r6("mark", "upnl"))


@query("pre_signal_ask_move", f"""WITH {TOPS}{PROBES}, w AS (SELECT *, ts - {3 * HOUR} AS want FROM pb),
a AS (SELECT w.*, t.ask AS a1 FROM w ASOF LEFT JOIN top t ON w.instrument = t.instrument AND w.ts >= t.ts)
SELECT id, round((a1 - t.ask) * 100, 6) + 0.0 AS pre_move_c FROM a ASOF LEFT JOIN top t ON a.instrument = t.instrument AND a.want >= t.ts""")
def pre_signal_ask_move(spark, sf):
    return T.ask_move(probe_rows(spark, sf), tops(spark, sf), pre=3 * HOUR, chunk=2 * DAY).select(
        "id", *r6("pre_move_c"))


@query("maker_exit_shadow", f"""WITH {TOPS}{PROBES}, s AS (SELECT pb.*, t.bid AS bid0, t.ask + CASE WHEN id % 3 = 0 THEN -0.02::DOUBLE ELSE 0 END AS offer,
    pb.ts + {4 * HOUR} AS fin FROM pb ASOF JOIN top t ON pb.instrument = t.instrument AND pb.ts >= t.ts),
h AS (SELECT s.id, count(t.ts) AS c FROM s LEFT JOIN top t ON t.instrument = s.instrument AND t.ts > s.ts AND t.ts <= s.fin
  AND t.bid * 100 >= ceil(round(offer * 100, 6)) - 1e-6 GROUP BY 1),
e AS (SELECT s.*, h.c, t.bid AS fin_bid FROM s JOIN h USING (id) ASOF LEFT JOIN top t ON s.instrument = t.instrument AND s.fin >= t.ts),
o AS (SELECT *, CASE WHEN bid0 >= offer - 1e-9 THEN 'reject' WHEN c > 0 THEN 'maker_fill' ELSE 'timeout' END AS outcome FROM e),
x AS (SELECT *, CASE outcome WHEN 'reject' THEN bid0 WHEN 'maker_fill' THEN offer ELSE fin_bid END AS crs FROM o)
SELECT id, outcome, round(crs, 6) AS cross_px, round((CASE WHEN outcome = 'maker_fill' THEN offer ELSE crs - 0.07::DOUBLE * crs * (1 - crs) END
  - (bid0 - 0.07::DOUBLE * bid0 * (1 - bid0))) * 100, 6) + 0.0 AS gain_c FROM x""")
def maker_exit_shadow(spark, sf):
    from tickloom.operators.asof import asof_join
    t = tops(spark, sf)
    p = asof_join(probe_rows(spark, sf), t, by=["instrument"], take={"bid": "bid0", "ask": "_a"},
                  chunk=2 * DAY).filter(F.col("bid0").isNotNull())
    p = p.withColumn("offer", F.col("_a") + F.when(F.col("id") % 3 == 0, -0.02).otherwise(0.0))
    out = T.maker_exit(p, t, rest=4 * HOUR, rate=0.07, chunk=2 * DAY, ident=["id"])
    return out.select("id", "outcome", F.round("cross", 6).alias("cross_px"), *r6("gain_c"))


@query("expiry_cleanup", f"""WITH {TOPS}{PROBES}, e AS (SELECT *, ts + {9 * HOUR} - {3 * HOUR} AS at FROM pb)
SELECT id, least(5, qty)::DOUBLE AS sold, round(bid, 6) AS px, round(0.07::DOUBLE * bid * (1 - bid) * least(5, qty), 6) AS fee
FROM e ASOF JOIN top t ON e.instrument = t.instrument AND e.at >= t.ts""")
def expiry_cleanup(spark, sf):
    p = probe_rows(spark, sf).withColumn("expiry", F.col("ts") + 9 * HOUR).withColumn("wanted", F.lit(5.0))
    return T.expiry_cleanup(p, tops(spark, sf), window=3 * HOUR, rate=0.07, chunk=2 * DAY).select(
        "id", "sold", *r6("px", "fee"))


def ladders(spark, sf):
    """Three-level books at every tick."""
    b, a = 0.3 + F.col("k") / 250.0, 0.31 + F.col("k") / 250.0
    side = lambda p, s: F.array(*[L.level(p + s * i * 0.02, F.lit(3.0 + i)) for i in range(3)])
    return ticks(spark, sf).select("instrument", "ts", "seq", side(b, -1).alias("bids"),
                                   side(a, 1).alias("asks"))


def sweep_sql(qty, px, sign):
    """Quantity-weighted price over levels of 3, 4 and 5, two cents apart."""
    return (f"((least({qty}, 3) * {px} + greatest(least({qty} - 3, 4), 0) * ({px} + {sign} * 0.02::DOUBLE) "
            f"+ greatest(least({qty} - 7, 5), 0) * ({px} + {sign} * 0.04::DOUBLE)) / {qty})")


@query("hold_offset_returns", f"""WITH {TOPS}{PROBES}, o AS (SELECT pb.*, h, ts + h * {HOUR} AS at FROM pb, (SELECT unnest([1, 3, 9]) AS h)),
x AS (SELECT id, h, qty, {sweep_sql('qty', 'bid', '-1')} AS ex FROM o ASOF JOIN top t ON o.instrument = t.instrument AND o.at >= t.ts)
SELECT id AS trade_id, h AS hold_ms, round(ex, 6) AS exit, round((ex - 0.4::DOUBLE) * 100, 6) + 0.0 AS gross_c,
  round((ex - 0.4::DOUBLE - 0.07::DOUBLE * ex * (1 - ex) - 0.07::DOUBLE * 0.4::DOUBLE * 0.6::DOUBLE) * 100, 6) + 0.0 AS net_c FROM x""")
def hold_offset_returns(spark, sf):
    p = probe_rows(spark, sf).withColumn("entry", F.lit(0.4)).withColumnRenamed("id", "trade_id")
    out = T.hold_returns(p, ladders(spark, sf), {1: HOUR, 3: 3 * HOUR, 9: 9 * HOUR}, rate=0.07, chunk=2 * DAY)
    return out.select("trade_id", "hold_ms", *r6("exit", "gross_c", "net_c"))


@query("price_path_after_signal", f"""WITH {TOPS}{PROBES}, o AS (SELECT pb.*, off, ts + off AS at FROM pb,
  (SELECT unnest([0, {HOUR}, {6 * HOUR}]) AS off))
SELECT id AS signal_id, off AS offset_us, round((bid + ask) / 2, 6) AS mid, round(((bid + ask) / 2 - 0.5::DOUBLE) * 100, 6) + 0.0 AS dmid_c,
  12.0::DOUBLE AS bid_depth, 3::INTEGER AS ask_levels FROM o ASOF JOIN top t ON o.instrument = t.instrument AND o.at >= t.ts""")
def price_path_after_signal(spark, sf):
    p = probe_rows(spark, sf).select(F.col("id").alias("signal_id"), "instrument", "ts",
                                     F.lit(0.5).alias("ref_mid"), F.lit(0.5).alias("ref_ask"))
    out = T.price_path(p, ladders(spark, sf), [0, HOUR, 6 * HOUR], chunk=2 * DAY)
    return out.select("signal_id", F.col("offset").alias("offset_us"), "bid_depth", "ask_levels",
                      *r6("mid", "dmid_c"))


@query("entry_attempts", f"""WITH {TOPS}{PROBES}, o AS (SELECT pb.*, i, ts + i * {2 * HOUR} AS at0, ts + (i + 1) * {2 * HOUR} AS at1
  FROM pb, (SELECT unnest([0, 1, 2]) AS i)),
a AS (SELECT o.*, t.ask AS seen FROM o ASOF LEFT JOIN top t ON o.instrument = t.instrument AND o.at0 >= t.ts),
b AS (SELECT a.*, t.ask AS met FROM a ASOF LEFT JOIN top t ON a.instrument = t.instrument AND a.at1 >= t.ts),
l AS (SELECT *, CASE WHEN met <= seen + 0.05::DOUBLE + 1e-6 THEN 3 ELSE 0 END + CASE WHEN met + 0.02::DOUBLE <= seen + 0.05::DOUBLE + 1e-6 THEN 4 ELSE 0 END
    + CASE WHEN met + 0.04::DOUBLE <= seen + 0.05::DOUBLE + 1e-6 THEN 5 ELSE 0 END AS avail FROM b),
x AS (SELECT *, least(qty, avail)::DOUBLE AS got FROM l),
y AS (SELECT *, CASE WHEN got > 0 THEN {sweep_sql('got', 'met', '1')} END AS vw FROM x)
SELECT id, round(max(((CASE WHEN got > 0 THEN vw ELSE met END) - 0.5::DOUBLE) * 100) FILTER (i = 0), 6) + 0.0 AS drift_c,
  min(i) FILTER (got > 0)::INTEGER AS attempt, round(arg_min(got, i) FILTER (got > 0), 6) AS qty, round(arg_min(vw, i) FILTER (got > 0), 6) AS vwap
FROM y GROUP BY id""")
def entry_attempts(spark, sf):
    p = probe_rows(spark, sf).select("id", "instrument", "ts", F.col("qty").alias("size"),
                                     F.lit(0.5).alias("signal_ask"))
    out = T.chase_entries(p, ladders(spark, sf), chase=0.05, delays=[0, 2 * HOUR, 4 * HOUR, 6 * HOUR],
                          rate=0.07, chunk=2 * DAY)
    return out.select("id", "attempt", *r6("drift_c", "qty", "vwap"))


@query("translated_closes", """
SELECT o_orderkey || '-cl' || o_orderkey AS venue_trade_id, 'kalshi.M' || o_custkey || '.NO' AS instrument, 'Sell' AS side,
  round(1 - (o_orderkey % 100) / 100.0::DOUBLE, 6) AS px FROM orders""")
def translated_closes(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        k.cast("string").alias("order_id"), k.alias("seq"), F.concat(
            F.lit("kalshi.M"), F.col("o_custkey").cast("string"), F.lit(".YES")).alias("instrument"),
        F.lit(1.0).alias("qty"), (k % 100 / 100.0).alias("px"), micros("o_orderdate").alias("ts"))
    return T.translate_closes(o).select("venue_trade_id", "instrument", "side", *r6("px"))


def orders_sent(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").filter(k % 6 != 0).select(
        k.alias("order_id"), F.concat_ws(":", F.concat(F.lit("T"), F.col("o_custkey").cast("string")),
                                         F.lit("E"), (k % 3).cast("string")).alias("client_id"))


def sent_signals(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").filter(c % 2 == 0).select(
        F.concat(F.lit("T"), c.cast("string")).alias("trade_id"), F.col("c_acctbal").alias("edge"))


@query("fill_attribution", f"""WITH {FILLS}
SELECT venue_trade_id, 'T' || o_custkey AS trade_id, 'E' AS leg, CAST(o_orderkey % 3 AS INTEGER) AS attempt, c_acctbal AS edge
FROM fills JOIN orders ON o_orderkey = order_id LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 WHERE o_orderkey % 6 <> 0""")
def fill_attribution(spark, sf):
    f = fills(spark, sf).select("venue_trade_id", "order_id")
    return T.attribute_fills(f, orders_sent(spark, sf), sent_signals(spark, sf)).select(
        "venue_trade_id", "trade_id", "leg", "attempt", "edge")


@query("fills_without_order", f"""WITH {FILLS}
SELECT venue_trade_id FROM fills WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = order_id AND o_orderkey % 6 <> 0)""")
def fills_without_order(spark, sf):
    return T.lost_acks(fills(spark, sf), orders_sent(spark, sf)).select("venue_trade_id")


@query("venue_position_audit", f"""WITH {FILLS}, o AS (SELECT market_id, sum(CASE WHEN side = 'Buy' THEN qty ELSE -qty END) AS net FROM fills GROUP BY 1),
v AS (SELECT s_suppkey AS market_id, coalesce((SELECT net FROM o WHERE o.market_id = s_suppkey), 0) + CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS net
  FROM supplier WHERE s_suppkey % 13 <> 0)
SELECT coalesce(o.market_id, v.market_id) AS market_id, round(coalesce(o.net, 0) - coalesce(v.net, 0), 6) + 0.0 AS diff
FROM o FULL JOIN v ON o.market_id = v.market_id WHERE abs(coalesce(o.net, 0) - coalesce(v.net, 0)) > 1e-6""")
def venue_position_audit(spark, sf):
    signed = F.when(F.col("side") == "Buy", F.col("qty")).otherwise(-F.col("qty"))
    ours = fills(spark, sf).groupBy("market_id").agg(F.sum(signed).alias("net"))
    s = F.col("s_suppkey")
    venue = (table(spark, sf, "supplier").filter(s % 13 != 0).select(s.alias("market_id"))
             .join(ours, "market_id", "left").select("market_id", (
                 F.coalesce("net", F.lit(0.0)) + F.when(F.col("market_id") % 10 == 0, 1.0).otherwise(0.0))
                 .alias("net")))
    return T.audit_positions(ours, venue).select("market_id", *r6("diff"))


@query("conflicting_fill_reports", """
SELECT l_orderkey || '-' || l_linenumber AS venue_trade_id, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty FROM lineitem
GROUP BY 1 HAVING min(l_quantity) <> max(l_quantity) OR min(l_extendedprice) <> max(l_extendedprice)""")
def conflicting_fill_reports(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("venue_trade_id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("px"))
    return T.conflicting_fills(li).select("venue_trade_id", "min_qty", "max_qty")


@query("signal_funnel", """WITH s AS (SELECT o_orderkey AS k, CASE
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 3) THEN 'filled'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'attempted'
  WHEN o_orderkey % 2 = 0 THEN 'rejected: ' || o_orderpriority ELSE 'unexplained' END AS stage FROM orders)
SELECT stage, count(*) AS n FROM s GROUP BY 1""")
def signal_funnel(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sig = o.select(F.col("o_orderkey").alias("trade_id"))
    rejects = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("trade_id"),
                                                    F.col("o_orderpriority").alias("reason"))
    tried = li.select(F.col("l_orderkey").alias("trade_id"))
    done = li.filter("l_linenumber > 3").select(F.col("l_orderkey").alias("trade_id"))
    return T.signal_funnel(sig, rejects, tried, done)


@query("latency_per_signal", f"""WITH {TICKS}
SELECT seq, round(px, 6) AS latency_us, k FROM ticks""")
def latency_per_signal(spark, sf):
    t = ticks(spark, sf)
    key = dict(strategy=F.lit("s"), target=F.col("instrument"))
    samples = t.select(F.col("ts").alias("origin_ts_ns"), key["strategy"].alias("strategy"),
                       key["target"].alias("target"), F.col("px").alias("latency_us"), "seq")
    signals = t.select(F.col("ts").alias("ts_ns"), key["strategy"].alias("strategy"),
                       key["target"].alias("target"), "k")
    return T.latency_of_signals(samples, signals).select("seq", "k", *r6("latency_us"))


@query("rate_limited_signals", f"""WITH RECURSIVE {TICKS}, r AS (SELECT user_id, ts, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM ticks),
w AS (SELECT user_id, n, seq, true AS accepted, [ts] AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.seq, len(list_filter(w.kept, lambda x : x >= r.ts - {12 * HOUR})) < 2,
    CASE WHEN len(list_filter(w.kept, lambda x : x >= r.ts - {12 * HOUR})) < 2
      THEN list_append(list_filter(w.kept, lambda x : x >= r.ts - {12 * HOUR}), r.ts) ELSE list_filter(w.kept, lambda x : x >= r.ts - {12 * HOUR}) END
  FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, seq, accepted FROM w""")
def rate_limited_signals(spark, sf):
    t = ticks(spark, sf).select("user_id", "ts", "seq")
    return T.rate_limited(t, limit=2, span=12 * HOUR, by=["user_id"], chunk=5 * DAY)


@query("throttled_ticks", f"""WITH RECURSIVE {TICKS}, r AS (SELECT user_id, ts, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM ticks),
w AS (SELECT user_id, n, seq, ts, ts AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.seq, r.ts, CASE WHEN r.ts - w.kept >= {8 * HOUR} THEN r.ts ELSE w.kept END FROM w JOIN r
  ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, seq FROM w WHERE ts = kept""")
def throttled_ticks(spark, sf):
    t = ticks(spark, sf).select("user_id", "ts", "seq")
    return folds.refractory(t, by=["user_id"], ts="ts", gap=8 * HOUR, chunk=10 * DAY,
                            sparse=False).select("user_id", "seq")


@query("trade_records", f"""WITH {FILLS}, b AS (SELECT order_id, sum(qty) AS q, sum(qty * px) / sum(qty) AS v, sum(fee) AS f, min(ts) AS t0 FROM fills WHERE side = 'Buy' GROUP BY 1),
s AS (SELECT order_id, sum(qty) AS q, sum(qty * px) / sum(qty) AS v, sum(fee) AS f, max(ts) AS t1 FROM fills WHERE side = 'Sell' GROUP BY 1)
SELECT b.order_id AS trade_id, round(coalesce(s.q * s.v, 0) - b.q * b.v, 6) + 0.0 AS pnl_gross,
  round(coalesce(s.q * s.v - s.f, 0) - b.q * b.v - b.f, 6) + 0.0 AS pnl_net, round((b.v - 0.5::DOUBLE) * 100, 6) + 0.0 AS slippage_entry_c,
  round(CASE WHEN coalesce(s.q, 0) > 0 THEN (0.45::DOUBLE - s.v) * 100 ELSE 0 END, 6) + 0.0 AS slippage_exit_c,
  CASE WHEN b.q - coalesce(s.q, 0) <= 1e-6 THEN 'Closed' ELSE 'PendingResolution' END AS outcome
FROM b LEFT JOIN s USING (order_id)""")
def trade_records(spark, sf):
    f = fills(spark, sf).withColumn("trade_id", F.col("order_id"))
    plans = f.select("trade_id").distinct().select(
        "trade_id", F.lit(0.5).alias("signal_ask"), F.lit(0.45).alias("exit_ref_bid"),
        F.lit(0).cast("long").alias("signal_ts"))
    entry = T.leg_summary(f.filter("side = 'Buy'"), ["trade_id"])
    exit_ = T.leg_summary(f.filter("side = 'Sell'"), ["trade_id"])
    return T.trade_record(plans, entry, exit_, unit_ms=1000).select("trade_id", "outcome", *r6(
        "pnl_gross", "pnl_net", "slippage_entry_c", "slippage_exit_c"))


# ── surface ──────────────────────────────────────────────────────────────────
SMALL = U.seeded_model(channels=2, extras=("gap",), hidden=3, rho=1.5)


def surface_sql(m, px, tte, strike, db, dr, extras):
    """The network written out, for a hidden width of a few units."""
    tau = f"least(greatest({tte} / 900, 1e-4), 1)"
    b = f"({strike} + {m.b_scale!r}::DOUBLE * {db})"
    h = [f"((({p} - {b}) / exp({r!r}::DOUBLE + {dr})) / sqrt({tau}))" for p, r in zip(px, m.rhos)]
    h.append(f"ln({tau})")
    h += [f"least(greatest(({x} - {mu!r}::DOUBLE) / {sd!r}::DOUBLE, -5), 5)"
          for x, mu, sd in zip(extras, m.mu, m.sd)]
    text = "SELECT *, " + ", ".join(f"{e} AS h0_{i}" for i, e in enumerate(h)) + " FROM src"
    n = len(h)
    for layer, (w, bias) in enumerate(m.layers, start=1):
        cols = []
        for j, (row, c) in enumerate(zip(w, bias)):
            dot = " + ".join(f"{float(v)!r}::DOUBLE * h{layer - 1}_{i}" for i, v in enumerate(row))
            e = f"{float(c)!r}::DOUBLE + {dot}"
            cols.append(f"{'tanh(' + e + ')' if layer < len(m.layers) else e} AS h{layer}_{j}")
        text = f"SELECT *, {', '.join(cols)} FROM ({text})"
        n = len(bias)
    return f"SELECT *, 1 / (1 + exp(-h{len(m.layers)}_0)) AS p FROM ({text})"


SRC = f"""{SCORED}, src AS (SELECT seq, ticker, ts, spot, spot + gap AS cb, tte_s, strike, gap, (seq % 7 - 3) / 500.0::DOUBLE AS d_b,
  (seq % 5 - 2) / 50.0::DOUBLE AS d_rho FROM scored)"""
SCORE_SQL = f"WITH {SRC}, sc AS ({surface_sql(SMALL, ['spot', 'cb'], 'tte_s', 'strike', 'd_b', 'd_rho', ['gap'])})"


def with_event_params(spark, sf):
    s = F.col("seq")
    return scored(spark, sf).drop("fair").withColumn("cb", F.col("spot") + F.col("gap")).withColumn(
        "d_b", (s % 7 - 3) / 500.0).withColumn("d_rho", (s % 5 - 2) / 50.0)


@query("surface_score", SCORE_SQL + " SELECT seq, round(p, 6) AS fair FROM sc")
def surface_score(spark, sf):
    return U.score(with_event_params(spark, sf), SMALL, px=["spot", "cb"]).select("seq", *r6("fair"))


@query("surface_score_columns", SCORE_SQL + " SELECT seq, round(p, 6) AS fair FROM sc")
def surface_score_columns(spark, sf):
    c = F.col
    lo = U.logit_column(SMALL, px=[c("spot"), c("cb")], tte=c("tte_s"), strike=c("strike"), d_b=c("d_b"),
                        d_rho=c("d_rho"), extras=[c("gap")])
    return with_event_params(spark, sf).select("seq", F.round(1 / (1 + F.exp(-lo)), 6).alias("fair"))


@query("fair_under_current_params", f"""WITH {SRC.replace(', src AS (', ', src0 AS (')}, w AS (SELECT *, ts - {SEC} AS want FROM src0),
src AS (SELECT w.seq, w.d_b, w.d_rho, q.spot, q.cb, q.tte_s, w.strike, q.gap FROM w ASOF JOIN src0 q ON w.ticker = q.ticker AND w.want >= q.ts
  WHERE w.want - q.ts <= {9 * SEC}),
sc AS ({surface_sql(SMALL, ['spot', 'cb'], 'tte_s', 'strike', 'd_b', 'd_rho', ['gap'])}) SELECT seq, round(p, 6) AS fair_then FROM sc""")
def fair_under_current_params(spark, sf):
    rows = T.with_lookback(with_event_params(spark, sf), ["spot", "cb", "tte_s", "gap"], second=SEC, chunk=DAY)
    rows = rows.filter(F.col("then_spot").isNotNull())
    return U.fair_at(rows, SMALL, px=["spot", "cb"]).select("seq", *r6("fair_then"))


ONE = U.seeded_model(channels=1, hidden=8, rho=1.5)


@query("event_calibration")
def event_calibration(spark, sf):
    samples = U.fit_samples(scored(spark, sf), second=SEC)
    return U.calibrate(samples, ONE, px=["spot"], tte_max=300, step=60, window=240.0, min_rows=10,
                       first_steps=150, refit_steps=60)


def stored_calibration(spark, sf):
    """One stored fit per order; every third comes from a wider model, every fifth names none."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), (k % 11 / 1000.0).alias("d_b"), F.when(k % 5 == 0, None).when(
            k % 3 == 0, U.identity(SMALL)).otherwise(U.identity(ONE)).alias("model_hash"))


@query("calibration_identity", """
SELECT o_orderkey AS id, round(o_orderkey % 11 / 1000.0::DOUBLE, 6) AS d_b FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""")
def calibration_identity(spark, sf):
    return U.own_calibration(stored_calibration(spark, sf), ONE).select("id", *r6("d_b"))


@query("causal_fair_series")
def causal_fair_series(spark, sf):
    rows = scored(spark, sf).drop("fair", "gap")
    return U.fair_series(rows, ONE, px=["spot"], second=SEC, tte_max=300, step=100, window=240.0,
                         min_rows=10, first_steps=150, refit_steps=60).select(
        "ticker", "seq", "boundary", *r6("fair", "gap"))


@query("demeaned_gap", f"""WITH {SCORED}, kept AS (SELECT *, ceil(tte_s / 100) * 100.0::DOUBLE AS boundary FROM scored WHERE tte_s <= 300),
seg AS (SELECT DISTINCT ticker, boundary, boundary / 50000 AS d_b, boundary / 2000 - 0.1::DOUBLE AS d_rho FROM kept),
grid AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY ticker, ts // {SEC} ORDER BY ts, seq) = 1),
src AS (SELECT 1 AS own, seq, ticker, boundary, d_b, d_rho, tte_s, spot, strike, mid FROM kept JOIN seg USING (ticker, boundary)
  UNION ALL SELECT 0, g.seq, g.ticker, s.boundary, s.d_b, s.d_rho, g.tte_s, g.spot, g.strike, g.mid FROM grid g JOIN seg s
    ON g.ticker = s.ticker AND g.tte_s > s.boundary - 100 AND g.tte_s <= s.boundary + 200),
sc AS ({surface_sql(ONE, ['spot'], 'tte_s', 'strike', 'd_b', 'd_rho', [])}),
g AS (SELECT own, seq, ticker, boundary, tte_s, p - mid AS gap FROM sc),
m AS (SELECT r.ticker, r.seq, r.gap, CASE WHEN count(h.gap) >= 5 THEN avg(h.gap) END AS gbar FROM g r LEFT JOIN g h
  ON h.own = 0 AND h.ticker = r.ticker AND h.boundary = r.boundary AND h.tte_s >= r.tte_s AND h.tte_s <= r.tte_s + 200
  WHERE r.own = 1 GROUP BY r.ticker, r.seq, r.gap)
SELECT ticker, seq, round(gap, 6) + 0.0 AS gap, round(gbar, 6) + 0.0 AS gbar, round(gap - gbar, 6) + 0.0 AS sig FROM m""")
def demeaned_gap(spark, sf):
    """Every segment has parameters of its own, so the look-back is scored anew for each."""
    rows = scored(spark, sf).drop("fair", "gap").withColumn("boundary", F.ceil(F.col("tte_s") / 100) * 100.0)
    rows = rows.filter("tte_s <= 300").withColumn("d_b", F.col("boundary") / 50000).withColumn(
        "d_rho", F.col("boundary") / 2000 - 0.1)
    series = U.score(rows, ONE, px=["spot"]).withColumn("gap", F.col("fair") - F.col("mid"))
    return U.demean(series, ONE, px=["spot"], second=SEC, window=200, step=100).select(
        "ticker", "seq", *r6("gap", "gbar", "sig"))


@query("training_gradient", f"""WITH {SCORED}, src AS (SELECT spot, tte_s, strike, 0.0::DOUBLE AS d_b, 0.0::DOUBLE AS d_rho, mid,
  1.0::DOUBLE / count(*) OVER (PARTITION BY ticker) AS w FROM scored),
sc AS ({surface_sql(ONE, ['spot'], 'tte_s', 'strike', 'd_b', 'd_rho', [])}),
l AS (SELECT w, least(greatest(mid, 0.01::DOUBLE), 0.99::DOUBLE) AS y, h{len(ONE.layers)}_0 AS lo FROM sc)
SELECT round(sum(w * (greatest(lo, 0) - lo * y + ln(1 + exp(-abs(lo))))) / sum(w), 6) AS loss,
  round(sum(w * (1 / (1 + exp(-lo)) - y)) / sum(w), 6) + 0.0 AS grad_last_bias FROM l""")
def training_gradient(spark, sf):
    from tickloom.operators.stats import event_weight
    rows = event_weight(scored(spark, sf), "ticker").withColumn("d_b", F.lit(0.0)).withColumn("d_rho", F.lit(0.0))
    loss, g = U.gradient(rows, ONE, px=["spot"])
    out = spark.createDataFrame([(float(loss), float(g[-1]))], "loss DOUBLE, grad_last_bias DOUBLE")
    return out.select(*r6("loss", "grad_last_bias"))


@query("event_slopes", f"""WITH {SCORED}, src AS (SELECT ticker, spot, tte_s, strike, mid, v.i,
  0.001::DOUBLE + v.b AS d_b, 0.01::DOUBLE + v.r AS d_rho, 1.0::DOUBLE / count(*) OVER (PARTITION BY ticker, v.i) AS w
  FROM scored, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1e-6::DOUBLE, 0.0::DOUBLE), (2, -1e-6::DOUBLE, 0.0::DOUBLE),
    (3, 0.0::DOUBLE, 1e-5::DOUBLE), (4, 0.0::DOUBLE, -1e-5::DOUBLE)) v(i, b, r)),
sc AS ({surface_sql(ONE, ['spot'], 'tte_s', 'strike', 'd_b', 'd_rho', [])}),
l AS (SELECT ticker, i, w, least(greatest(mid, 0.01::DOUBLE), 0.99::DOUBLE) AS y, h{len(ONE.layers)}_0 AS lo FROM sc),
s AS (SELECT ticker, i, sum(w * (greatest(lo, 0) - lo * y + ln(1 + exp(-abs(lo))))) AS loss FROM l GROUP BY ticker, i)
SELECT ticker, round(max(loss) FILTER (i = 0), 6) AS loss,
  round((max(loss) FILTER (i = 1) - max(loss) FILTER (i = 2)) / 2e-6::DOUBLE, 4) + 0.0 AS g_b,
  round((max(loss) FILTER (i = 3) - max(loss) FILTER (i = 4)) / 2e-5::DOUBLE, 4) + 0.0 AS g_rho FROM s GROUP BY ticker""")
def event_slopes(spark, sf):
    from tickloom.operators.stats import event_weight
    rows = event_weight(scored(spark, sf), "ticker").withColumn("d_b", F.lit(0.001)).withColumn("d_rho", F.lit(0.01))
    return J.event_slopes(rows, ONE, px=["spot"]).select("ticker", *r6("loss"), *[
        (F.round(c, 4) + 0.0).alias(c) for c in ("g_b", "g_rho")])


@query("lead_training_rows", f"""WITH {SCORED}, w AS (SELECT *, ts + {4 * SEC} - {SEC // 4} AS want FROM scored)
SELECT w.seq, round(q.mid, 6) AS mid_next, round(ln(least(greatest(w.mid, 0.01::DOUBLE), 0.99::DOUBLE) / (1 - least(greatest(w.mid, 0.01::DOUBLE), 0.99::DOUBLE))), 6) + 0.0 AS base
FROM w ASOF JOIN scored q ON w.ticker = q.ticker AND w.want <= q.ts""")
def lead_training_rows(spark, sf):
    return U.lead_rows(scored(spark, sf), 4 * SEC, slack=SEC // 4, chunk=DAY).select(
        "seq", *r6("mid_next", "base"))
