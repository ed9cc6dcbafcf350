"""Order books, ladder functions and model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import ladders as L
from tickloom.operators import books as K
from tickloom.operators import chunks as C
from tickloom.operators import features as X
from tickloom.operators import study
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, HOUR, MINUTE, SCORED, TICKS, micros, scored, table, ticks
from tickloom.plans.source_queries import S
from tickloom.session import materialize
from tickloom.sources import feeds

R = 6


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def quote_levels(spark, sf):
    """Book levels from order lines: odd lines bid below 0.5, even lines ask above it."""
    li = table(spark, sf, "lineitem")
    bid = F.col("l_linenumber") % 2 == 1
    off = F.col("l_linenumber") * 100 + F.floor(F.col("l_discount") * 100) * 700
    return li.select(
        F.col("l_orderkey").alias("o"), F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 500_000 - off).otherwise(500_000 + off).cast("long").alias("px_micro"),
        F.col("l_quantity").alias("qty"))


LEVELS = """lv AS (SELECT l_orderkey AS o, CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side,
  CAST(500000 + CASE WHEN l_linenumber % 2 = 1 THEN -1 ELSE 1 END
    * (l_linenumber * 100 + floor(l_discount * 100) * 700) AS BIGINT) / 1e6::DOUBLE AS px,
  l_quantity AS qty FROM lineitem)"""
BOOK_SQL = LEVELS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY o, side ORDER BY
    CASE WHEN side = 'bid' THEN -px ELSE px END, CASE WHEN side = 'bid' THEN -qty ELSE qty END) AS k
  FROM lv),
tops AS (SELECT o, max(px) FILTER (side = 'bid' AND k = 1) AS bid, max(px) FILTER (side = 'ask' AND k = 1) AS ask,
  max(qty) FILTER (side = 'bid' AND k = 1) AS bq, max(qty) FILTER (side = 'ask' AND k = 1) AS aq
  FROM ranked GROUP BY o)"""


def snapshots(spark, sf):
    lv = L.level(F.col("px_micro") / 1_000_000, F.col("qty"))
    rows = quote_levels(spark, sf).groupBy("o").agg(
        F.collect_list(F.when(F.col("side") == "bid", lv)).alias("b"),
        F.collect_list(F.when(F.col("side") == "ask", lv)).alias("a"))
    return rows.select("o", L.normalize(F.col("b"), "bid").alias("bids"),
                       L.normalize(F.col("a"), "ask").alias("asks"))


@query("ladder_features", f"""WITH {BOOK_SQL},
m AS (SELECT *, (bid + ask) / 2 AS mid FROM tops WHERE bid IS NOT NULL AND ask IS NOT NULL),
s AS (SELECT m.o, mid, bid, ask, bq, aq,
  sum(qty) FILTER (side = 'bid' AND k <= 2) AS b2, sum(qty) FILTER (side = 'ask' AND k <= 2) AS a2,
  coalesce(sum(qty) FILTER (side = 'bid' AND px >= mid * (1 - 60 / 1e4::DOUBLE)), 0) AS bb,
  coalesce(sum(qty) FILTER (side = 'ask' AND px <= mid * (1 + 60 / 1e4::DOUBLE)), 0) AS ab,
  count(*) FILTER (side = 'bid') AS nb, count(*) FILTER (side = 'ask') AS na,
  min(px) FILTER (side = 'bid') AS deep_b, max(px) FILTER (side = 'ask') AS deep_a
  FROM m JOIN ranked r ON r.o = m.o GROUP BY ALL)
SELECT o, round(mid, 6) AS mid, round((ask - bid) / mid * 1e4, 4) AS spread_bps,
  round((bq - aq) / (bq + aq), 6) + 0.0 AS imb1, round((b2 - a2) / (b2 + a2), 6) + 0.0 AS imb2,
  round(CASE WHEN bb + ab > 0 THEN (bb - ab) / (bb + ab) ELSE 0 END, 6) + 0.0 AS band60,
  round(CASE WHEN deep_b <= mid * (1 - 60 / 1e4::DOUBLE) AND deep_a >= mid * (1 + 60 / 1e4::DOUBLE)
    THEN CASE WHEN bb + ab > 0 THEN (bb - ab) / (bb + ab) ELSE 0 END END, 6) + 0.0 AS band60_covered,
  round(CASE WHEN nb >= 2 AND na >= 2 THEN (b2 - a2) / (b2 + a2) END, 6) + 0.0 AS imb2_covered,
  round(((ask * bq + bid * aq) / (bq + aq) - mid) / mid * 1e4, 4) + 0.0 AS moff FROM s""")
def ladder_features(spark, sf):
    b, a = F.col("bids"), F.col("asks")
    rows = snapshots(spark, sf).filter((F.size(b) > 0) & (F.size(a) > 0))
    return rows.select(
        "o", F.round(L.mid(b, a), 6).alias("mid"), F.round(L.spread_bps(b, a), 4).alias("spread_bps"),
        F.round(L.imbalance(b, a, 1), 6).alias("imb1"), F.round(L.imbalance(b, a, 2), 6).alias("imb2"),
        F.round(L.band_imbalance(b, a, 60), 6).alias("band60"),
        F.round(L.band_imbalance(b, a, 60, True), 6).alias("band60_covered"),
        F.round(L.imbalance(b, a, 2, True), 6).alias("imb2_covered"),
        F.round(L.micro_offset_bps(b, a), 4).alias("moff"))


@query("ladder_top_n_depth", f"""WITH {BOOK_SQL}
SELECT o, round(sum(px * qty) FILTER (side = 'bid' AND k <= 2), 6) AS bid_cash2,
  round(coalesce(sum(qty) FILTER (side = 'ask'), 0), 6) AS ask_depth,
  CAST(count(*) FILTER (side = 'ask') AS INTEGER) AS ask_levels FROM ranked GROUP BY o""")
def ladder_top_n_depth(spark, sf):
    b = L.top_n(F.col("bids"), 2)
    cash = F.aggregate(b, F.lit(0.0), lambda s, v: s + v["px"] * v["qty"])
    return snapshots(spark, sf).select(
        "o", F.round(F.when(F.size(b) > 0, cash), 6).alias("bid_cash2"),
        F.round(L.total_qty(F.col("asks")), 6).alias("ask_depth"),
        F.size("asks").alias("ask_levels"))


@query("ladder_sweep", f"""WITH {BOOK_SQL},
c AS (SELECT o, side, px, qty, coalesce(sum(qty) OVER (PARTITION BY o, side ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked
  WHERE (side = 'bid' AND px >= 0.496::DOUBLE - 1e-6) OR (side = 'ask' AND px <= 0.504::DOUBLE + 1e-6)),
t AS (SELECT o, side, px, greatest(least(qty, 60 - before), 0) AS take FROM c)
SELECT o, round(coalesce(sum(take) FILTER (side = 'bid'), 0), 9) AS sold,
  round(coalesce(sum(take * px) FILTER (side = 'bid') / nullif(sum(take) FILTER (side = 'bid'), 0), 0), 9) AS sell_vwap,
  round(coalesce(sum(take) FILTER (side = 'ask'), 0), 9) AS bought,
  round(coalesce(sum(take * px) FILTER (side = 'ask') / nullif(sum(take) FILTER (side = 'ask'), 0), 0), 9) AS buy_vwap
FROM (SELECT DISTINCT o FROM lv) LEFT JOIN t USING (o) GROUP BY o""")
def ladder_sweep(spark, sf):
    rows = snapshots(spark, sf)
    sell = L.sweep(F.col("bids"), F.lit(60.0), F.lit(0.496), "sell")
    buy = L.sweep(F.col("asks"), F.lit(60.0), F.lit(0.504), "buy")
    return rows.select("o", F.round(sell["qty"], 9).alias("sold"),
                       F.round(sell["vwap"], 9).alias("sell_vwap"),
                       F.round(buy["qty"], 9).alias("bought"),
                       F.round(buy["vwap"], 9).alias("buy_vwap"))


@query("both_outcome_books", f"""WITH {BOOK_SQL}
SELECT 'kalshi.O' || o || '.YES' AS instrument, round(bid, 6) AS bid, round(ask, 6) AS ask FROM tops
UNION ALL SELECT 'kalshi.O' || o || '.NO', round(1 - ask, 6), round(1 - bid, 6) FROM tops""")
def both_outcome_books(spark, sf):
    rows = snapshots(spark, sf).withColumn("instrument", F.concat(
        F.lit("kalshi.O"), F.col("o").cast("string"), F.lit(".YES")))
    out = feeds.both_outcomes(rows)
    return out.select("instrument", F.round(L.best(F.col("bids")), 6).alias("bid"),
                      F.round(L.best(F.col("asks")), 6).alias("ask"))


def sided_books(spark, sf):
    """One snapshot per order, on the series of its customer segment key."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("o"), F.pmod("o_custkey", F.lit(50)).alias("instrument"),
        (micros("o_orderdate") + F.col("o_orderkey")).alias("ts"))
    return snapshots(spark, sf).join(o, "o")


@query("top_of_book_carry", f"""WITH {BOOK_SQL},
b AS (SELECT t.*, o_custkey % 50 AS instrument, epoch_us(o_orderdate) + o_orderkey AS ts
  FROM tops t JOIN orders ON o = o_orderkey),
f AS (SELECT o, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(bq IGNORE NULLS) OVER w AS bid_sz,
  last_value(ask IGNORE NULLS) OVER w AS ask, last_value(aq IGNORE NULLS) OVER w AS ask_sz FROM b
  WINDOW w AS (PARTITION BY instrument ORDER BY ts, o ROWS UNBOUNDED PRECEDING))
SELECT o, round(bid, 6) AS bid, bid_sz, round(ask, 6) AS ask, ask_sz, round((bid + ask) / 2, 6) AS mid,
  round(coalesce(ask, 0) - coalesce(bid, 0), 6) + 0.0 AS spread FROM f""")
def top_of_book_carry(spark, sf):
    rows = K.top_of_book(sided_books(spark, sf), chunk=365 * DAY, order="o")
    return rows.select("o", "bid_sz", "ask_sz", *r6("bid", "ask", "mid", "spread"))


def level_updates(spark, sf):
    """Absolute level updates: a third of the sizes are zero and remove their level."""
    t = ticks(spark, sf)
    bid = F.col("seq") % 2 == 0
    px = F.pmod(F.col("user_id"), F.lit(12)) * 10_000
    return t.select(
        "instrument", "ts", "seq", F.expr(f"(ts div {7 * DAY})").alias("epoch"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 490_000 - px).otherwise(510_000 + px).alias("px_micro"),
        F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("k").cast("double")).alias("qty"))


UPDATES = TICKS + f""", up AS (SELECT instrument, ts, seq, ts // {7 * DAY} AS epoch,
  CASE WHEN seq % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  CASE WHEN seq % 2 = 0 THEN 490000 - (user_id % 12) * 10000 ELSE 510000 + (user_id % 12) * 10000 END AS px,
  CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE k::DOUBLE END AS qty FROM ticks)"""


@query("book_at_instants", f"""WITH {UPDATES}, inst AS (
  SELECT DISTINCT instrument, ts - ts % {4 * HOUR} + {4 * HOUR} AS at FROM ticks),
h AS (SELECT i.instrument, i.at, u.side, u.px, u.qty, u.epoch,
  row_number() OVER (PARTITION BY i.instrument, i.at, u.epoch, u.side, u.px ORDER BY u.ts DESC, u.seq DESC) AS n,
  max(u.epoch) OVER (PARTITION BY i.instrument, i.at) AS cur
  FROM inst i JOIN up u ON u.instrument = i.instrument AND u.ts <= i.at),
l AS (SELECT * FROM h WHERE n = 1 AND epoch = cur AND qty > 0)
SELECT i.instrument, i.at AS ts, round(max(px) FILTER (side = 'bid') / 1e6::DOUBLE, 6) AS bid,
  round(min(px) FILTER (side = 'ask') / 1e6::DOUBLE, 6) AS ask,
  round(coalesce(sum(qty) FILTER (side = 'bid'), 0), 6) AS bid_depth,
  round(coalesce(sum(qty) FILTER (side = 'ask'), 0), 6) AS ask_depth
FROM inst i LEFT JOIN l ON l.instrument = i.instrument AND l.at = i.at GROUP BY 1, 2""")
def book_at_instants(spark, sf):
    inst = ticks(spark, sf).select("instrument", (
        C.chunk_start(F.col("ts"), 4 * HOUR) + 4 * HOUR).alias("ts")).distinct()
    books = K.book_at(inst, level_updates(spark, sf), chunk=2 * DAY)
    b, a = F.col("bids"), F.col("asks")
    return books.select("instrument", "ts", F.round(L.best(b), 6).alias("bid"),
                        F.round(L.best(a), 6).alias("ask"), L.total_qty(b).alias("bid_depth"),
                        L.total_qty(a).alias("ask_depth"))


@query("book_replay_tops", f"""WITH {UPDATES}, n AS (
  SELECT *, coalesce(lead(ts) OVER (PARTITION BY instrument, epoch, side, px ORDER BY ts, seq), 9e18::BIGINT) AS nxt
  FROM up),
h AS (SELECT u.instrument, u.ts, u.seq, l.side, l.px, l.qty FROM up u JOIN n l
  ON l.instrument = u.instrument AND l.epoch = u.epoch AND l.ts <= u.ts AND l.nxt > u.ts AND l.qty > 0)
SELECT u.instrument, u.seq, round(max(h.px) FILTER (h.side = 'bid') / 1e6::DOUBLE, 6) AS bid,
  round(min(h.px) FILTER (h.side = 'ask') / 1e6::DOUBLE, 6) AS ask,
  coalesce(max(h.px) FILTER (h.side = 'bid') >= min(h.px) FILTER (h.side = 'ask'), false) AS crossed
FROM up u LEFT JOIN h ON h.instrument = u.instrument AND h.seq = u.seq GROUP BY 1, 2""")
def book_replay_tops(spark, sf):
    tops = K.replay_tops(level_updates(spark, sf), chunk=2 * DAY)
    return tops.select("instrument", "seq", *r6("bid", "ask"), "crossed")


@query("signed_delta_sizes", f"""WITH RECURSIVE {TICKS},
d AS (SELECT instrument, user_id % 12 AS px, ts, seq, (k - 50)::DOUBLE AS delta,
  row_number() OVER (PARTITION BY instrument, user_id % 12 ORDER BY ts, seq) AS n FROM ticks),
w AS (SELECT instrument, px, n, seq, greatest(delta, 0) AS qty FROM d WHERE n = 1
  UNION ALL SELECT d.instrument, d.px, d.n, d.seq, greatest(w.qty + d.delta, 0) FROM w JOIN d
  ON d.instrument = w.instrument AND d.px = w.px AND d.n = w.n + 1)
SELECT seq, round(qty, 6) AS qty FROM w""")
def signed_delta_sizes(spark, sf):
    t = ticks(spark, sf).select(
        "instrument", F.lit(1).alias("epoch"), F.lit("yes").alias("side"),
        F.pmod("user_id", F.lit(12)).alias("px_micro"), "ts", "seq",
        (F.col("k") - 50).cast("double").alias("delta"))
    return K.absolute_sizes(t, chunk=2 * DAY).select("seq", *r6("qty"))


@query("bid_sequence_validity", f"""WITH {TICKS}, m AS (
  SELECT instrument, ts, seq, CASE WHEN k % 40 = 0 THEN 'snapshot' ELSE 'delta' END AS kind,
    row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) + CASE WHEN k % 25 = 7 THEN 1 ELSE 0 END AS bseq
  FROM ticks),
e AS (SELECT *, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER w AS epoch, lag(bseq) OVER w AS prev
  FROM m WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq)),
g AS (SELECT *, kind = 'delta' AND coalesce(bseq <> prev + 1, false) AS gap FROM e)
SELECT seq, CAST(epoch AS BIGINT) AS epoch, gap, epoch > 0 AND sum(gap::INT) OVER
  (PARTITION BY instrument, epoch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) = 0 AS valid FROM g""")
def bid_sequence_validity(spark, sf):
    t = C.running_sum(ticks(spark, sf), F.lit(1), "i", by=["instrument"], ts="ts", order=["seq"],
                      chunk=2 * DAY)
    msgs = t.select("instrument", "ts", "seq", F.when(F.col("k") % 40 == 0, "snapshot")
                    .otherwise("delta").alias("kind"),
                    (F.col("i") + F.when(F.col("k") % 25 == 7, 1).otherwise(0)).alias("book_seq"))
    return K.bid_epochs(msgs, chunk=2 * DAY).select("seq", "epoch", "gap", "valid")


@query("depth_snapshot_sync", """WITH u AS (
  SELECT DISTINCT l_suppkey AS instrument, l_orderkey * 10 + l_linenumber AS first_id,
    l_orderkey * 10 + l_linenumber AS last_id FROM lineitem),
p AS (SELECT *, coalesce(lag(last_id) OVER (PARTITION BY instrument ORDER BY last_id), -1)
    + CASE WHEN last_id % 17 = 0 THEN 1 ELSE 0 END AS prev_id FROM u),
s AS (SELECT s_suppkey AS instrument, s_suppkey AS sid FROM supplier UNION SELECT instrument, last_id FROM u WHERE last_id % 20 = 0),
j AS (SELECT p.*, s.sid AS epoch FROM p ASOF JOIN s ON s.instrument = p.instrument AND p.last_id >= s.sid),
b AS (SELECT *, lag(last_id) OVER w AS pl FROM j WINDOW w AS (PARTITION BY instrument, epoch ORDER BY last_id)),
c AS (SELECT *, CASE WHEN pl IS NULL THEN first_id > epoch ELSE prev_id <> pl END AS gap FROM b)
SELECT instrument, last_id, epoch, gap, sum(gap::INT) OVER (PARTITION BY instrument, epoch ORDER BY last_id
  ROWS UNBOUNDED PRECEDING) = 0 AS valid FROM c""")
def depth_snapshot_sync(spark, sf):
    u = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("instrument"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_id")).distinct()
    u = u.withColumn("first_id", F.col("last_id"))
    u = C.previous(u, {"last_id": "_p"}, by=["instrument"], ts="last_id", chunk=20_000)
    u = u.withColumn("prev_id", F.coalesce("_p", F.lit(-1)) + F.when(
        F.col("last_id") % 17 == 0, 1).otherwise(0)).drop("_p")
    u = materialize(u, "updates")
    # one snapshot at the start of every instrument, and one at every update whose id ends a twenty
    snaps = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("instrument"), F.col("s_suppkey").alias("last_update_id")).union(
        u.filter("last_id % 20 = 0").select("instrument", "last_id")).distinct()
    return K.depth_epochs(snaps, u, chunk=20_000).select(
        "instrument", "last_id", "epoch", "gap", "valid")


@query("l2_second_features", f"""WITH {TICKS}, g AS (
  SELECT ts // {HOUR} AS t, arg_max(px, ts) AS px, arg_max(user_id, ts) AS q FROM ticks GROUP BY 1)
SELECT t, round((px + 100 + px + 101) / 2, 6) AS mid, round(1 / ((px + 100 + px + 101) / 2) * 1e4, 4) AS spread_bps,
  round((q - 5) / (q + 5)::DOUBLE, 6) + 0.0 AS imb1, round((q + 1 - 7) / (q + 8)::DOUBLE, 6) + 0.0 AS imb5,
  round(CASE WHEN px + 100 >= (px + 100.5::DOUBLE) * (1 - 25 / 1e4::DOUBLE) THEN (q - 5) / (q + 5)::DOUBLE ELSE 0 END, 6)
    + 0.0 AS band25 FROM g""")
def l2_second_features(spark, sf):
    px = F.round(F.col("px") + 100, 2)
    text = lambda *v: S("[[%s,%s],[%s,%s]]", *v)
    snaps = ticks(spark, sf).select(
        (F.expr(f"ts div {HOUR}") * 1_000_000_000 + F.expr(f"(ts % {HOUR}) div 4")).alias("recv_ts_ns"),
        text(px, F.col("user_id"), px - 50, F.lit(1)).alias("bids_json"),
        text(px + 1, F.lit(5), px + 60, F.lit(2)).alias("asks_json"))
    return K.l2_features(snaps).select("t", F.round("mid", 6).alias("mid"), F.round("spread_bps", 4)
                                       .alias("spread_bps"), *r6("imb1", "imb5", "band25"))


@query("l1_fast_parse", f"""WITH {TICKS}
SELECT ts // 1000 AS t_ms, round((user_id - k) / (user_id + k)::DOUBLE, 6) + 0.0 AS imb1,
  round(px + 0.5::DOUBLE, 6) AS mid FROM ticks WHERE user_id + k > 0""")
def l1_fast_parse(spark, sf):
    one = lambda p, q: S("[[%s, %d], [1, 1]]", p, q)
    snaps = ticks(spark, sf).select(
        (F.col("ts") * 1000).alias("recv_ts_ns"), one(F.col("px"), F.col("user_id")).alias("bids_json"),
        one(F.round(F.col("px") + 1, 2), F.col("k")).alias("asks_json"))
    return K.l1_fast(snaps).select("t_ms", *r6("imb1", "mid"))


# ── features ─────────────────────────────────────────────────────────────────
SEC = 10 * MINUTE  # one feature second on the stand-in clock


@query("row_feature_lags", f"""WITH {SCORED}, r AS (SELECT ticker, ts, seq, spot, spot + gap AS cb FROM scored),
p AS (SELECT *, ts - {6 * SEC} AS w6, ts - {12 * SEC} AS w12 FROM r)
SELECT a.seq, round(CASE WHEN a.w6 - b.ts <= {2 * SEC} THEN a.spot - b.spot END, 6) + 0.0 AS mom6,
  round(CASE WHEN a.w12 - c.ts <= {2 * SEC} THEN (a.spot - c.spot) / c.spot END, 6) + 0.0 AS pmom12,
  round(CASE WHEN a.w6 - b.ts <= {2 * SEC} THEN (a.cb - b.cb) / b.cb END, 6) + 0.0 AS pcbmom6,
  round(a.cb - a.spot, 6) + 0.0 AS basis,
  round(CASE WHEN a.w6 - b.ts <= {2 * SEC} THEN (a.cb - a.spot) - (b.cb - b.spot) END, 6) + 0.0 AS dbasis6
FROM p a ASOF LEFT JOIN r b ON a.ticker = b.ticker AND a.w6 >= b.ts
ASOF LEFT JOIN r c ON a.ticker = c.ticker AND a.w12 >= c.ts""")
def row_feature_lags(spark, sf):
    names = ["mom6", "pmom12", "pcbmom6", "basis", "dbasis6"]
    rows = scored(spark, sf).withColumn("cb_mid", F.col("spot") + F.col("gap"))
    return X.row_features(rows, names, second=SEC, chunk=DAY).select("seq", *r6(*names))


@query("feed_features", f"""WITH {TICKS},
perp AS (SELECT ts, px AS mid, user_id::DOUBLE AS b, k::DOUBLE AS a FROM ticks WHERE instrument = 'view'),
cb AS (SELECT ts, px AS mid FROM ticks WHERE instrument = 'click'),
vol AS (SELECT ts, sum(user_id) OVER (ORDER BY ts)::DOUBLE AS cum FROM ticks WHERE instrument = 'purchase'),
q AS (SELECT seq, ts, ts - {12 * SEC} AS w12, ts - {60 * SEC} AS w60 FROM ticks WHERE instrument = 'signup'),
j AS (SELECT q.*, p.mid AS p, p.b, p.a, CASE WHEN q.ts - c.ts <= {5 * SEC} THEN c.mid END AS c,
  CASE WHEN q.w12 - m.ts <= {2 * SEC} THEN m.mid END AS p12,
  CASE WHEN q.w12 - d.ts <= {5 * SEC} THEN d.mid END AS c12, v.cum AS v0,
  CASE WHEN q.w12 - x.ts <= {5 * SEC} THEN x.cum END AS vs, CASE WHEN q.w60 - y.ts <= {5 * SEC} THEN y.cum END AS vl
  FROM q ASOF LEFT JOIN perp p ON q.ts >= p.ts ASOF LEFT JOIN cb c ON q.ts >= c.ts
  ASOF LEFT JOIN perp m ON q.w12 >= m.ts ASOF LEFT JOIN cb d ON q.w12 >= d.ts
  ASOF LEFT JOIN vol v ON q.ts >= v.ts ASOF LEFT JOIN vol x ON q.w12 >= x.ts ASOF LEFT JOIN vol y ON q.w60 >= y.ts),
av AS (SELECT q.seq, avg((s.b - s.a) / (s.b + s.a)) AS m FROM q JOIN (
  SELECT ts - ts % {SEC} AS sec, min(ts) AS ts, arg_min(b, ts) AS b, arg_min(a, ts) AS a FROM perp WHERE b + a > 0 GROUP BY 1) s
  ON s.ts BETWEEN q.ts - {30 * SEC} AND q.ts GROUP BY 1)
SELECT j.seq, round(CASE WHEN p IS NOT NULL THEN c - p END, 9) + 0.0 AS basis,
  round(CASE WHEN c IS NOT NULL THEN (b - a) / nullif(b + a, 0) END, 9) + 0.0 AS imb1,
  round(CASE WHEN c IS NOT NULL AND p IS NOT NULL THEN m END, 9) + 0.0 AS imb1avg30,
  round(CASE WHEN c IS NOT NULL THEN p - p12 END, 9) + 0.0 AS mom12,
  round(CASE WHEN c IS NOT NULL THEN (p - p12) / nullif(p12, 0) END, 9) + 0.0 AS pmom12,
  round(CASE WHEN p IS NOT NULL THEN (c - c12) / nullif(c12, 0) END, 9) + 0.0 AS pcbmom12,
  round(CASE WHEN c IS NOT NULL AND p IS NOT NULL AND v0 - vl > 0 THEN (v0 - vs) / (v0 - vl) END, 9) + 0.0 AS vsurge12_60
FROM j LEFT JOIN av USING (seq)""")
def feed_features(spark, sf):
    t = ticks(spark, sf)
    kind = lambda k: t.filter(F.col("instrument") == k)
    perp = kind("view").select("ts", F.col("px").alias("mid"), F.col("user_id").cast("double")
                               .alias("bid_sz"), F.col("k").cast("double").alias("ask_sz"))
    cb = kind("click").select("ts", F.col("px").alias("mid"))
    volume = C.running_sum(kind("purchase"), F.col("user_id").cast("double"), "cum", by=[],
                           ts="ts", order=["seq"], chunk=2 * DAY).select("ts", "cum")
    names = ["basis", "imb1", "imb1avg30", "mom12", "pmom12", "pcbmom12", "vsurge12_60"]
    rows = X.feed_features(kind("signup").select("seq", "ts"), names, second=SEC, chunk=2 * DAY,
                           perp=perp, cb=cb, volume=volume)
    return rows.select("seq", *[F.round(n, 9).alias(n) for n in names])


@query("standardized_complete_rows", f"""WITH {SCORED}, r AS (
  SELECT seq, CASE WHEN seq % 4 <> 0 THEN (gap - 0.01::DOUBLE) / 0.02::DOUBLE END AS x FROM scored)
SELECT seq, round(least(greatest(x, -5), 5), 6) + 0.0 AS x FROM r WHERE x IS NOT NULL""")
def standardized_complete_rows(spark, sf):
    rows = scored(spark, sf).select("seq", F.when(F.col("seq") % 4 != 0, F.col("gap")).alias("x"))
    rows = X.standardize(rows, ["x"], [0.01], [0.02])
    # least and greatest skip nulls, so a missing input must stay missing
    kept, _ = X.complete_rows(rows, ["x"])
    return kept.select("seq", *r6("x"))


@query("implied_level", f"""WITH {TICKS}, q AS (
  SELECT ts - ts % {6 * HOUR} AS grp, 100 + user_id AS strike, max(1 - (user_id + k % 7) / 160.0::DOUBLE) AS p
  FROM ticks GROUP BY 1, 2),
a AS (SELECT grp, max(strike) FILTER (p >= 0.5) AS k0, count(*) AS n FROM q GROUP BY 1),
b AS (SELECT a.grp, a.k0, a.n, max(q.p) FILTER (q.strike = a.k0) AS p0,
  min(q.strike) FILTER (q.strike > a.k0) AS k1, arg_min(q.p, q.strike) FILTER (q.strike > a.k0) AS p1
  FROM a JOIN q USING (grp) GROUP BY ALL)
SELECT grp, round(CASE WHEN n >= 2 AND k1 IS NOT NULL THEN coalesce(k0 + (k1 - k0) * (p0 - 0.5) / nullif(p0 - p1, 0), k0) END, 6) AS level
FROM b""")
def implied_level(spark, sf):
    t = ticks(spark, sf).withColumn("grp", C.chunk_start(F.col("ts"), 6 * HOUR))
    p = 1 - (F.col("user_id") + F.col("k") % 7) / 160.0
    q = t.groupBy("grp", (F.col("user_id") + 100).cast("double").alias("strike")).agg(F.max(p).alias("p"))
    out = q.groupBy("grp").agg(L.implied_level(F.collect_list(F.struct("strike", "p"))).alias("level"))
    return out.select("grp", *r6("level"))


@query("atm_slope", f"""WITH {TICKS}, q AS (
  SELECT ts - ts % {6 * HOUR} AS event, 100 + user_id AS strike, max(1 - (user_id + k % 7) / 160.0::DOUBLE) AS p
  FROM ticks GROUP BY 1, 2),
n AS (SELECT *, lead(strike) OVER w AS k1, lead(p) OVER w AS p1 FROM q WINDOW w AS (PARTITION BY event ORDER BY strike))
SELECT round(quantile_cont(abs(p1 - p) / (k1 - strike), 0.5), 6) AS slope FROM n WHERE p >= 0.4::DOUBLE AND p1 <= 0.6::DOUBLE""")
def atm_slope(spark, sf):
    t = ticks(spark, sf).withColumn("event", C.chunk_start(F.col("ts"), 6 * HOUR))
    p = 1 - (F.col("user_id") + F.col("k") % 7) / 160.0
    q = t.groupBy("event", (F.col("user_id") + 100).cast("double").alias("strike")).agg(F.max(p).alias("p"))
    return study.atm_slope(q).select(*r6("slope"))
