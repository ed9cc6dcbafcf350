"""Grids, row-to-row rules, interval joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import chunks as C
from tickloom.operators import folds
from tickloom.operators import grid as G
from tickloom.operators import ranges as R
from tickloom.operators.asof import asof_join
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, FILLS, HOUR, MINUTE, SCORED, TICKS, fills, scored, table, ticks
from tickloom.session import materialize

W = "PARTITION BY instrument ORDER BY ts, seq"
BY = dict(by=["instrument"], ts="ts", order=["seq"])


@query("running_volume", f"""WITH {TICKS}
SELECT seq, sum(user_id) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM ticks""")
def running_volume(spark, sf):
    return C.running_sum(ticks(spark, sf), F.col("user_id"), "cum", **BY, chunk=DAY).select(
        "seq", "cum")


@query("forward_fill", f"""WITH {TICKS}, h AS (SELECT *, CASE WHEN k % 3 = 0 THEN px END AS v FROM ticks)
SELECT seq, last_value(v IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS filled FROM h""")
def forward_fill(spark, sf):
    rows = ticks(spark, sf).withColumn("v", F.when(F.col("k") % 3 == 0, F.col("px")))
    return C.fill_forward(rows, {"v": "filled"}, **BY, chunk=DAY).select("seq", "filled")


@query("trailing_mean", f"""WITH {TICKS}
SELECT seq, round(avg(px) OVER w, 9) AS mean, count(*) OVER w AS n FROM ticks
WINDOW w AS (PARTITION BY instrument ORDER BY ts RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)""")
def trailing_mean(spark, sf):
    rows = C.trailing(ticks(spark, sf), {"mean": ("avg", "px"), "n": ("count", "px")},
                      by=["instrument"], ts="ts", span=6 * HOUR, chunk=DAY)
    return rows.select("seq", F.round("mean", 9).alias("mean"), "n")


@query("youngest_lookback", f"""WITH {TICKS}, p AS (SELECT *, ts - {HOUR} AS want FROM ticks)
SELECT p.seq, CASE WHEN p.want - q.ts <= {9 * HOUR} THEN q.seq END AS then_seq
FROM p ASOF LEFT JOIN ticks q ON p.instrument = q.instrument AND p.want >= q.ts""")
def youngest_lookback(spark, sf):
    t = ticks(spark, sf)
    return asof_join(t, t, by=["instrument"], at=F.col("ts") - HOUR, tol=9 * HOUR,
                     take={"seq": "then_seq"}, chunk=2 * DAY).select("seq", "then_seq")


@query("mid_changes", f"""WITH {TICKS}, m AS (SELECT instrument, ts, seq, floor(px / 20) AS v FROM ticks),
p AS (SELECT *, lag(v) OVER ({W}) AS prev FROM m)
SELECT seq, CAST(v AS BIGINT) AS v FROM p WHERE prev IS NULL OR abs(v - prev) > 1e-9""")
def mid_changes(spark, sf):
    rows = ticks(spark, sf).withColumn("v", F.floor(F.col("px") / 20))
    return G.changes(rows, "v", **BY, chunk=DAY).select("seq", "v")


@query("window_move", f"""WITH {TICKS}, m AS (
  SELECT instrument, ts, seq, px, lag(px) OVER ({W}) AS prev FROM ticks),
ch AS (SELECT * FROM m WHERE prev IS NULL OR abs(px - prev) > 1e-9),
p AS (SELECT *, ts - {6 * HOUR} AS want FROM ticks)
SELECT p.seq, round((p.px / nullif(q.px, 0) - 1) * 10000, 4) + 0.0 AS move_bps,
       round(p.px - q.px, 6) + 0.0 AS move_abs
FROM p ASOF LEFT JOIN ch q ON p.instrument = q.instrument AND p.want >= q.ts""")
def window_move(spark, sf):
    t = ticks(spark, sf)
    series = G.changes(t, "px", **BY, chunk=DAY)
    rows = asof_join(t, series, by=["instrument"], at=F.col("ts") - 6 * HOUR,
                     take={"px": "past"}, tie="seq", chunk=DAY)
    move = (F.col("px") / F.when(F.abs("past") > 1e-12, F.col("past")) - 1) * 10_000
    return rows.select("seq", F.round(move, 4).alias("move_bps"),
                       F.round(F.col("px") - F.col("past"), 6).alias("move_abs"))


@query("first_last_per_hour", f"""WITH {TICKS}
SELECT instrument, ts - ts % {HOUR} AS bucket, arg_min(px, (ts, seq)) AS first_px,
       arg_max(px, (ts, seq)) AS last_px FROM ticks GROUP BY 1, 2""")
def first_last_per_hour(spark, sf):
    t = ticks(spark, sf)
    kw = dict(by=["instrument"], ts="ts", step=HOUR, order=["seq"])
    first = G.bucket_pick(t, ["px"], which="first", **kw).select(
        "instrument", "bucket", F.col("px").alias("first_px"))
    last = G.bucket_pick(t, ["px"], **kw).select("instrument", "bucket",
                                                 F.col("px").alias("last_px"))
    return first.join(last, ["instrument", "bucket"])


GRID_SQL = f"""b AS (SELECT instrument, ts - ts % {HOUR} AS bucket, arg_max(px, (ts, seq)) AS v
  FROM ticks GROUP BY 1, 2),
r AS (SELECT instrument, min(bucket) AS lo, max(bucket) AS hi FROM b GROUP BY 1),
g AS (SELECT instrument, unnest(range(lo, hi + 1, {HOUR})) AS ts FROM r),
gv AS (SELECT g.instrument, g.ts, b.v FROM g LEFT JOIN b ON g.instrument = b.instrument
       AND g.ts = b.bucket),
grid AS (SELECT instrument, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts
         ROWS UNBOUNDED PRECEDING) AS px FROM gv)"""


def hourly(spark, sf, fill=True, **kw):
    return G.resample(ticks(spark, sf), "px", by=["instrument"], ts="ts", step=HOUR, chunk=2 * DAY,
                      order=["seq"], fill=fill, **kw)


@query("resample_forward_fill", f"WITH {TICKS}, {GRID_SQL} SELECT instrument, ts, px FROM grid")
def resample_forward_fill(spark, sf):
    return hourly(spark, sf)


@query("resample_causal_label", f"""WITH {TICKS}, {GRID_SQL}
SELECT instrument, ts + {HOUR} AS ts, px FROM grid""")
def resample_causal_label(spark, sf):
    return hourly(spark, sf, label="end")


@query("interpolate_limited", f"""WITH {TICKS}, {GRID_SQL}, i AS (
  SELECT instrument, ts, v,
    last_value(v IGNORE NULLS) OVER a AS pv,
    last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS pt,
    first_value(v IGNORE NULLS) OVER z AS nv,
    first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER z AS nt
  FROM gv WINDOW a AS (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING),
    z AS (PARTITION BY instrument ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT instrument, ts, round(coalesce(v, CASE WHEN ts - pt <= {3 * HOUR} THEN
  coalesce(pv + (nv - pv) * (ts - pt) / nullif(nt - pt, 0)::DOUBLE, pv) END), 6) AS px FROM i""")
def interpolate_limited(spark, sf):
    rows = G.interpolate(hourly(spark, sf, fill=False), "px", by=["instrument"], ts="ts",
                         step=HOUR, limit=3, chunk=2 * DAY)
    return rows.select("instrument", "ts", F.round("px", 6).alias("px"))


@query("grid_log_return", f"""WITH {TICKS}, {GRID_SQL}
SELECT instrument, ts, round(ln(nullif(px, 0)) - lag(ln(nullif(px, 0)), 4) OVER (PARTITION BY instrument ORDER BY ts), 6)
  + 0.0 AS ret FROM grid""")
def grid_log_return(spark, sf):
    rows = G.grid_return(hourly(spark, sf), "px", 4, "ret", by=["instrument"], ts="ts", step=HOUR,
                         chunk=2 * DAY)
    return rows.select("instrument", "ts", F.round("ret", 6).alias("ret"))


@query("forward_changes", f"""WITH {TICKS}, {GRID_SQL}
SELECT instrument, ts, round(lead(px, 1) OVER w - px, 6) + 0.0 AS h1,
  round(lead(px, 6) OVER w - px, 6) + 0.0 AS h6 FROM grid WINDOW w AS (PARTITION BY instrument ORDER BY ts)""")
def forward_changes(spark, sf):
    rows = G.forward_changes(hourly(spark, sf), "px", {"h1": 1, "h6": 6}, by=["instrument"],
                             ts="ts", step=HOUR, chunk=2 * DAY)
    return rows.select("instrument", "ts", *[F.round(c, 6).alias(c) for c in ("h1", "h6")])


@query("exact_second_lag", f"""WITH {TICKS}, {GRID_SQL}
SELECT a.instrument, a.ts, b.px AS lag3, c.px AS lag24 FROM grid a
LEFT JOIN grid b ON a.instrument = b.instrument AND a.ts = b.ts + {3 * HOUR}
LEFT JOIN grid c ON a.instrument = c.instrument AND a.ts = c.ts + {24 * HOUR}""")
def exact_second_lag(spark, sf):
    rows = G.exact_lag(hourly(spark, sf), {"lag3": ("px", 3 * HOUR), "lag24": ("px", 24 * HOUR)},
                       by=["instrument"], t="ts")
    return rows.select("instrument", "ts", "lag3", "lag24")


@query("dedupe_last", f"""WITH {FILLS}
SELECT instrument, ts, arg_max(venue_trade_id, seq) AS venue_trade_id FROM fills GROUP BY 1, 2""")
def dedupe_last(spark, sf):
    return G.dedupe_last(fills(spark, sf), by=["instrument"], ts="ts", order=["seq"]).select(
        "instrument", "ts", "venue_trade_id")


@query("run_length", f"""WITH {TICKS}, i AS (
  SELECT seq, instrument, ts, px > 10 AS ok, row_number() OVER ({W}) AS n FROM ticks),
z AS (SELECT *, max(CASE WHEN NOT ok THEN n END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS last_off FROM i)
SELECT seq, n - coalesce(last_off, 0) AS run FROM z""")
def run_length(spark, sf):
    return G.run_length(ticks(spark, sf), F.col("px") > 10, "run", **BY, chunk=DAY).select(
        "seq", "run")


@query("rising_edges", f"""WITH {TICKS}, f AS (
  SELECT seq, px > 30 AS hot, lag(px > 30) OVER ({W}) AS was FROM ticks)
SELECT seq FROM f WHERE hot AND NOT coalesce(was, false)""")
def rising_edges(spark, sf):
    return folds.rising_edges(ticks(spark, sf), F.col("px") > 30, **BY, chunk=DAY).select("seq")


@query("sequence_gap_epochs", f"""WITH {FILLS}, g AS (
  SELECT instrument, seq, ts, order_id, lag(order_id) OVER ({W}) AS prev FROM fills)
SELECT seq, sum(CASE WHEN prev IS NOT NULL AND order_id <> prev + 1 THEN 1 ELSE 0 END)
  OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM g""")
def sequence_gap_epochs(spark, sf):
    year = 365 * DAY
    rows = C.previous(fills(spark, sf), {"order_id": "prev"}, **BY, chunk=year)
    gap = F.col("prev").isNotNull() & (F.col("order_id") != F.col("prev") + 1)
    return G.sequence_epochs(rows, gap, "epoch", **BY, chunk=year).select("seq", "epoch")


@query("nearest_markets", """
WITH c AS (SELECT o_orderkey AS ticker, o_orderpriority AS series, epoch_us(o_orderdate) AS close_ts,
  abs(o_totalprice - 150000) AS d FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY close_ts, d, ticker) AS rank FROM c)
SELECT series, ticker, rank::INTEGER AS rank, CASE WHEN rank = 1 THEN 'current' ELSE 'upcoming_' || (rank - 1) END AS role
FROM r WHERE rank <= 5""")
def nearest_markets(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ticker"), F.col("o_orderpriority").alias("series"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("close_ts"),
        F.col("o_totalprice").alias("strike"))
    return G.rank_markets(o, F.lit(150_000.0), n=5).select("series", "ticker", "rank", "role")


# ── interval joins ───────────────────────────────────────────────────────────

def moves(spark, sf):
    t = ticks(spark, sf).filter("instrument = 'view' AND px > 40")
    return t.select(F.col("seq").alias("event_id"), F.col("ts").alias("t0"),
                    F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("dir"))


MOVES = TICKS + """, moves AS (SELECT seq AS event_id, ts AS t0,
  CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS dir FROM ticks WHERE instrument = 'view' AND px > 40)"""
PRE, POST = 2 * HOUR, 4 * HOUR


@query("interval_join", f"""WITH {MOVES}
SELECT event_id, seq, t.ts - t0 AS lag FROM moves m JOIN ticks t
ON t.ts >= t0 - {PRE} AND t.ts < t0 + {POST} WHERE t.instrument = 'purchase'""")
def interval_join(spark, sf):
    t = ticks(spark, sf).filter("instrument = 'purchase'")
    return R.range_join(moves(spark, sf), t, pre=PRE, post=POST, bucket=6 * HOUR).select(
        "event_id", "seq", (F.col("ts") - F.col("t0")).alias("lag"))


@query("near_event_mask", f"""WITH {MOVES}
SELECT seq, EXISTS (SELECT 1 FROM moves WHERE abs(t0 - ts) <= {HOUR}) AS near FROM ticks""")
def near_event_mask(spark, sf):
    return R.near_events(ticks(spark, sf), moves(spark, sf), pad=HOUR, chunk=DAY).select(
        "seq", "near")


@query("volume_between", f"""WITH {MOVES}
SELECT event_id, instrument, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS volume, count(*) AS n
FROM moves JOIN ticks ON ts > t0 - {PRE} AND ts <= t0 + {POST} GROUP BY 1, 2""")
def volume_between(spark, sf):
    out = R.volume_in_window(moves(spark, sf), ticks(spark, sf), F.col("user_id"), pre=PRE, post=POST, chunk=2 * DAY,
                             closed="right")
    return out.select("event_id", "instrument", *[F.col(c).cast("long").alias(c) for c in ("volume", "n")])


@query("active_market", f"""WITH {MOVES}, c AS (
  SELECT event_id, t0, instrument, count(*) AS updates FROM moves JOIN ticks
  ON ts >= t0 - {PRE} AND ts < t0 + {POST} GROUP BY ALL),
p AS (SELECT *, t0 - {PRE} AS want FROM c),
b AS (SELECT p.*, t.px AS px0 FROM p ASOF JOIN ticks t ON p.instrument = t.instrument AND p.want > t.ts)
SELECT event_id, arg_max(instrument, (updates, instrument)) AS instrument, max(updates) AS updates
FROM b WHERE px0 BETWEEN 5 AND 95 GROUP BY event_id""")
def active_market(spark, sf):
    return R.active_market(moves(spark, sf), ticks(spark, sf), pre=PRE, post=POST, chunk=2 * DAY,
                           band=(5, 95)).select("event_id", "instrument", F.col("updates")
                                                .cast("long").alias("updates"))


@query("swept_market", f"""WITH {MOVES}, v AS (
  SELECT event_id, instrument, sum(user_id) AS q FROM moves JOIN ticks
  ON ts >= t0 - {PRE} AND ts < t0 + {POST} GROUP BY ALL)
SELECT event_id, arg_max(instrument, (q, instrument)) AS instrument, CAST(max(q) AS BIGINT) AS volume
FROM v GROUP BY event_id""")
def swept_market(spark, sf):
    out = R.swept_market(moves(spark, sf), ticks(spark, sf), F.col("user_id"), pre=PRE, post=POST, chunk=2 * DAY)
    return out.select("event_id", "instrument", F.col("volume").cast("long").alias("volume"))


def lifecycle(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("M"), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("kind"),
        F.concat(F.lit("M"), F.pmod("o_custkey", F.lit(200)).cast("string")).alias("instrument"),
        k.alias("seq"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.when(k % 3 == 0, "Live").when(k % 3 == 1, "Expired").otherwise("Upcoming").alias("status"))


META = """meta AS (SELECT 'M' || (o_custkey % 40) AS kind, 'M' || (o_custkey % 200) AS instrument,
  o_orderkey AS seq, epoch_us(o_orderdate) AS ts,
  CASE o_orderkey % 3 WHEN 0 THEN 'Live' WHEN 1 THEN 'Expired' ELSE 'Upcoming' END AS status FROM orders)"""


@query("lifecycle_links", f"""WITH {META}, live AS (
  SELECT *, lead(ts) OVER (PARTITION BY kind ORDER BY ts, seq) AS nxt FROM meta WHERE status = 'Live'),
c AS (SELECT l.kind, l.instrument, l.ts, l.seq, l.nxt, min(e.ts) AS clr FROM live l
  LEFT JOIN meta e ON e.kind = l.kind AND e.instrument = l.instrument AND e.status = 'Expired'
  AND (e.ts > l.ts OR (e.ts = l.ts AND e.seq > l.seq)) GROUP BY ALL)
SELECT kind, instrument, ts AS from_ts, seq, least(coalesce(nxt, clr), coalesce(clr, nxt)) AS to_ts FROM c""")
def lifecycle_links(spark, sf):
    return R.link_intervals(lifecycle(spark, sf))


@query("linked_target", f"""WITH RECURSIVE {META},
m AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts, seq) AS n FROM meta),
w AS (SELECT kind, n, ts, seq, CASE WHEN status = 'Live' THEN instrument END AS link FROM m WHERE n = 1
  UNION ALL
  SELECT m.kind, m.n, m.ts, m.seq, CASE WHEN m.status = 'Live' THEN m.instrument
    WHEN m.status = 'Expired' AND m.instrument = w.link THEN NULL ELSE w.link END
  FROM w JOIN m ON m.kind = w.kind AND m.n = w.n + 1),
day_end AS (SELECT kind, ts, link FROM w
  QUALIFY row_number() OVER (PARTITION BY kind, ts ORDER BY n DESC) = 1),
probe AS (SELECT 'M' || (c_custkey % 40) AS kind, c_custkey AS id,
  epoch_us(TIMESTAMP '1996-01-01') + c_custkey * {6 * HOUR} + 1 AS ts FROM customer)
SELECT p.id, d.link AS target FROM probe p ASOF LEFT JOIN day_end d ON p.kind = d.kind AND p.ts >= d.ts""")
def linked_target(spark, sf):
    c = table(spark, sf, "customer")
    base = F.unix_micros(F.lit("1996-01-01").cast("timestamp"))
    probe = c.select(
        F.concat(F.lit("M"), F.pmod("c_custkey", F.lit(40)).cast("string")).alias("kind"),
        F.col("c_custkey").alias("id"), (base + F.col("c_custkey") * (6 * HOUR) + 1).alias("ts"))
    links = R.link_intervals(lifecycle(spark, sf))
    return R.link_asof(probe, links, by=["kind"], chunk=365 * DAY).select("id", "target")


def signal_pair(spark, sf):
    t = ticks(spark, sf).withColumn("dir", F.when(F.col("k") % 2 == 0, 1).otherwise(-1))
    t = t.select(F.col("user_id").alias("target"), "dir", "ts", "seq")
    return t.filter("seq % 2 = 0"), t.filter("seq % 2 = 1")


MATCHES = f"""WITH RECURSIVE {TICKS}, s AS (SELECT user_id AS target, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS dir, ts, seq FROM ticks),
l AS (SELECT *, row_number() OVER (PARTITION BY target, dir ORDER BY ts, seq) AS n FROM s WHERE seq % 2 = 0),
c AS (SELECT l.target, l.dir, l.n, l.seq, l.ts, coalesce(list({{'id': r.seq, 'lag': r.ts - l.ts}} ORDER BY r.ts, r.seq)
    FILTER (r.seq IS NOT NULL), []) AS reach
  FROM l LEFT JOIN s r ON r.seq % 2 = 1 AND r.target = l.target AND r.dir = l.dir AND r.ts BETWEEN l.ts - {12 * HOUR} AND l.ts + {12 * HOUR}
  GROUP BY ALL),
w AS (SELECT DISTINCT target, dir, 0::BIGINT AS n, NULL::BIGINT AS a_id, NULL::STRUCT(id BIGINT, lag BIGINT) AS hit, []::BIGINT[] AS used FROM c
  UNION ALL SELECT target, dir, n, seq, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.id) END
  FROM (SELECT c.*, w.used, list_filter(c.reach, lambda x : NOT list_contains(w.used, x.id))[1] AS hit
    FROM w JOIN c ON c.target = w.target AND c.dir = w.dir AND c.n = w.n + 1))"""


@query("matched_signals", MATCHES + """
SELECT target, dir, a_id, hit.id AS b_id, hit.lag AS lag FROM w WHERE hit IS NOT NULL""")
def matched_signals(spark, sf):
    a, b = signal_pair(spark, sf)
    return R.match_signals(a, b, tol=12 * HOUR, by=["target", "dir"], chunk=10 * DAY)


@query("unmatched_signals", MATCHES + """
SELECT 'a' AS side, target, dir, ts, seq FROM l ANTI JOIN (SELECT a_id AS seq FROM w WHERE hit IS NOT NULL) USING (seq)
UNION ALL SELECT 'b', target, dir, ts, seq FROM s ANTI JOIN (SELECT hit.id AS seq FROM w WHERE hit IS NOT NULL) USING (seq) WHERE seq % 2 = 1""")
def unmatched_signals(spark, sf):
    a, b = signal_pair(spark, sf)
    pairs = materialize(R.match_signals(a, b, tol=12 * HOUR, by=["target", "dir"], chunk=10 * DAY), "pairs")
    rest = [R.unmatched(rows, pairs, side).withColumn("side", F.lit(side)) for rows, side in ((a, "a"), (b, "b"))]
    return rest[0].unionByName(rest[1]).select("side", "target", "dir", "ts", "seq")


@query("post_latency_book", f"""WITH {SCORED}, p AS (SELECT *, ts + {30 * MINUTE} AS want FROM scored),
f AS (SELECT p.seq, p.ts, p.yask AS y0, q.ts AS t1, q.yask AS y1 FROM p ASOF LEFT JOIN scored q
  ON p.ticker = q.ticker AND p.want <= q.ts)
SELECT seq, round(CASE WHEN t1 IS NULL OR t1 - ts > {150 * MINUTE} THEN y0 ELSE y1 END, 6) AS ask FROM f""")
def post_latency_book(spark, sf):
    from tickloom.operators.trades import latency_book
    rows = latency_book(scored(spark, sf), latency=30 * MINUTE, slack=120 * MINUTE, chunk=DAY)
    return rows.select("seq", F.round("fill_ask", 6).alias("ask"))


@query("calibration_at_boundary", f"""WITH {SCORED}, logged AS (
  SELECT ticker, tte_s, seq AS d_b FROM scored),
bounds AS (SELECT ticker, CAST(unnest([300, 240, 180, 120, 60]) AS INTEGER) AS boundary
  FROM (SELECT DISTINCT ticker FROM logged)),
near AS (SELECT b.ticker, b.boundary, arg_min(l.d_b, (abs(l.tte_s - b.boundary), -l.tte_s)) AS d_b
  FROM bounds b LEFT JOIN logged l ON l.ticker = b.ticker AND abs(l.tte_s - b.boundary) <= 30
  GROUP BY 1, 2),
f AS (SELECT ticker, boundary, last_value(d_b IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY boundary DESC
  ROWS UNBOUNDED PRECEDING) AS d_b FROM near)
SELECT * FROM f WHERE d_b IS NOT NULL""")
def calibration_at_boundary(spark, sf):
    from tickloom.operators.calibrate import calib_at
    logged = scored(spark, sf).select(
        "ticker", "tte_s", F.col("seq").alias("d_b"))
    return calib_at(logged, ["d_b"], tte_max=300, step=60).select("ticker", "boundary", "d_b")
