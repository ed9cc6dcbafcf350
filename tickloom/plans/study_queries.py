"""Event studies, trade tape, lead-lag, probe statistics and feed quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import buckets as B
from tickloom.operators import chunks as C
from tickloom.operators import study as S
from tickloom.operators.asof import asof_join
from tickloom.plans.book_queries import r6
from tickloom.plans.grid_queries import GRID_SQL, MOVES, hourly, moves
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, FILLS, HOUR, SCORED, TICKS, fills, scored, table, ticks
from tickloom.plans.source_queries import LI, lines

OFFS = [-2 * HOUR, 0, 2 * HOUR, 6 * HOUR]
BASE = -3 * HOUR
TIMELINE = MOVES + f""", tgt AS (SELECT ts, px FROM ticks WHERE instrument = 'click'),
b0 AS (SELECT *, t0 + ({BASE}) AS want FROM moves),
b1 AS (SELECT b0.event_id, b0.t0, b0.dir, t.px AS base FROM b0 ASOF JOIN tgt t ON b0.want > t.ts),
o AS (SELECT *, t0 + off AS want FROM b1, (SELECT unnest([{', '.join(map(str, OFFS))}]) AS off)),
tl AS (SELECT o.event_id, o.off, o.base, t.px AS level, o.dir * (ln(nullif(t.px, 0)) - ln(nullif(o.base, 0))) * 1e4 AS move
  FROM o ASOF JOIN tgt t ON o.want > t.ts)"""


def timeline(spark, sf):
    series = ticks(spark, sf).filter("instrument = 'click'")
    return S.event_timeline(moves(spark, sf), series, OFFS, base=BASE, log=True, scale=1e4,
                            chunk=5 * DAY)


@query("event_timeline", f"""WITH {TIMELINE}
SELECT event_id, off AS offset_us, base, level, round(move, 4) + 0.0 AS move FROM tl""")
def event_timeline(spark, sf):
    return timeline(spark, sf).select("event_id", F.col("offset").alias("offset_us"), "base",
                                      "level", F.round("move", 4).alias("move"))


PATH = TIMELINE + f""", p AS (SELECT off, count(*) AS n, avg(move) AS mean, stddev_pop(move) / sqrt(count(*)) AS se
  FROM tl GROUP BY off),
q AS (SELECT *, 100 * mean / (SELECT mean FROM p WHERE off = {OFFS[-1]}) AS pct FROM p)"""


@query("event_path", f"""WITH {PATH}
SELECT off AS offset_us, n, round(mean, 4) + 0.0 AS mean, round(se, 4) AS se, round(pct, 4) + 0.0 AS pct_final
FROM q""")
def event_path(spark, sf):
    return S.event_path(timeline(spark, sf), OFFS[-1]).select(
        F.col("offset").alias("offset_us"), "n",
        *[F.round(c, 4).alias(c) for c in ("mean", "se", "pct_final")])


@query("event_rise_time", f"""WITH {PATH}, l AS (SELECT off, pct, lag(off) OVER (ORDER BY off) AS po,
  lag(pct) OVER (ORDER BY off) AS pv FROM q)
SELECT min(off) FILTER (pct >= 50) AS reach_50, min(off) FILTER (pct >= 90) AS reach_90,
  round(arg_min(po + (50 - pv) / (pct - pv) * (off - po), off) FILTER (pv < 50 AND pct >= 50), 2) AS cross_50,
  round(arg_min(po + (90 - pv) / (pct - pv) * (off - po), off) FILTER (pv < 90 AND pct >= 90), 2) AS cross_90
FROM l""")
def event_rise_time(spark, sf):
    out = S.rise_time(S.event_path(timeline(spark, sf), OFFS[-1]), [50, 90])
    return out.select("reach_50", "reach_90", F.round("cross_50", 2).alias("cross_50"),
                      F.round("cross_90", 2).alias("cross_90"))


EV = f"""ev AS (SELECT seq, ts, mid, (seq % 13 - 6) / 2.0::DOUBLE AS pre,
  round((k_move - 50) / 10.0::DOUBLE, 4) AS r1, (seq % 11 - 5) / 1.0::DOUBLE AS r3 FROM (
    SELECT *, (seq * 37) % 100 AS k_move FROM scored))"""


def study_events(spark, sf):
    """Events with the move inside the window and forward moves, in cents."""
    s = F.col("seq")
    return scored(spark, sf).select(
        "seq", "ts", "mid", ((s % 13 - 6) / 2.0).alias("pre"),
        ((s * 37 % 100 - 50) / 10.0).alias("r1"), (s % 11 - 5).cast("double").alias("r3"),
        "ybid", "yask")


@query("response_by_start_price", f"""WITH {SCORED}, {EV}
SELECT CASE WHEN mid < 0.2::DOUBLE THEN '0-0.2' WHEN mid < 0.4::DOUBLE THEN '0.2-0.4' WHEN mid < 0.6::DOUBLE THEN '0.4-0.6'
  WHEN mid < 0.8::DOUBLE THEN '0.6-0.8' ELSE '0.8-1' END AS bucket, count(*) AS n, round(avg(pre), 6) + 0.0 AS pre,
  round(avg(r1), 6) + 0.0 AS r1, round(avg(r3), 6) + 0.0 AS r3 FROM ev WHERE mid < 1 GROUP BY 1""")
def response_by_start_price(spark, sf):
    out = S.response_by(study_events(spark, sf), B.edge_bucket(F.col("mid"), [0, .2, .4, .6, .8, 1.0]),
                        ["pre", "r1", "r3"])
    return out.select("bucket", "n", *r6("pre", "r1", "r3"))


@query("bucket_net_edge", f"""WITH {SCORED}, {EV}, b AS (
  SELECT CAST(floor((ev.mid - 0.05::DOUBLE) / 0.1::DOUBLE + 1e-9) AS BIGINT) AS bucket, r3, 2 * half AS sp
  FROM ev JOIN scored0 USING (seq) WHERE ev.mid >= 0.05::DOUBLE AND ev.mid < 0.95::DOUBLE),
a AS (SELECT bucket, count(*) AS n, avg(r3) AS e, avg(sp * 100) AS s, 0.05::DOUBLE + (bucket + 0.5::DOUBLE) * 0.1::DOUBLE AS p
  FROM b GROUP BY 1 HAVING count(*) >= 5)
SELECT bucket, n, round(e, 6) + 0.0 AS edge_c, round(s, 6) AS spread_c, round(7 * p * (1 - p), 6) AS fee_c,
  round(e - s - 14 * p * (1 - p), 6) + 0.0 AS net_taker, round(e - 7 * p * (1 - p), 6) + 0.0 AS net_maker FROM a""")
def bucket_net_edge(spark, sf):
    obs = study_events(spark, sf).select(
        F.col("mid").alias("p0"), F.col("r3").alias("edge_c"),
        ((F.col("yask") - F.col("ybid")) * 100).alias("spread_c"))
    return S.bucket_net(obs).select("bucket", "n", *r6("edge_c", "spread_c", "fee_c", "net_taker",
                                                       "net_maker"))


@query("lag_versus_moved", f"""WITH {SCORED}, {EV}
SELECT CASE WHEN pre <= 0 THEN 'lag' ELSE 'moved' END AS grp, count(*) AS n, round(avg(pre), 6) + 0.0 AS pre,
  round(avg(r1), 6) + 0.0 AS r1, round(avg(r3), 6) + 0.0 AS r3 FROM ev GROUP BY 1""")
def lag_versus_moved(spark, sf):
    return S.lag_vs_moved(study_events(spark, sf), ["r1", "r3"]).select(
        "grp", "n", *r6("pre", "r1", "r3"))


@query("direction_hits", f"""WITH {SCORED}, {EV}, l AS (SELECT 'r1' AS horizon, r1 AS r FROM ev
  UNION ALL SELECT 'r3', r3 FROM ev)
SELECT horizon, round(avg(r), 6) + 0.0 AS mean, round(avg((r > 0)::INT) FILTER (r <> 0), 6) AS hit,
  round(avg((r = 0)::INT), 6) AS flat, count(*) FILTER (r <> 0) AS movers FROM l GROUP BY 1""")
def direction_hits(spark, sf):
    return S.direction_hits(study_events(spark, sf), ["r1", "r3"]).select(
        "horizon", "movers", *r6("mean", "hit", "flat"))


@query("catch_up_share", f"""WITH {SCORED}, {EV}
SELECT count(*) AS n, round(avg(r1) / nullif(avg(pre) + avg(r1), 0), 4) + 0.0 AS after FROM ev""")
def catch_up_share(spark, sf):
    return S.catch_up(study_events(spark, sf), "r1").select("n", F.round("after", 4).alias("after"))


# ── trade tape ───────────────────────────────────────────────────────────────
PRE, POST = HOUR, 2 * HOUR
TAPE = MOVES + f""", tape AS (SELECT ts, seq, ts - ts % {HOUR // 2} AS exch_ts, (k % 5) / 100.0::DOUBLE AS px,
  user_id::DOUBLE AS qty, CASE WHEN k % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side FROM ticks),
w AS (SELECT event_id, t0, dir, tape.* FROM moves JOIN tape ON ts >= t0 - {PRE} AND ts < t0 + {POST}),
c AS (SELECT event_id, t0, exch_ts, count(*) AS n, count(DISTINCT round(px, 4)) AS lv, min(ts) AS first_ts,
  coalesce(sum(qty) FILTER (side = CASE WHEN dir > 0 THEN 'Buy' ELSE 'Sell' END), 0) AS aligned FROM w GROUP BY ALL)"""


def tape(spark, sf):
    t = ticks(spark, sf)
    return t.select("ts", "seq", C.chunk_start(F.col("ts"), HOUR // 2).alias("exch_ts"),
                    (F.col("k") % 5 / 100.0).alias("px"), F.col("user_id").cast("double").alias("qty"),
                    F.when(F.col("k") % 2 == 0, "Buy").otherwise("Sell").alias("side"))


@query("trade_tape_stats", f"""WITH {TAPE}, s AS (SELECT event_id, max((n >= 2 AND lv >= 2)::INT) = 1 AS swept
  FROM c GROUP BY 1)
SELECT event_id, count(*) AS trades, round(sum(qty), 6) AS volume, CAST(count(DISTINCT round(px, 4)) AS INTEGER) AS levels,
  round(coalesce(sum(qty) FILTER (side = CASE WHEN dir > 0 THEN 'Buy' ELSE 'Sell' END), 0) / sum(qty), 6) AS aligned,
  any_value(swept) AS swept FROM w JOIN s USING (event_id) GROUP BY event_id""")
def trade_tape_stats(spark, sf):
    out = S.tape_stats(moves(spark, sf), tape(spark, sf), pre=PRE, post=POST, chunk=2 * DAY)
    return out.select("event_id", "trades", F.col("levels").cast("int").alias("levels"), "swept", *r6("volume", "aligned"))


@query("sweep_timing", f"""WITH {TAPE}
SELECT event_id, min(first_ts) - any_value(t0) AS first_trade,
  arg_max(first_ts, (aligned, -exch_ts)) FILTER (n >= 2 AND lv >= 2) - any_value(t0) AS main_sweep,
  arg_max(aligned, (aligned, -exch_ts)) FILTER (n >= 2 AND lv >= 2) AS sweep_volume,
  arg_max(lv, (aligned, -exch_ts)) FILTER (n >= 2 AND lv >= 2) AS sweep_levels FROM c GROUP BY event_id""")
def sweep_timing(spark, sf):
    return S.sweep_timing(moves(spark, sf), tape(spark, sf), pre=PRE, post=POST, bucket=3 * HOUR)


# ── lead-lag ─────────────────────────────────────────────────────────────────
LAGS = list(range(-3, 4))
XY = GRID_SQL + f""", x AS (SELECT ts, px FROM grid WHERE instrument = 'view'),
xy AS (SELECT y.instrument, y.ts, y.ts // {5 * DAY} AS win, ln(nullif(x.px, 0)) AS lx, ln(nullif(y.px, 0)) AS ly
  FROM grid y JOIN x ON x.ts = y.ts WHERE y.instrument <> 'view' AND x.px IS NOT NULL AND y.px IS NOT NULL),
d AS (SELECT instrument, win, ts, lx - lag(lx) OVER (PARTITION BY instrument ORDER BY ts) AS x,
  ly - lag(ly) OVER (PARTITION BY instrument ORDER BY ts) AS y FROM xy),
lp AS (SELECT instrument, win, lag, x, CASE lag {' '.join(f"WHEN {n} THEN {'lead' if n >= 0 else 'lag'}(y, {abs(n)}) OVER w" for n in LAGS)} END AS y
  FROM d, (SELECT unnest([{', '.join(map(str, LAGS))}]) AS lag) WINDOW w AS (PARTITION BY instrument, lag ORDER BY ts))"""


def pairs(spark, sf):
    g = hourly(spark, sf)
    x = g.filter("instrument = 'view'").select("ts", F.log("px").alias("lx"))
    y = g.filter("instrument <> 'view'").join(x, "ts").withColumn("ly", F.log("px"))
    d = C.previous(y, {"lx": "px0", "ly": "py0"}, by=["instrument"], ts="ts", chunk=5 * DAY)
    return d.select("instrument", "ts", F.expr(f"ts div {5 * DAY}").alias("win"),
                    (F.col("lx") - F.col("px0")).alias("x"), (F.col("ly") - F.col("py0")).alias("y"))


@query("pooled_lead_lag", f"""WITH {TICKS}, {XY}, s AS (
  SELECT instrument, win, lag, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) AS n
  FROM lp WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)
SELECT instrument, lag, CAST(sum(n) AS BIGINT) AS n, round(sum(xy) / sqrt(sum(xx) * sum(yy)), 6) + 0.0 AS corr
FROM s GROUP BY 1, 2""")
def pooled_lead_lag(spark, sf):
    # windows are spans of one series: lag across the series, pool per window
    out = S.pooled_xcorr(pairs(spark, sf), LAGS, by=["instrument"], window="win", ts="ts", step=HOUR,
                         chunk=5 * DAY)
    return out.select("instrument", "lag", "n", *r6("corr"))


@query("centred_lead_lag_peak", f"""WITH {TICKS}, {XY}, c AS (
  SELECT instrument, lag, corr(x, y) AS corr FROM lp GROUP BY 1, 2)
SELECT instrument, arg_max(lag, (corr, -lag)) AS lag, round(max(corr), 6) + 0.0 AS corr FROM c GROUP BY 1""")
def centred_lead_lag_peak(spark, sf):
    x = S.centred_xcorr(pairs(spark, sf), LAGS, by=["instrument"], ts="ts", step=HOUR, chunk=5 * DAY)
    return S.peak(x, ["instrument"]).select("instrument", "lag", *r6("corr"))


# ── probes and feeds ─────────────────────────────────────────────────────────
CHASES = [0.0, 0.5, 1.0, 2.0]


def chase_rows(spark, sf):
    li = lines(spark, sf)
    tid = F.concat_ws("-", "id", F.col("p").cast("string"), F.col("q").cast("string"))
    chase = li.select(tid.alias("trade_id"), ((F.col("n") * 50 - 100) / 100.0).alias("drift_c"))
    pnl = li.filter("n <> 3").select(tid.alias("trade_id"), ((F.col("q") - 25) / 100.0).alias("pnl_net"))
    return chase.distinct(), pnl.distinct()


@query("chase_curve", f"""WITH {LI}, c AS (SELECT DISTINCT id || '-' || p || '-' || q AS t, (n * 50 - 100) / 100.0::DOUBLE AS d,
  CASE WHEN n <> 3 THEN (q - 25) / 100.0::DOUBLE END AS pnl FROM li),
g AS (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS c)
SELECT c AS chase_c, count(*) FILTER (d <= c + 1e-9) AS fills,
  round(count(*) FILTER (d <= c + 1e-9) / count(*), 6) AS fill_rate,
  round(coalesce(sum(pnl) FILTER (d <= c + 1e-9), 0), 4) + 0.0 AS total,
  round(sum(pnl) FILTER (d <= c + 1e-9) / count(*) FILTER (d <= c + 1e-9), 6) + 0.0 AS pnl_fill,
  round(coalesce(sum(pnl) FILTER (d <= c + 1e-9), 0) / count(*), 6) + 0.0 AS pnl_signal,
  round(avg(d) FILTER (d <= c + 1e-9), 6) + 0.0 AS drift
FROM c, g GROUP BY g.c""")
def chase_curve(spark, sf):
    out = S.chase_curve(*chase_rows(spark, sf), CHASES)
    return out.select("chase_c", "fills", F.round("total", 4).alias("total"), *r6(
        "fill_rate", "pnl_fill", "pnl_signal", "drift"))


PROBE = """pr AS (SELECT l_linenumber * 100 AS hold_ms, l_discount * 100 AS gross_c, l_discount * 100 - l_tax * 100 AS net_c,
  l_quantity / 100 AS exit, CASE l_orderkey % 3 WHEN 0 THEN 'maker_fill' WHEN 1 THEN 'reject' ELSE 'timeout' END AS outcome
  FROM lineitem)"""


def probes(spark, sf):
    k = F.col("l_orderkey") % 3
    return table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") * 100).alias("hold_ms"), (F.col("l_discount") * 100).alias("gross_c"),
        (F.col("l_discount") * 100 - F.col("l_tax") * 100).alias("net_c"),
        (F.col("l_quantity") / 100).alias("exit"),
        F.when(k == 0, "maker_fill").when(k == 1, "reject").otherwise("timeout").alias("outcome"))


@query("hold_curve", f"""WITH {PROBE}, a AS (SELECT hold_ms, count(*) AS n, avg(gross_c) AS g, avg(net_c) AS m,
  quantile_cont(net_c, 0.5) AS md, avg(exit) AS e FROM pr GROUP BY 1)
SELECT hold_ms, n, round(g, 6) + 0.0 AS gross_c, round(m, 6) + 0.0 AS net_c, round(md, 6) + 0.0 AS net_median_c,
  round(e, 6) AS exit, hold_ms = (SELECT arg_max(hold_ms, (m, -hold_ms)) FROM a) AS best FROM a""")
def hold_curve(spark, sf):
    return S.hold_curve(probes(spark, sf)).select("hold_ms", "n", "best", *r6(
        "gross_c", "net_c", "net_median_c", "exit"))


@query("maker_exit_mix", f"""WITH {PROBE}
SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM pr), 6) AS share,
  round(avg(net_c), 6) + 0.0 AS gain_c FROM pr GROUP BY 1""")
def maker_exit_mix(spark, sf):
    return S.maker_mix(probes(spark, sf).withColumnRenamed("net_c", "gain_c")).select(
        "outcome", "n", *r6("share", "gain_c"))


@query("feed_quality", f"""WITH {TICKS}, f AS (SELECT instrument, ts + k * 1000 AS recv, ts AS exch, seq FROM ticks),
g AS (SELECT *, recv - lag(recv) OVER (PARTITION BY instrument ORDER BY recv, seq) AS gap, recv - exch AS lat FROM f)
SELECT instrument, count(*) AS n, round(avg(gap), 2) AS gap_mean, round(avg(lat), 4) AS latency_mean,
  round(stddev_pop(lat), 4) AS jitter, round(quantile_cont(gap, 0.5), 2) AS gap_p50, round(quantile_cont(gap, 0.99), 2) AS gap_p99,
  round(quantile_cont(lat, 0.5), 2) AS latency_p50, round(quantile_cont(lat, 0.99), 2) AS latency_p99 FROM g GROUP BY 1""")
def feed_quality(spark, sf):
    t = ticks(spark, sf).select("instrument", (F.col("ts") + F.col("k") * 1000).alias("recv"),
                                F.col("ts").alias("exch"), "seq")
    out = S.feed_quality(t, by=["instrument"], recv="recv", exch="exch", order=["seq"],
                         chunk=2 * DAY)
    return out.select("instrument", "n", F.round("latency_mean", 4).alias("latency_mean"),
                      F.round("jitter", 4).alias("jitter"), *[F.round(c, 2).alias(c) for c in (
                          "gap_mean", "gap_p50", "gap_p99", "latency_p50", "latency_p99")])


@query("spread_stats", f"""WITH {SCORED}, s AS (SELECT instrument, yask - ybid AS s, (yask + ybid) / 2 AS m FROM scored)
SELECT instrument, count(*) AS n, round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(avg(s / m * 1e4), 4) AS bps,
  round(quantile_cont(s, 0.5), 6) AS median FROM s GROUP BY 1""")
def spread_stats(spark, sf):
    b = scored(spark, sf).select("instrument", F.col("ybid").alias("bid"), F.col("yask").alias("ask"))
    return S.spread_stats(b).select("instrument", "n", F.round("bps", 4).alias("bps"), *r6(
        "mean", "min", "median"))


@query("reaction_by_move_size", f"""WITH {TICKS}, m AS (SELECT ts, px AS move FROM ticks WHERE instrument = 'view'),
t AS (SELECT ts FROM ticks WHERE instrument = 'click'),
r AS (SELECT m.move, t.ts - m.ts AS react FROM m ASOF JOIN t ON m.ts < t.ts)
SELECT CASE WHEN move < 10 THEN '0-10' WHEN move < 50 THEN '10-50' ELSE '50-1000' END AS bucket, count(*) AS n,
  round(avg(react), 2) AS mean, round(quantile_cont(react, 0.5), 2) AS median FROM r WHERE move < 1000 GROUP BY 1""")
def reaction_by_move_size(spark, sf):
    t = ticks(spark, sf)
    m = t.filter("instrument = 'view'").select("ts", F.col("px").alias("move"))
    c = t.filter("instrument = 'click'").select("ts")
    out = S.reaction_by_move(m, c, [0, 10, 50, 1000], chunk=5 * DAY)
    return out.select("bucket", "n", F.round("mean", 2).alias("mean"), F.round("median", 2).alias("median"))


@query("gap_move_slope", f"""WITH {SCORED}, n AS (SELECT *, ts + {HOUR} AS want FROM scored),
m AS (SELECT n.instrument, n.gap, s.mid - n.mid AS move FROM n ASOF JOIN scored s ON n.ticker = s.ticker AND n.want <= s.ts)
SELECT instrument, count(*) AS n, round(regr_slope(move, gap), 6) + 0.0 AS slope, count(*) FILTER (abs(gap) > 0.05::DOUBLE) AS n_big,
  round(avg(sign(gap) * move) FILTER (abs(gap) > 0.05::DOUBLE), 6) + 0.0 AS capture FROM m GROUP BY 1""")
def gap_move_slope(spark, sf):
    s = scored(spark, sf)
    rows = asof_join(s, s, by=["ticker"], at=F.col("ts") + HOUR, direction="forward",
                     take={"mid": "later"}, chunk=DAY).filter(F.col("later").isNotNull())
    rows = rows.withColumn("move", F.col("later") - F.col("mid"))
    return S.gap_slope(rows, ["instrument"]).select("instrument", "n", "n_big", *r6("slope", "capture"))


@query("feed_heartbeat", f"""
SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type AS venue, count(*) AS n
FROM events GROUP BY 1, 2""")
def feed_heartbeat(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"),
                                             F.col("event_type").alias("venue"))
    out = S.heartbeat(rows, "6 hours")
    return out.select(F.unix_micros("start").alias("start_us"), "venue", "n")


@query("series_difference", f"""WITH {SCORED}, d AS (SELECT abs(a.fair - b.mid) AS d FROM scored a JOIN scored b
  ON a.ticker = b.ticker AND a.ts = b.ts)
SELECT count(*) AS n, round(max(d), 6) AS max, round(sqrt(avg(d * d)), 6) AS rms, round(quantile_cont(d, 0.99), 6) AS p99 FROM d""")
def series_difference(spark, sf):
    from tickloom.operators import audit
    s = scored(spark, sf)
    out = audit.compare_series(s.select("ticker", "ts", F.col("fair").alias("v")),
                               s.select("ticker", "ts", F.col("mid").alias("v")), "v")
    return out.select("n", *r6("max", "rms", "p99"))


@query("log_sampler_alignment", f"""WITH {SCORED}, logged AS (SELECT ticker, ts + 1000 AS at, fair FROM scored),
g AS (SELECT ticker, ts, spot FROM scored)
SELECT count(*) AS n, count(CASE WHEN l.at + 1000 - g.ts <= {2 * HOUR} THEN 1 END) AS matched,
  round(avg(CASE WHEN l.at + 1000 - g.ts <= {2 * HOUR} THEN g.spot END), 6) AS spot
FROM logged l ASOF LEFT JOIN g ON l.ticker = g.ticker AND l.at + 1000 >= g.ts""")
def log_sampler_alignment(spark, sf):
    s = scored(spark, sf)
    logged = s.select("ticker", (F.col("ts") + 1000).alias("ts"), "fair")
    rows = asof_join(logged, s, by=["ticker"], at=F.col("ts") + 1000,
                     tol=2 * HOUR, take={"spot": "g_spot"}, chunk=DAY)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("g_spot").alias("matched"),
                    F.round(F.avg("g_spot"), 6).alias("spot"))


@query("leg_summaries", f"""WITH {FILLS}
SELECT order_id, side, round(sum(qty), 6) AS qty, round(sum(qty * px) / sum(qty), 10) AS vwap, round(sum(fee), 6) AS fees,
  count(*) AS n_fills, min(ts) AS first_ts, max(ts) AS last_ts FROM fills GROUP BY 1, 2""")
def leg_summaries(spark, sf):
    from tickloom.operators.trades import leg_summary
    return leg_summary(fills(spark, sf), ["order_id", "side"]).select(
        "order_id", "side", "n_fills", "first_ts", "last_ts", *r6("qty", "fees"),
        F.round("vwap", 10).alias("vwap"))


@query("paired_events_split", f"""WITH {SCORED}, e AS (SELECT ticker, min(ts) AS open_ts FROM scored GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY open_ts, ticker) AS i, count(*) OVER () AS n FROM e)
SELECT ticker, CASE WHEN i > n - greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM r""")
def paired_events_split(spark, sf):
    from tickloom.operators.surface import split_events
    e = scored(spark, sf).groupBy("ticker").agg(F.min("ts").alias("open_ts"))
    return split_events(e, 0.1).select("ticker", "split")


@query("usable_events", f"""WITH {SCORED}, m AS (SELECT ticker, max(outc) AS r, count(*) FILTER (tte_s > 300) AS f,
  count(*) FILTER (tte_s <= 300) AS t FROM scored GROUP BY 1)
SELECT ticker, f AS fit_rows, t AS trade_rows FROM m WHERE r = 1 AND f > 40 AND t >= 20""")
def usable_events(spark, sf):
    from tickloom.operators import audit
    s = scored(spark, sf)
    meta = s.groupBy("ticker").agg(F.max("outc").alias("r")).select(
        "ticker", F.lit(100.0).alias("strike"), F.when(F.col("r") == 1, "yes").otherwise("").alias("result"))
    return audit.usable_events(s, meta, fit_above=300, min_fit=40, min_trade=20)


@query("coverage_filter", f"""WITH {SCORED}
SELECT ticker, count(spot) AS n FROM scored GROUP BY 1 HAVING count(spot) >= 66""")
def coverage_filter(spark, sf):
    from tickloom.operators import audit
    s = scored(spark, sf)
    kept = audit.covered(s, "ticker", {"spot": 66})
    return kept.groupBy("ticker").agg(F.count("spot").alias("n"))


@query("per_second_join", """WITH t AS (SELECT event_type AS ticker, epoch_us(ts) // 600000000 AS t, value AS px, event_id AS o FROM events),
l AS (SELECT ticker, t, arg_max(px, o) AS px, count(*) AS c FROM t GROUP BY 1, 2),
r AS (SELECT ticker, min(t) AS lo, max(t) AS hi FROM l GROUP BY 1),
g AS (SELECT ticker, unnest(range(lo, hi + 1)) AS t FROM r), k AS (SELECT *, t * 2.0::DOUBLE AS spot FROM g WHERE t % 7 <> 0)
SELECT k.ticker, k.t, round(k.spot, 2) AS spot, p.px AS prob, coalesce(c.c, 0) AS n_trades
FROM k ASOF JOIN l p ON p.ticker = k.ticker AND k.t >= p.t LEFT JOIN l c ON c.ticker = k.ticker AND c.t = k.t
WHERE k.t - p.t <= 30""")
def per_second_join(spark, sf):
    from tickloom.operators import audit
    t = ticks(spark, sf).select(F.col("instrument").alias("ticker"), F.expr("ts div 600000000").alias("t"),
                                "px", F.col("seq").alias("order"))
    span = t.groupBy("ticker").agg(F.min("t").alias("open_ts"), (F.max("t") + 1).alias("close_ts"))
    secs = span.select("ticker", F.explode(F.sequence("open_ts", F.col("close_ts") - 1)).alias("t"))
    klines = secs.filter("t % 7 <> 0").select("ticker", "t", (F.col("t") * 2.0).alias("spot"))
    out = audit.rows_per_second(t, klines, span, max_age=30, chunk=1000)
    return out.select("ticker", "t", F.round("spot", 2).alias("spot"), "prob", "n_trades")
