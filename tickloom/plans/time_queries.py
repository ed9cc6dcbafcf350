"""As-of, range, grid and window queries, and the event-response slice built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import asof as A
from tickloom.operators import chunks as C
from tickloom.operators import folds
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, HOUR, MINUTE, TICKS, ticks


def pair(spark, sf):
    t = ticks(spark, sf)
    ref = t.filter("instrument = 'view'").select("ts", "seq", "px")
    tgt = t.filter("instrument = 'click'").select("ts", "seq", "px")
    return ref, tgt


PAIR = TICKS + """,
ref AS (SELECT ts, seq, px FROM ticks WHERE instrument = 'view'),
tgt AS (SELECT ts, seq, px FROM ticks WHERE instrument = 'click')"""


@query("asof_backward", f"""
WITH {PAIR}
SELECT r.ts, r.px, t.px AS tgt_px, t.ts AS tgt_ts
FROM ref r ASOF LEFT JOIN tgt t ON r.ts >= t.ts""")
def asof_backward(spark, sf):
    ref, tgt = pair(spark, sf)
    return A.asof_join(ref, tgt, take={"px": "tgt_px"}, chunk=DAY, tie="seq",
                       match_ts="tgt_ts").select("ts", "px", "tgt_px", "tgt_ts")


@query("asof_backward_strict", f"""
WITH {TICKS}
SELECT a.instrument, a.ts, b.ts AS prev_ts, b.px AS prev_px
FROM ticks a ASOF LEFT JOIN ticks b ON a.instrument = b.instrument AND a.ts > b.ts""")
def asof_backward_strict(spark, sf):
    t = ticks(spark, sf)
    return A.asof_join(t, t, by=["instrument"], take={"px": "prev_px"}, strict=True, chunk=DAY,
                       match_ts="prev_ts").select("instrument", "ts", "prev_ts", "prev_px")


@query("asof_tolerance_lag", f"""
WITH {TICKS}, probe AS (SELECT instrument, seq, ts, px, ts - {6 * HOUR} AS want FROM ticks)
SELECT a.instrument, a.seq, a.px,
       CASE WHEN a.want - b.ts <= {2 * HOUR} THEN b.px END AS lag_px,
       CASE WHEN a.want - b.ts <= {2 * HOUR} THEN b.ts END AS lag_ts
FROM probe a ASOF LEFT JOIN ticks b ON a.instrument = b.instrument AND a.want >= b.ts""")
def asof_tolerance_lag(spark, sf):
    t = ticks(spark, sf)
    return A.asof_join(t, t, by=["instrument"], at=F.col("ts") - 6 * HOUR, tol=2 * HOUR,
                       take={"px": "lag_px"}, chunk=DAY, match_ts="lag_ts").select(
        "instrument", "seq", "px", "lag_px", "lag_ts")


@query("asof_latency_offset", f"""
WITH {PAIR}, late AS (SELECT ts + {30 * MINUTE} AS ts, px FROM tgt)
SELECT r.ts, CASE WHEN r.ts - l.ts <= {4 * HOUR} THEN l.px END AS feat
FROM ref r ASOF LEFT JOIN late l ON r.ts >= l.ts""")
def asof_latency_offset(spark, sf):
    ref, tgt = pair(spark, sf)
    return A.asof_join(ref, tgt, take={"px": "feat"}, tol=4 * HOUR, offset=30 * MINUTE,
                       chunk=DAY).select("ts", "feat")


@query("asof_forward_horizon", f"""
WITH {PAIR}, probe AS (SELECT ts, ts + {3 * HOUR} AS want FROM ref)
SELECT p.ts, t.px AS fwd_px, t.ts AS fwd_ts
FROM probe p ASOF LEFT JOIN tgt t ON p.want <= t.ts""")
def asof_forward_horizon(spark, sf):
    ref, tgt = pair(spark, sf)
    return A.asof_join(ref, tgt, at=F.col("ts") + 3 * HOUR, direction="forward",
                       take={"px": "fwd_px"}, chunk=DAY, match_ts="fwd_ts").select(
        "ts", "fwd_px", "fwd_ts")


@query("asof_next_strictly_after", f"""
WITH {TICKS}
SELECT a.instrument, a.seq, b.ts - a.ts AS reaction_us
FROM ticks a ASOF LEFT JOIN ticks b ON a.instrument = b.instrument AND a.ts < b.ts""")
def asof_next_strictly_after(spark, sf):
    t = ticks(spark, sf)
    return A.asof_join(t, t, by=["instrument"], direction="forward", strict=True, take={},
                       chunk=DAY, match_ts="next_ts").select(
        "instrument", "seq", (F.col("next_ts") - F.col("ts")).alias("reaction_us"))


RESPONSE_W, RESPONSE_TOL, RESPONSE_BPS, RESPONSE_GAP = 6 * HOUR, DAY, 10_000.0, 12 * HOUR
RESPONSE_H = [HOUR, 6 * HOUR, 24 * HOUR]
RESPONSE_EDGES = f"""
WITH RECURSIVE {PAIR},
probe AS (SELECT ts, px, ts - {RESPONSE_W} AS want FROM ref),
moved AS (
  SELECT p.ts, p.px,
         CASE WHEN p.want - r.ts <= {RESPONSE_TOL} THEN (p.px / nullif(r.px, 0) - 1) * 10000 END AS bps
  FROM probe p ASOF LEFT JOIN ref r ON p.want >= r.ts),
flags AS (
  SELECT ts, bps, coalesce(abs(bps) >= {RESPONSE_BPS}, false) AS hot,
         coalesce(lag(coalesce(abs(bps) >= {RESPONSE_BPS}, false)) OVER (ORDER BY ts), false) AS was
  FROM moved),
edges AS (SELECT ts, bps, row_number() OVER (ORDER BY ts) AS n FROM flags WHERE hot AND NOT was),
walk AS (
  SELECT n, ts, bps, ts AS kept FROM edges WHERE n = 1
  UNION ALL
  SELECT e.n, e.ts, e.bps, CASE WHEN e.ts - w.kept >= {RESPONSE_GAP} THEN e.ts ELSE w.kept END
  FROM walk w JOIN edges e ON e.n = w.n + 1),
fired AS (SELECT ts, bps FROM walk WHERE kept = ts)"""


def reference_events(spark, sf):
    """Refractory-filtered rising edges of the reference move."""
    ref, tgt = pair(spark, sf)
    moved = A.asof_join(ref, ref, at=F.col("ts") - RESPONSE_W, tol=RESPONSE_TOL,
                        take={"px": "past"}, chunk=5 * DAY)
    moved = moved.withColumn("bps", (F.try_divide("px", "past") - 1) * 10_000)
    edges = folds.rising_edges(moved, F.abs("bps") >= RESPONSE_BPS, by=[], ts="ts", chunk=5 * DAY)
    return folds.refractory(edges.select("ts", "bps").withColumn("key", F.lit(0)), by=["key"],
                            ts="ts", gap=RESPONSE_GAP, chunk=10 * DAY), tgt


@query("refractory_events", RESPONSE_EDGES + """
SELECT ts, round(bps, 4) AS bps FROM fired""")
def refractory_events(spark, sf):
    events, _ = reference_events(spark, sf)
    return events.select("ts", F.round("bps", 4).alias("bps"))


@query("event_response_by_price", RESPONSE_EDGES + f""",
base AS (
  SELECT f.ts, f.bps, t.px AS p0 FROM fired f ASOF JOIN tgt t ON f.ts > t.ts),
horizons AS (SELECT unnest([{', '.join(map(str, RESPONSE_H))}]) AS h),
probes AS (SELECT b.ts, b.bps, b.p0, h, b.ts + h AS want FROM base b, horizons),
ends AS (SELECT p.*, t.px AS p1 FROM probes p ASOF JOIN tgt t ON p.want > t.ts)
SELECT CAST(floor(p0 / 10) * 10 AS BIGINT) AS price_bucket, CAST(h // {HOUR} AS BIGINT) AS horizon_h,
       count(*) AS n, round(avg(sign(bps) * (p1 - p0)), 6) + 0.0 AS mean_move
FROM ends GROUP BY 1, 2""")
def event_response_by_price(spark, sf):
    events, tgt = reference_events(spark, sf)
    base = A.asof_join(events, tgt, strict=True, take={"px": "p0"}, chunk=5 * DAY)
    base = base.filter(F.col("p0").isNotNull())
    probes = base.withColumn("h", F.explode(F.array(*[F.lit(h) for h in RESPONSE_H])))
    ends = A.asof_join(probes, tgt, at=F.col("ts") + F.col("h"), strict=True,
                       take={"px": "p1"}, chunk=5 * DAY)
    move = F.signum("bps") * (F.col("p1") - F.col("p0"))
    return ends.groupBy(
        (F.floor(F.col("p0") / 10) * 10).alias("price_bucket"),
        F.expr(f"h div {HOUR}").alias("horizon_h")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(move), 6).alias("mean_move"))
