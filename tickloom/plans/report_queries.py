"""Strategy, calibration and gap reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import buckets as B
from tickloom.operators import reports as R
from tickloom.operators import stats as S
from tickloom.plans.registry import query
from tickloom.plans.roles import FILLS, HOUR, SCORED, TRADES, fills, scored, strategy_trades


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def sql_case(pairs, default):
    body = " ".join(f"WHEN {cond} THEN '{label}'" for cond, label in pairs)
    return f"CASE {body} {'ELSE ' + repr(default) if default else ''} END"


def sql_tte(col, default="other"):
    return sql_case([(f"{col} > {lo} AND {col} <= {hi}", f"{hi}-{lo}s")
                     for hi, lo in B.TTE_BUCKETS], default)


def sql_price(col, default="other"):
    return sql_case([(f"{col} >= {lo}::DOUBLE AND {col} < {hi}::DOUBLE", f"{lo:.2f}-{hi:.2f}")
                     for lo, hi in B.PRICE_BUCKETS], default)


def sql_money(col):
    return sql_case([(f"{col} >= {lo}::DOUBLE AND {col} < {hi}::DOUBLE", name)
                     for name, lo, hi in B.MONEYNESS_BUCKETS], None)


T_SQL = ("round(CASE WHEN count({0}) >= 3 AND stddev_samp({0}) > 0 "
         "THEN avg({0}) / (stddev_samp({0}) / sqrt(count({0}))) END, 6)")
FRESH = "2000-01-01"
PANEL = f"CASE WHEN date < '{FRESH}' THEN 'in_sample' ELSE 'fresh' END"
FILLED = TRADES + """,
filled AS (SELECT * FROM trades WHERE n_try <= 5),
missed AS (SELECT * FROM trades WHERE n_try > 5)"""


def filled_missed(spark, sf):
    t = strategy_trades(spark, sf)
    return t.filter("n_try <= 5"), t.filter("n_try > 5")


@query("strategy_summary", f"""
WITH {FILLED},
ev AS (SELECT {PANEL} AS panel, model, delta, ticker, sum(net) AS net, sum(cost) AS cost,
              sum(won) AS won, sum(slip) AS slip, count(*) AS n FROM filled GROUP BY ALL),
agg AS (SELECT panel, model, delta, CAST(sum(n) AS BIGINT) AS n, count(*) AS events,
        sum(won) / sum(n) AS win_rate, sum(cost) / sum(n) AS cost, sum(net) / sum(n) AS net,
        sum(net) AS total, sum(slip) / sum(n) AS slip, {T_SQL.format('net')} AS t
        FROM ev GROUP BY ALL),
ms AS (SELECT {PANEL} AS panel, model, delta, count(*) AS m FROM missed GROUP BY ALL)
SELECT panel, model, delta, n, events, round(win_rate, 6) AS win_rate, round(cost, 6) AS cost,
       round(net, 6) AS net, round(total, 4) AS total, round(slip, 6) AS slip, t,
       round(n / (n + coalesce(m, 0)), 6) AS fill_rate
FROM agg LEFT JOIN ms USING (panel, model, delta)""")
def strategy_summary(spark, sf):
    done, missed = filled_missed(spark, sf)
    out = R.strategy_summary(R.with_panel(done, FRESH), R.with_panel(missed, FRESH))
    return out.select("panel", "model", "delta", "n", "events", *r6(
        "win_rate", "cost", "net", "slip", "t", "fill_rate"), F.round("total", 4).alias("total"))


@query("strategy_by_date", f"""
WITH {TRADES}
SELECT model, delta, date, count(*) AS n, round(avg(net), 6) + 0.0 AS net
FROM trades GROUP BY ALL""")
def strategy_by_date(spark, sf):
    return R.by_date(strategy_trades(spark, sf)).select("model", "delta", "date", "n", *r6("net"))


CELLS = """, ev AS (SELECT model, delta, {b} AS {name}, ticker, sum(net) AS s, count(*) AS c
       FROM trades GROUP BY ALL)
SELECT model, delta, {name}, CAST(sum(c) AS BIGINT) AS n, count(*) AS events,
       round(sum(s) / sum(c), 6) + 0.0 AS net, {t} AS t FROM ev GROUP BY ALL"""


@query("strategy_by_tte", f"WITH {TRADES}" + CELLS.format(
    b=sql_tte("tte"), name="bucket", t=T_SQL.format("s")))
def strategy_by_tte(spark, sf):
    return R.by_tte(strategy_trades(spark, sf)).select(
        "model", "delta", "bucket", "n", "events", *r6("net", "t"))


@query("strategy_by_price", f"WITH {TRADES}" + CELLS.format(
    b=sql_price("mid0"), name="pbucket", t=T_SQL.format("s")))
def strategy_by_price(spark, sf):
    return R.by_price(strategy_trades(spark, sf)).select(
        "model", "delta", "pbucket", "n", "events", *r6("net", "t"))


@query("fill_rate_by_price", f"""
WITH {TRADES}
SELECT model, delta, {sql_price('mid0')} AS pbucket, count(*) AS signals,
       round(avg(CASE WHEN n_try <= 5 THEN 1 ELSE 0 END), 6) AS fill_rate
FROM trades GROUP BY ALL""")
def fill_rate_by_price(spark, sf):
    return R.fill_rate(*filled_missed(spark, sf)).select(
        "model", "delta", "pbucket", "signals", *r6("fill_rate"))


@query("clustered_t", f"""
WITH {TRADES}, ev AS (SELECT model, ticker, sum(net) AS v FROM trades GROUP BY ALL)
SELECT model, count(*) AS clusters, {T_SQL.format('v')} AS t FROM ev GROUP BY ALL""")
def clustered_t(spark, sf):
    return S.clustered_t(strategy_trades(spark, sf), F.col("net"), by=["model"],
                         cluster="ticker").select("model", "clusters", *r6("t"))


@query("paired_model_difference", f"""
WITH {TRADES}, ev AS (SELECT model, ticker, avg(net) AS v FROM trades GROUP BY ALL),
d AS (SELECT o.model, o.v - b.v AS d FROM ev o JOIN ev b USING (ticker)
      WHERE b.model = 'A' AND o.model <> 'A')
SELECT model, count(*) AS events, round(avg(d), 6) + 0.0 AS mean_d, {T_SQL.format('d')} AS t
FROM d GROUP BY ALL""")
def paired_model_difference(spark, sf):
    ev = strategy_trades(spark, sf).groupBy("model", "ticker").agg(F.avg("net").alias("v"))
    base = ev.filter("model = 'A'").select("ticker", F.col("v").alias("v0"))
    d = ev.filter("model <> 'A'").join(base, "ticker").withColumn("d", F.col("v") - F.col("v0"))
    return d.groupBy("model").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg("d"), 6).alias("mean_d"),
        F.round(S.paired_t(F.col("d")), 6).alias("t"))


@query("daily_sharpe", f"""
WITH {TRADES},
day AS (SELECT {PANEL} AS panel, model, delta, date, sum(net) AS net, sum(cost) AS cost,
        count(*) AS c FROM trades GROUP BY ALL),
agg AS (SELECT panel, model, delta, CAST(sum(c) AS BIGINT) AS n, count(*) AS days,
        avg(net / cost) AS m, stddev_samp(net / cost) AS sd, sum(net) / sum(cost) AS tot
        FROM day WHERE cost > 0 GROUP BY ALL)
SELECT panel, model, delta, n, days, round(m, 6) AS mean_day, round(sd, 6) AS sd_day,
       round(tot, 6) AS total_return, round(m / sd, 6) AS sharpe_day,
       round(m / sd * sqrt(365), 4) AS sharpe_year
FROM agg WHERE days >= 2""")
def daily_sharpe(spark, sf):
    out = R.sharpe(R.with_panel(strategy_trades(spark, sf), FRESH))
    return out.select("panel", "model", "delta", "n", "days", *r6(
        "mean_day", "sd_day", "total_return", "sharpe_day"),
        F.round("sharpe_year", 4).alias("sharpe_year"))


CLIP = "least(greatest({0}, 0.005::DOUBLE), 0.995::DOUBLE)"
LOSS = "-(outc * ln({0}) + (1 - outc) * ln(1 - {0}))"
FC, MC = CLIP.format("fair"), CLIP.format("mid")
BCE = f"""WITH {SCORED}, bce AS (
  SELECT ticker, {sql_tte('tte_s', None)} AS bucket, min(date) AS date, count(*) AS rows,
         avg({LOSS.format(FC)}) AS bce_fair, avg({LOSS.format(MC)}) AS bce_mkt,
         avg(power({FC} - outc, 2)) AS brier_fair, avg(power({MC} - outc, 2)) AS brier_mkt,
         avg(abs(fair - mid)) AS mae
  FROM scored GROUP BY 1, 2 HAVING count(*) >= 3 AND bucket IS NOT NULL)"""


@query("settlement_loss_by_event", BCE + """
SELECT ticker, bucket, date, rows, round(bce_fair, 6) AS bce_fair, round(bce_mkt, 6) AS bce_mkt,
       round(brier_fair, 6) AS brier_fair, round(brier_mkt, 6) AS brier_mkt,
       round(mae, 6) AS mae, round(bce_fair - bce_mkt, 6) + 0.0 AS d FROM bce""")
def settlement_loss_by_event(spark, sf):
    rows = R.bce_rows(scored(spark, sf), B.tte_bucket(F.col("tte_s"), default=None), 3)
    return rows.select("ticker", "bucket", "date", "rows", *r6(
        "bce_fair", "bce_mkt", "brier_fair", "brier_mkt", "mae", "d"))


@query("settlement_loss_report", BCE + f""", d AS (SELECT *, bce_fair - bce_mkt AS d FROM bce)
SELECT bucket, count(*) AS events, round(avg(bce_fair), 6) AS bce_fair,
       round(avg(bce_mkt), 6) AS bce_mkt, round(avg(d), 6) + 0.0 AS d, {T_SQL.format('d')} AS t,
       round(avg(brier_fair), 6) AS brier_fair, round(avg(brier_mkt), 6) AS brier_mkt,
       round(avg(mae), 6) AS mae
FROM d GROUP BY bucket HAVING count(*) >= 3""")
def settlement_loss_report(spark, sf):
    rows = R.bce_rows(scored(spark, sf), B.tte_bucket(F.col("tte_s"), default=None), 3)
    return R.bce_report(rows).select("bucket", "events", *r6(
        "bce_fair", "bce_mkt", "d", "t", "brier_fair", "brier_mkt", "mae"))


@query("settlement_loss_by_price", f"""WITH {SCORED}
SELECT ticker, {sql_price('mid', None)} AS bucket, min(date) AS date, count(*) AS rows,
       round(avg({LOSS.format(FC)}), 6) AS bce_fair, round(avg({LOSS.format(MC)}), 6) AS bce_mkt,
       round(avg(abs(fair - mid)), 6) AS mae
FROM scored WHERE tte_s <= 900 AND tte_s > 0 GROUP BY 1, 2
HAVING count(*) >= 3 AND bucket IS NOT NULL""")
def settlement_loss_by_price(spark, sf):
    rows = scored(spark, sf).filter((F.col("tte_s") <= 900) & (F.col("tte_s") > 0))
    out = R.bce_rows(rows, B.price_bucket(F.col("mid"), default=None), 3)
    return out.select("ticker", "bucket", "date", "rows", *r6("bce_fair", "bce_mkt", "mae"))


@query("closure_attribution", f"""
WITH {TRADES}, s AS (SELECT *, CASE WHEN side_yes = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg
                     FROM trades),
agg AS (
  SELECT model, delta, count(*) AS n, count(close_s) / count(*) AS closed_share,
    avg(100 * gap) FILTER (close_s IS NOT NULL) AS gap0,
    avg(100 * sg * close_dmid) FILTER (close_s IS NOT NULL) AS mkt_move,
    avg(100 * sg * close_dfair) FILTER (close_s IS NOT NULL) AS fair_move,
    avg(100 * sg * close_dfair_fx) FILTER (close_s IS NOT NULL) AS fx_move,
    avg(100 * sg * (close_dfair - close_dfair_fx)) FILTER (close_s IS NOT NULL) AS refit_move,
    avg(net) FILTER (close_s IS NOT NULL AND won = 1) AS net_won,
    avg(net) FILTER (close_s IS NOT NULL AND won = 0) AS net_lost,
    quantile_cont(close_s, 0.5) AS median_s
  FROM s GROUP BY ALL)
SELECT model, delta, n, round(closed_share, 6) AS closed_share, round(gap0, 6) AS gap0,
  round(mkt_move, 6) + 0.0 AS mkt_move, round(fair_move, 6) + 0.0 AS fair_move,
  round(fx_move, 6) + 0.0 AS fx_move, round(refit_move, 6) + 0.0 AS refit_move,
  round(net_won, 6) + 0.0 AS net_won, round(net_lost, 6) + 0.0 AS net_lost,
  round(median_s, 6) AS median_s,
  round(mkt_move / (abs(mkt_move) + abs(fair_move) + 1e-9), 6) + 0.0 AS mkt_share
FROM agg""")
def closure_attribution(spark, sf):
    out = R.closure(strategy_trades(spark, sf), ["model", "delta"])
    return out.select("model", "delta", "n", *r6(
        "closed_share", "gap0", "mkt_move", "fair_move", "fx_move", "refit_move", "net_won",
        "net_lost", "median_s", "mkt_share"))


@query("gap_by_moneyness", f"""
WITH {SCORED}, g AS (SELECT {sql_money('mid')} AS bucket, gap, abs(gap) AS a FROM scored
                     WHERE tte_s > 60 AND tte_s <= 900)
SELECT bucket, count(*) AS n, round(avg(a), 6) AS abs_mean, round(avg(gap), 6) + 0.0 AS signed,
       round(max(a), 6) AS max, round(avg(CAST(a >= 0.03::DOUBLE AS INT)), 6) AS ge_030,
       round(avg(CAST(a >= 0.05::DOUBLE AS INT)), 6) AS ge_050,
       round(quantile_cont(a, 0.5), 6) AS p50, round(quantile_cont(a, 0.9), 6) AS p90,
       round(quantile_cont(a, 0.99), 6) AS p99
FROM g WHERE bucket IS NOT NULL GROUP BY bucket""")
def gap_by_moneyness(spark, sf):
    out = R.gap_by_moneyness(scored(spark, sf), [0.03, 0.05], tte_max=900.0)
    return out.select("bucket", "n", *r6("abs_mean", "signed", "max", "ge_030", "ge_050", "p50",
                                         "p90", "p99"))


@query("gap_summary_windows", f"""
WITH {SCORED}, g AS (
  SELECT ts - ts % {12 * HOUR} AS win, gap, abs(gap) AS a,
         row_number() OVER (PARTITION BY ts - ts % {12 * HOUR} ORDER BY abs(gap)) - 1 AS i,
         count(*) OVER (PARTITION BY ts - ts % {12 * HOUR}) AS n FROM scored)
SELECT win, count(*) AS n, round(avg(gap), 6) + 0.0 AS mean, round(avg(a), 6) AS abs_mean,
       round(max(a), 6) AS max, count(*) FILTER (a >= 0.03::DOUBLE) AS ge_delta,
       round(max(a) FILTER (i = floor(0.5::DOUBLE * (n - 1) + 0.5)), 6) AS p50,
       round(max(a) FILTER (i = floor(0.9::DOUBLE * (n - 1) + 0.5)), 6) AS p90,
       round(max(a) FILTER (i = floor(0.99::DOUBLE * (n - 1) + 0.5)), 6) AS p99
FROM g GROUP BY win""")
def gap_summary_windows(spark, sf):
    rows = scored(spark, sf).withColumn("win", F.col("ts") - F.pmod("ts", F.lit(12 * HOUR)))
    return R.gap_summary(rows, 0.03, ["win"]).select(
        "win", "n", "ge_delta", *r6("mean", "abs_mean", "max", "p50", "p90", "p99"))


BIAS = f"""WITH {SCORED}, bias AS (
  SELECT ticker, count(*) AS rows, avg(fair) - avg(mid) AS bias, avg(mid) AS mean_mid
  FROM scored WHERE tte_s > 60 AND tte_s <= 900 GROUP BY ticker HAVING count(*) >= 20)"""


@query("event_bias", BIAS + """
SELECT ticker, rows, round(bias, 6) + 0.0 AS bias, round(mean_mid, 6) AS mean_mid FROM bias""")
def event_bias(spark, sf):
    return R.event_bias(scored(spark, sf), tte_max=900.0).select(
        "ticker", "rows", *r6("bias", "mean_mid"))


@query("event_bias_report", BIAS + f""", b AS (SELECT *, {sql_money('mean_mid')} AS bucket FROM bias)
SELECT bucket, count(*) AS events, round(avg(abs(bias)), 6) AS abs_bias,
       round(avg(bias), 6) + 0.0 AS signed FROM b WHERE bucket IS NOT NULL GROUP BY bucket""")
def event_bias_report(spark, sf):
    out = R.event_bias_report(R.event_bias(scored(spark, sf), tte_max=900.0))
    return out.select("bucket", "events", *r6("abs_bias", "signed"))


WINDOWS = f"""WITH {SCORED}, w AS (
  SELECT ticker, {sql_tte('tte_s', None)} AS bucket, count(*) AS rows, min(ts) AS ts,
         avg(gap) AS signed, avg(abs(gap)) AS abs_gap
  FROM scored WHERE tte_s > 60 GROUP BY 1, 2 HAVING count(*) >= 3 AND bucket IS NOT NULL)"""


@query("window_signed_gap", WINDOWS + """
SELECT ticker, bucket, rows, ts, round(signed, 6) + 0.0 AS signed, round(abs_gap, 6) AS abs
FROM w""")
def window_signed_gap(spark, sf):
    return R.window_signed(scored(spark, sf), min_rows=3).select(
        "ticker", "bucket", "rows", "ts", *r6("signed", "abs"))


@query("window_sign_flips", WINDOWS + """, f AS (
  SELECT ticker, sign(signed) AS s, lag(sign(signed)) OVER (PARTITION BY ticker ORDER BY ts) AS p
  FROM w)
SELECT count(p) AS pairs, round(avg(CASE WHEN p IS NOT NULL THEN CAST(s <> p AS INT) END), 6)
       AS flip_share FROM f""")
def window_sign_flips(spark, sf):
    from pyspark.sql import Window
    rows = R.window_signed(scored(spark, sf), min_rows=3)
    # an event has at most five windows
    prev = F.lag(F.signum("signed")).over(Window.partitionBy("ticker").orderBy("ts"))
    rows = rows.withColumn("_p", prev)
    flip = F.when(F.col("_p").isNotNull(), (F.signum("signed") != F.col("_p")).cast("int"))
    return rows.agg(F.count("_p").alias("pairs"), F.round(F.avg(flip), 6).alias("flip_share"))


@query("tracking_error_by_minute", f"""
WITH {SCORED}, ev AS (
  SELECT ticker, {sql_tte('tte_s', None)} AS bucket, avg(fair - mid) AS bias,
         avg(abs(fair - mid)) AS mae, sqrt(avg((fair - mid) * (fair - mid))) AS rmse,
         avg({LOSS.format(FC)}) AS bf, avg({LOSS.format(MC)}) AS bm
  FROM scored GROUP BY 1, 2 HAVING count(*) >= 3 AND bucket IS NOT NULL),
d AS (SELECT *, bf - bm AS d FROM ev)
SELECT bucket, count(*) AS events, round(avg(bias), 6) + 0.0 AS bias, round(avg(mae), 6) AS mae,
       round(avg(rmse), 6) AS rmse, round(avg(bf), 6) AS bce_fair, round(avg(bm), 6) AS bce_mkt,
       {T_SQL.format('d')} AS t FROM d GROUP BY bucket""")
def tracking_error_by_minute(spark, sf):
    return R.tracking_error(scored(spark, sf), min_rows=3).select(
        "bucket", "events", *r6("bias", "mae", "rmse", "bce_fair", "bce_mkt", "t"))


MKL, FKL = ("least(greatest(mid, 0.01::DOUBLE), 0.99::DOUBLE)",
            "least(greatest(fair, 0.01::DOUBLE), 0.99::DOUBLE)")


@query("kl_market_fair", f"""
WITH {SCORED}, ev AS (
  SELECT ticker, CASE WHEN tte_s > 60 THEN 'core' ELSE 'last' END AS span,
         avg(-({MKL} * ln({FKL}) + (1 - {MKL}) * ln(1 - {FKL}))
             + ({MKL} * ln({MKL}) + (1 - {MKL}) * ln(1 - {MKL}))) AS kl
  FROM scored WHERE tte_s <= 900 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT span, count(*) AS events, round(avg(kl), 6) AS kl FROM ev GROUP BY span""")
def kl_market_fair(spark, sf):
    return R.kl_report(scored(spark, sf), fit_tte=900.0, min_rows=3).select(
        "span", "events", *r6("kl"))


@query("surface_bce_loss", f"""
WITH {SCORED}, l AS (SELECT instrument, ln(fair / (1 - fair)) AS l, {MKL} AS y FROM scored)
SELECT instrument, count(*) AS rows,
       round(avg(greatest(l, 0) - l * y + ln(1 + exp(-abs(l)))), 6) AS bce
FROM l GROUP BY instrument""")
def surface_bce_loss(spark, sf):
    logit = F.log(F.col("fair") / (1 - F.col("fair")))
    y = S.clip(F.col("mid"), S.P_CLIP, 1 - S.P_CLIP)
    return scored(spark, sf).groupBy("instrument").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(S.bce_with_logits(logit, y)), 6)
        .alias("bce"))


@query("event_weights", f"""
WITH {SCORED}
SELECT seq, count(*) OVER (PARTITION BY ticker) AS n_rows,
       round(1.0::DOUBLE / count(*) OVER (PARTITION BY ticker), 9) AS weight FROM scored""")
def event_weights(spark, sf):
    return S.event_weight(scored(spark, sf), "ticker").select(
        "seq", "n_rows", F.round("weight", 9).alias("weight"))


@query("feature_scaler", f"""
WITH {SCORED}, m AS (
  SELECT avg(spot) AS sm, stddev_pop(spot) + 1e-9 AS ss, avg(gap) AS gm, stddev_pop(gap) + 1e-9 AS gs
  FROM scored)
SELECT seq, round(least(greatest((spot - sm) / ss, -5), 5), 6) + 0.0 AS spot,
       round(least(greatest((gap - gm) / gs, -5), 5), 6) + 0.0 AS gap FROM scored, m""")
def feature_scaler(spark, sf):
    rows = scored(spark, sf).select("seq", "spot", "gap")
    return S.apply_scaler(rows, S.fit_scaler(rows, ["spot", "gap"]), ["spot", "gap"]).select(
        "seq", *r6("spot", "gap"))


@query("veto_counts", f"""
WITH {TRADES}
SELECT model, delta, CASE WHEN tte > 250 THEN 'stale' WHEN tte > 200 THEN 'cooldown' END AS why,
       count(*) AS n FROM trades WHERE tte > 200 GROUP BY ALL""")
def veto_counts(spark, sf):
    why = F.when(F.col("tte") > 250, "stale").when(F.col("tte") > 200, "cooldown")
    return R.veto_counts(strategy_trades(spark, sf).withColumn("why", why).filter(
        F.col("why").isNotNull()))


ENTRY_P = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]


@query("pnl_matrix_price", f"""WITH {TRADES}
SELECT delta, {', '.join(f'round(avg(net) FILTER (cost >= {lo}::DOUBLE AND cost < {hi}::DOUBLE), 6) + 0.0 AS p{i}'
                         for i, (lo, hi) in enumerate(ENTRY_P))}
FROM trades GROUP BY delta""")
def pnl_matrix_price(spark, sf):
    edges = [lo for lo, _ in ENTRY_P] + [1.0]
    labels = [f"p{i}" for i in range(len(ENTRY_P))]
    bucket = B.edge_bucket(F.col("cost"), edges, labels)
    return R.pnl_matrix(strategy_trades(spark, sf), bucket, labels).select("delta", *r6(*labels))


@query("pnl_matrix_tte", f"""WITH {TRADES}
SELECT delta, {', '.join(f'round(avg(net) FILTER (tte > {lo} AND tte <= {hi}), 6) + 0.0 AS t{hi}'
                         for hi, lo in B.TTE_BUCKETS)}
FROM trades GROUP BY delta""")
def pnl_matrix_tte(spark, sf):
    labels = [f"t{hi}" for hi, _ in B.TTE_BUCKETS]
    pairs = [((F.col("tte") > lo) & (F.col("tte") <= hi), f"t{hi}") for hi, lo in B.TTE_BUCKETS]
    return R.pnl_matrix(strategy_trades(spark, sf), B._choose(pairs, None), labels).select(
        "delta", *r6(*labels))


@query("signed_net_exposure", f"""WITH {FILLS}
SELECT market_id, round(sum(CASE WHEN side = 'Buy' THEN qty ELSE -qty END), 6) + 0.0 AS net
FROM fills GROUP BY market_id""")
def signed_net_exposure(spark, sf):
    signed = F.when(F.col("side") == "Buy", F.col("qty")).otherwise(-F.col("qty"))
    return fills(spark, sf).groupBy("market_id").agg(F.round(F.sum(signed), 6).alias("net"))


@query("exact_quantiles_three_ways", f"""WITH {TRADES}, o AS (
  SELECT model, gap, row_number() OVER (PARTITION BY model ORDER BY gap) - 1 AS i,
         count(*) OVER (PARTITION BY model) AS n FROM trades)
SELECT model, round(quantile_cont(gap, 0.9), 9) AS linear_p90,
       round(max(gap) FILTER (i = floor(0.9::DOUBLE * (n - 1) + 0.5)), 9) AS nearest_p90,
       round(max(gap) FILTER (i = floor(0.9::DOUBLE * (n - 1))), 9) AS truncate_p90
FROM o GROUP BY model""")
def exact_quantiles_three_ways(spark, sf):
    spans = S.order_stats(strategy_trades(spark, sf), F.col("gap"), by=["model"])
    return spans.groupBy("model").agg(*[
        F.round(S.pick_quantile(0.9, m), 9).alias(f"{m}_p90")
        for m in ("linear", "nearest", "truncate")])
