"""Strategy and calibration reports over trade and scored-row tables.

Reports with an event-clustered t aggregate per event first; everything else in the
row (counts, means, totals) is then derived from the event sums, so each report is
two partial aggregations and needs no distinct counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import buckets as B
from tickloom.operators import stats as S
from tickloom.operators.chunks import attach_row


def with_panel(df: DataFrame, fresh_from: str | None) -> DataFrame:
    """``ALL``, or in-sample and fresh rows by UTC date."""
    if not fresh_from:
        return df.withColumn("panel", F.lit("ALL"))
    return df.withColumn("panel", F.when(F.col("date") < fresh_from, "in_sample")
                         .otherwise("fresh"))


def clustered_cells(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trades, events, mean net and event-clustered t per cell."""
    events = trades.groupBy(*by, "ticker").agg(
        F.sum("net").alias("_net"), F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return events.groupBy(*by).agg(
        n.alias("n"), F.count(F.lit(1)).alias("events"), (F.sum("_net") / n).alias("net"),
        S.t_stat(F.avg("_net"), F.stddev_samp("_net"), F.count(F.lit(1))).alias("t"))


def strategy_summary(trades: DataFrame, misses: DataFrame | None = None,
                     by: Sequence[str] = ("panel", "model", "delta")) -> DataFrame:
    by = list(by)
    events = trades.groupBy(*by, "ticker").agg(
        F.sum("net").alias("_net"), F.sum("cost").alias("_cost"), F.sum("won").alias("_won"),
        F.sum("slip").alias("_slip"), F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    out = events.groupBy(*by).agg(
        n.alias("n"), F.count(F.lit(1)).alias("events"),
        (F.sum("_won") / n).alias("win_rate"), (F.sum("_cost") / n).alias("cost"),
        (F.sum("_net") / n).alias("net"), F.sum("_net").alias("total"),
        (F.sum("_slip") / n).alias("slip"),
        S.t_stat(F.avg("_net"), F.stddev_samp("_net"), F.count(F.lit(1))).alias("t"))
    if misses is None:
        return out
    lost = misses.groupBy(*by).agg(F.count(F.lit(1)).alias("_miss"))
    missed = F.coalesce(F.col("_miss"), F.lit(0))
    return (out.join(lost, by, "left")
            .withColumn("fill_rate", F.col("n") / (F.col("n") + missed)).drop("_miss"))


def by_date(trades: DataFrame) -> DataFrame:
    return trades.groupBy("model", "delta", "date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("net").alias("net"))


def by_tte(trades: DataFrame, buckets=B.TTE_BUCKETS) -> DataFrame:
    rows = trades.withColumn("bucket", B.tte_bucket(F.col("tte"), buckets))
    return clustered_cells(rows, ["model", "delta", "bucket"])


def by_price(trades: DataFrame) -> DataFrame:
    rows = trades.withColumn("pbucket", B.price_bucket(F.col("mid0")))
    return clustered_cells(rows, ["model", "delta", "pbucket"])


def fill_rate(trades: DataFrame, misses: DataFrame) -> DataFrame:
    """Filled over filled plus missed, by entry-price bucket."""
    cols = ["model", "delta", B.price_bucket(F.col("mid0")).alias("pbucket")]
    both = trades.select(*cols, F.lit(1).alias("_f")).unionByName(
        misses.select(*cols, F.lit(0).alias("_f")))
    return both.groupBy("model", "delta", "pbucket").agg(
        F.count(F.lit(1)).alias("signals"), F.avg("_f").alias("fill_rate"))


def bce_rows(scored: DataFrame, bucket: Column, min_rows: int = 20) -> DataFrame:
    """Settlement log-loss, Brier and distance to market per event and bucket."""
    fc = S.clip(F.col("fair"), S.REPORT_CLIP, 1 - S.REPORT_CLIP)
    mc = S.clip(F.col("mid"), S.REPORT_CLIP, 1 - S.REPORT_CLIP)
    o = F.col("outc")
    rows = scored.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    out = rows.groupBy("ticker", "bucket").agg(
        F.min("date").alias("date"), F.count(F.lit(1)).alias("rows"),
        F.avg(S.log_loss(F.col("fair"), o)).alias("bce_fair"),
        F.avg(S.log_loss(F.col("mid"), o)).alias("bce_mkt"),
        F.avg(F.pow(fc - o, 2)).alias("brier_fair"), F.avg(F.pow(mc - o, 2)).alias("brier_mkt"),
        F.avg(F.abs(F.col("fair") - F.col("mid"))).alias("mae"))
    return (out.filter(F.col("rows") >= min_rows)
            .withColumn("d", F.col("bce_fair") - F.col("bce_mkt")))


def bce_report(bce: DataFrame, min_events: int = 3) -> DataFrame:
    """Mean losses and paired t per bucket, buckets with enough events only."""
    return bce.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("events"), F.avg("bce_fair").alias("bce_fair"),
        F.avg("bce_mkt").alias("bce_mkt"), F.avg("d").alias("d"),
        S.paired_t(F.col("d")).alias("t"), F.avg("brier_fair").alias("brier_fair"),
        F.avg("brier_mkt").alias("brier_mkt"), F.avg("mae").alias("mae"),
    ).filter(F.col("events") >= min_events)


def closure(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Who closed the gap: signed market and fair moves from entry to closure, in cents.

    ``fx_move`` is the fair move under the entry calibration, ``refit_move`` the rest.
    """
    by = list(by)
    sign = F.when(F.col("side_yes") == 1, 1.0).otherwise(-1.0)
    closed = F.col("close_s").isNotNull()
    cents = lambda c: F.avg(F.when(closed, 100 * c))
    fx = F.col("close_dfair_fx")
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(closed.cast("int")).alias("closed_share"),
        cents(F.col("gap")).alias("gap0"), cents(sign * F.col("close_dmid")).alias("mkt_move"),
        cents(sign * F.col("close_dfair")).alias("fair_move"),
        cents(sign * fx).alias("fx_move"),
        cents(sign * (F.col("close_dfair") - fx)).alias("refit_move"),
        F.avg(F.when(closed & (F.col("won") == 1), F.col("net"))).alias("net_won"),
        F.avg(F.when(closed & (F.col("won") == 0), F.col("net"))).alias("net_lost"))
    median = S.quantiles(trades.filter(closed), F.col("close_s"), {"median_s": 0.5}, by=by)
    return out.join(median, by, "left").withColumn("mkt_share", F.col("mkt_move") / (
        F.abs("mkt_move") + F.abs("fair_move") + 1e-9))


def gap_by_moneyness(scored: DataFrame, deltas: Sequence[float], tte_min: float = 60.0,
                     tte_max: float = 300.0) -> DataFrame:
    """Distribution of fair minus mid by moneyness of the quote."""
    rows = scored.filter((F.col("tte_s") > tte_min) & (F.col("tte_s") <= tte_max))
    rows = rows.withColumn("bucket", B.moneyness_bucket(F.col("mid"))).filter(
        F.col("bucket").isNotNull())
    size = F.abs("gap")
    base = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("abs_mean"),
        F.avg("gap").alias("signed"), F.max(size).alias("max"),
        *[F.avg((size >= d).cast("int")).alias(f"ge_{int(round(d * 1000)):03d}")
          for d in deltas])
    qs = S.quantiles(rows, size, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by=["bucket"])
    return base.join(qs, "bucket")


def gap_summary(samples: DataFrame, delta: float, by: Sequence[str]) -> DataFrame:
    """Gap distribution per window, nearest-rank percentiles of the magnitude."""
    by, size = list(by), F.abs("gap")
    base = samples.groupBy(*by).agg(
        F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.avg(size).alias("abs_mean"),
        F.max(size).alias("max"), F.sum((size >= delta).cast("long")).alias("ge_delta"))
    qs = S.quantiles(samples, size, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by=by,
                     method="nearest")
    return base.join(qs, by) if by else attach_row(base, qs).filter("n > 0")


def event_bias(scored: DataFrame, tte_min: float = 60.0, tte_max: float = 300.0,
               min_rows: int = 20) -> DataFrame:
    """Mean fair minus mean mid per event over the trading span."""
    span = scored.filter((F.col("tte_s") > tte_min) & (F.col("tte_s") <= tte_max))
    return span.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), (F.avg("fair") - F.avg("mid")).alias("bias"),
        F.avg("mid").alias("mean_mid")).filter(F.col("rows") >= min_rows)


def event_bias_report(bias: DataFrame) -> DataFrame:
    rows = bias.withColumn("bucket", B.moneyness_bucket(F.col("mean_mid")))
    return rows.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("events"), F.avg(F.abs("bias")).alias("abs_bias"),
        F.avg("bias").alias("signed"))


def window_signed(scored: DataFrame, min_rows: int = 20, tte_min: float = 60.0) -> DataFrame:
    """Signed and absolute mean gap per event and expiry-minute window."""
    rows = scored.filter(F.col("tte_s") > tte_min).withColumn(
        "bucket", B.tte_bucket(F.col("tte_s"), default=None))
    return rows.filter(F.col("bucket").isNotNull()).groupBy("ticker", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("ts"), F.avg("gap").alias("signed"),
        F.avg(F.abs("gap")).alias("abs")).filter(F.col("rows") >= min_rows)


def sharpe(trades: DataFrame, by: Sequence[str] = ("panel", "model", "delta"),
           days: float = 365.0) -> DataFrame:
    """Sharpe of daily return on capital (sum of net over sum of cost), annualised."""
    by = list(by)
    daily = trades.groupBy(*by, "date").agg(
        F.sum("net").alias("_net"), F.sum("cost").alias("_cost"), F.count(F.lit(1)).alias("_n"))
    ret = F.when(F.col("_cost") > 0, F.col("_net") / F.when(F.col("_cost") > 0, F.col("_cost")))
    daily = daily.withColumn("_r", ret)
    out = daily.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count("_r").alias("days"), F.avg("_r").alias("mean_day"),
        F.stddev_samp("_r").alias("sd_day"),
        S.ratio(F.sum("_net"), F.sum("_cost")).alias("total_return"))
    day = F.when(F.col("sd_day") > 0, F.col("mean_day") / F.when(
        F.col("sd_day") > 0, F.col("sd_day")))
    return (out.filter(F.col("days") >= 2).withColumn("sharpe_day", day)
            .withColumn("sharpe_year", F.col("sharpe_day") * F.lit(days) ** 0.5))


def tracking_error(scored: DataFrame, min_rows: int = 20) -> DataFrame:
    """Fair against market per expiry minute, each event weighing the same."""
    err, o = F.col("fair") - F.col("mid"), F.col("outc")
    rows = scored.withColumn("bucket", B.tte_bucket(F.col("tte_s"), default=None))
    events = rows.filter(F.col("bucket").isNotNull()).groupBy("ticker", "bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(err).alias("bias"),
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(S.log_loss(F.col("fair"), o)).alias("bce_fair"),
        F.avg(S.log_loss(F.col("mid"), o)).alias("bce_mkt")).filter(F.col("_n") >= min_rows)
    d = F.col("bce_fair") - F.col("bce_mkt")
    return events.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("events"),
        *[F.avg(c).alias(c) for c in ("bias", "mae", "rmse", "bce_fair", "bce_mkt")],
        S.paired_t(d).alias("t"))


def kl_report(scored: DataFrame, fit_tte: float = 300.0, min_rows: int = 30) -> DataFrame:
    """KL of market against fair, per event then averaged: core window and last minute."""
    rows = scored.filter(F.col("tte_s") <= fit_tte).withColumn(
        "span", F.when(F.col("tte_s") > 60, "core").otherwise("last"))
    events = rows.groupBy("ticker", "span").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(S.kl_divergence(F.col("mid"), F.col("fair"))).alias("_kl"))
    return events.filter(F.col("_n") >= min_rows).groupBy("span").agg(
        F.count(F.lit(1)).alias("events"), F.avg("_kl").alias("kl"))


def veto_counts(vetoes: DataFrame) -> DataFrame:
    return vetoes.groupBy("model", "delta", "why").agg(F.count(F.lit(1)).alias("n"))


def pnl_matrix(trades: DataFrame, bucket: Column, labels: Sequence[str]) -> DataFrame:
    """Mean net per threshold and bucket, one column per bucket."""
    return (trades.withColumn("_b", bucket).groupBy("delta")
            .pivot("_b", list(labels)).agg(F.avg("net")))


def capped_closure(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moves from entry to closure or a fixed horizon, whichever is first, in cents.

    Trades that never close count with what they had moved by the horizon (``n`` of
    ``trades``); groups without any such trade are left out. ``residual`` is the gap still open
    then. ``fx_move`` and ``refit_move`` split the fair move over the ``n_fx`` trades whose fair
    value under the entry calibration is known (``cap_dfair_fx``). Net results are per trade,
    not in cents, of those won and lost.
    """
    sign = F.when(F.col("side_yes") == 1, 1.0).otherwise(-1.0)
    known = F.col("cap_s").isNotNull()
    cents = lambda c: F.avg(F.when(known, 100 * c))
    fx = F.when(known, F.col("cap_dfair_fx"))
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count(F.when(known, 1)).alias("n"),
        cents(F.col("gap")).alias("gap0"), cents(sign * F.col("cap_dmid")).alias("mkt_move"),
        cents(sign * F.col("cap_dfair")).alias("fair_move"), F.count(fx).alias("n_fx"),
        F.avg(100 * sign * fx).alias("fx_move"),
        F.avg(100 * sign * (F.col("cap_dfair") - fx)).alias("refit_move"),
        F.avg(F.when(known & (F.col("won") == 1), F.col("net"))).alias("net_won"),
        F.avg(F.when(known & (F.col("won") == 0), F.col("net"))).alias("net_lost"))
    return out.filter(F.col("n") > 0).withColumn(
        "residual", F.col("gap0") - (F.col("mkt_move") - F.col("fair_move")))
