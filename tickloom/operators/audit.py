"""Row selection for studies and comparisons between two versions of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import stats as S
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import attach_row


def usable_events(rows: DataFrame, meta: DataFrame, *, fit_above: float = 300.0,
                  min_fit: int = 2000, min_trade: int = 1000) -> DataFrame:
    """Settled events with enough rows before and inside the trading window."""
    counts = rows.groupBy("ticker").agg(
        F.count(F.when(F.col("tte_s") > fit_above, 1)).alias("fit_rows"),
        F.count(F.when(F.col("tte_s") <= fit_above, 1)).alias("trade_rows"))
    done = meta.filter(F.col("strike").isNotNull() & F.col("result").isin("yes", "no"))
    enough = (F.col("fit_rows") > min_fit) & (F.col("trade_rows") >= min_trade)
    return counts.filter(enough).join(done.select("ticker"), "ticker", "left_semi")


def covered(rows: DataFrame, by: str, needs: dict[str, int]) -> DataFrame:
    """Rows of the keys that have at least so many non-null values in each column."""
    counts = rows.groupBy(by).agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(needs)])
    ok = F.lit(True)
    for i, least in enumerate(needs.values()):
        ok = ok & (F.col(f"_n{i}") >= least)
    return rows.join(counts.filter(ok).select(by), by, "left_semi")


def tickers_across(venue_px: DataFrame, venues: list[str], mode: str = "all") -> DataFrame:
    """Tickers quoted on all of the venues, or on any of them."""
    seen = venue_px.filter(F.col("venue").isin(*venues)).select("ticker", "venue").distinct()
    counts = seen.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    least = len(venues) if mode == "all" else 1
    return counts.filter(F.col("_n") >= least).select("ticker")


def rows_per_second(trades: DataFrame, klines: DataFrame, meta: DataFrame, *, max_age: int = 30,
                    chunk: int) -> DataFrame:
    """Training rows: seconds with a candle and a trade at most ``max_age`` seconds old.

    ``trades(ticker, t, px, order)``, ``klines(ticker, t, spot)``, ``meta(ticker, open_ts,
    close_ts, ...)``; the count is of trades within the second itself.
    """
    last = trades.groupBy("ticker", "t").agg(F.max_by("px", "order").alias("px"),
                                             F.count(F.lit(1)).alias("n_trades"))
    rows = klines.join(meta, "ticker").filter(
        (F.col("t") >= F.col("open_ts")) & (F.col("t") < F.col("close_ts")))
    rows = asof_join(rows, last, by=["ticker"], ts="t", tol=max_age, chunk=chunk,
                     take={"px": "prob", "n_trades": "_n"}, match_ts="_at")
    rows = rows.filter(F.col("prob").isNotNull())
    own = F.when(F.col("_at") == F.col("t"), F.col("_n")).otherwise(0)
    return rows.withColumn("tte_s", F.col("close_ts") - F.col("t")).withColumn(
        "n_trades", own.cast("long")).drop("_n", "_at")


def compare_series(a: DataFrame, b: DataFrame, value: str, *, keys=("ticker", "ts")) -> DataFrame:
    """Joined count, largest and root-mean-square absolute difference, 99th percentile."""
    both = a.select(*keys, F.col(value).alias("_a")).join(
        b.select(*keys, F.col(value).alias("_b")), list(keys))
    rows = both.withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("max"),
                   F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"))
    q = S.quantiles(rows, F.col("_d"), {"p99": 0.99}, by=[])
    return attach_row(out, q)


def error_summary(errors: DataFrame, column: str) -> DataFrame:
    """Count, median, 90th percentile and maximum of an absolute error."""
    rows = errors.select(F.abs(column).alias("_e"))
    out = rows.agg(F.count("_e").alias("n"), F.max("_e").alias("max"))
    q = S.quantiles(rows, F.col("_e"), {"median": 0.5, "p90": 0.9}, by=[])
    return attach_row(out, q)
