"""Statistics shared by the reports: clustered t, exact quantiles, losses, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.chunks import CHUNK, attach_row, chunk_carry
from tickloom.session import materialize

P_CLIP = 0.01
REPORT_CLIP = 0.005


def ratio(num: Column, den: Column) -> Column:
    """Quotient, null on a zero denominator."""
    return num / F.when(den != 0, den)


def clip(x: Column, lo: float, hi: float) -> Column:
    # least and greatest skip nulls; a missing value must stay missing
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def log_loss(p: Column, outcome: Column, eps: float = REPORT_CLIP) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(outcome * F.log(q) + (F.lit(1) - outcome) * F.log(F.lit(1) - q))


def cross_entropy(target: Column, p: Column, eps: float) -> Column:
    t, q = clip(target, eps, 1 - eps), clip(p, eps, 1 - eps)
    return -(t * F.log(q) + (F.lit(1) - t) * F.log(F.lit(1) - q))


def kl_divergence(market: Column, fair: Column, eps: float = P_CLIP) -> Column:
    """Cross-entropy of market and fair minus the entropy of the market."""
    return cross_entropy(market, fair, eps) - cross_entropy(market, market, eps)


def bce_with_logits(logit: Column, target: Column) -> Column:
    return (F.greatest(logit, F.lit(0.0)) - logit * target
            + F.log1p(F.exp(-F.abs(logit))))


def t_stat(mean: Column, sd: Column, n: Column, minimum: int = 3) -> Column:
    """t of a mean; null below ``minimum`` samples or without spread."""
    return F.when((n >= minimum) & (sd > 0), mean / (sd / F.sqrt(n)))


def clustered_t(df: DataFrame, value: Column, *, by: Sequence[str], cluster: str) -> DataFrame:
    """t over cluster sums: rows of one cluster are not independent."""
    sums = df.groupBy(*by, cluster).agg(F.sum(value).alias("_v"))
    return sums.groupBy(*by).agg(
        F.count("_v").alias("clusters"),
        t_stat(F.avg("_v"), F.stddev_samp("_v"), F.count("_v")).alias("t"))


def paired_t(value: Column) -> Column:
    """Aggregate expression: t of paired differences, one row per event."""
    return t_stat(F.avg(value), F.stddev_samp(value), F.count(value))


BANDS = 256


def order_stats(df: DataFrame, value: Column, *, by: Sequence[str], bands: int = BANDS) -> DataFrame:
    """Distinct values per key with the rank span each one fills (``first`` .. ``last`` of ``n``).

    Exact, and never gathers a key in one place: equal values are counted map-side, and counts are
    scanned within value bands whose totals carry over. Band edges are quantiles of a key's own
    distinct values, so bands are alike however the values lie; the edges are approximate, which
    moves work between bands and never changes a rank.
    """
    vals = df.select(*by, value.alias("value")).filter(F.col("value").isNotNull())
    hist = vals.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c"))
    marks = [i / bands for i in range(1, bands)]
    edges = hist.groupBy(*by).agg(F.percentile_approx("value", marks, 20 * bands).alias("_edges"))
    hist = hist.join(edges, list(by)) if by else attach_row(hist, edges)
    # written once: the bands are read twice and must be the same both times
    hist = materialize(hist.withColumn(CHUNK, F.size(F.filter("_edges", lambda e: e < F.col("value"))).cast("long")
                                       ).drop("_edges"), "bands")
    hist = chunk_carry(hist, by, {"_n": F.sum("_c")}, {"_before": ("_n", "sum")})
    frame = (Window.partitionBy(*by, CHUNK).orderBy("value")
             .rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("_before") + F.sum("_c").over(frame)
    total = hist.groupBy(*by).agg(F.sum("_c").alias("n"))
    spans = hist.select(*by, "value", (upto - F.col("_c")).alias("first"),
                        (upto - 1).alias("last"))
    if not by:
        return attach_row(spans, total)
    return spans.join(total, list(by))


def pick_quantile(p: float, method: str) -> Column:
    """Aggregate over ``order_stats`` rows; the three definitions the reports use.

    ``nearest``: index round(p(n-1)); ``truncate``: index int(p(n-1)); ``linear``:
    interpolation between the neighbours of p(n-1).
    """
    pos = F.lit(p) * (F.col("n") - 1)
    if method == "nearest":
        return _at(F.floor(pos + 0.5))
    if method == "truncate":
        return _at(F.floor(pos))
    if method == "linear":
        low = F.floor(pos)
        high = F.least(low + 1, F.col("n") - 1)
        frac = F.max(pos - low)
        return _at(low) + (_at(high) - _at(low)) * frac
    raise ValueError(f"unknown method {method}")


def _at(index: Column) -> Column:
    return F.max(F.when((F.col("first") <= index) & (index <= F.col("last")), F.col("value")))


def quantiles(df: DataFrame, value: Column, probs: dict[str, float], *, by: Sequence[str],
              method: str = "linear") -> DataFrame:
    spans = order_stats(df, value, by=by)
    return spans.groupBy(*by).agg(*[pick_quantile(p, method).alias(n) for n, p in probs.items()])


def event_weight(df: DataFrame, by: str) -> DataFrame:
    """Row count of the event and weight 1/n, joined back so a hot event is not one window."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    return df.join(counts, by).withColumn("weight", F.lit(1.0) / F.col("n_rows"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation (floored by 1e-9) of each column."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mu"), (F.stddev_pop(c) + 1e-9).alias(f"{c}_sd")]
    return df.agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str],
                 limit: float = 5.0) -> DataFrame:
    wide = attach_row(df, scaler)
    for c in columns:
        z = (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd")
        wide = wide.withColumn(c, clip(z, -limit, limit))
    return wide.drop(*[f"{c}_{s}" for c in columns for s in ("mu", "sd")])
