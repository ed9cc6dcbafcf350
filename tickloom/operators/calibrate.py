"""Per-event calibration tables: looking up logged fits, and fitting (d_b, d_rho)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def boundaries(tickers: DataFrame, tte_max: int, step: int) -> DataFrame:
    """Refit boundaries of each event, in seconds to expiry: tte_max down to step."""
    return tickers.select("ticker").distinct().withColumn(
        "boundary", F.explode(F.sequence(F.lit(tte_max), F.lit(1), F.lit(-step))))


def calib_at(logged: DataFrame, params: Sequence[str], *, tte_max: int, step: int) -> DataFrame:
    """Logged parameters in force at each boundary.

    Nearest record within half a step (the earlier one on a tie), else the previous
    boundary's, else no row. An event has at most ``tte_max / step`` boundaries.
    """
    half = step / 2
    offset = F.pmod(F.lit(float(tte_max)) - F.col("tte_s"), F.lit(float(step)))
    nearest = F.round((F.lit(float(tte_max)) - F.col("tte_s")) / step)
    # a record exactly half-way serves both neighbours
    slots = F.when(offset == half, F.array(nearest, nearest - 1)).otherwise(F.array(nearest))
    rows = logged.withColumn("_i", F.explode(slots))
    rows = rows.withColumn("boundary", (F.lit(tte_max) - F.col("_i") * step).cast("int"))
    rows = rows.withColumn("_d", F.abs(F.col("tte_s") - F.col("boundary")))
    packed = F.struct(*params)
    best = rows.groupBy("ticker", "boundary").agg(
        F.min_by(packed, F.struct("_d", -F.col("tte_s"))).alias("_p"))
    full = boundaries(logged, tte_max, step).join(best, ["ticker", "boundary"], "left")
    seen = (Window.partitionBy("ticker").orderBy(F.desc("boundary"))
            .rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("_f", F.last("_p", ignorenulls=True).over(seen))
    return full.filter(F.col("_f").isNotNull()).select("ticker", "boundary", "_f.*")
