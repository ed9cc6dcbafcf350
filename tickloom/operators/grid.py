"""Regular grids, per-second samples and row-to-row rules on one series per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import chunks as C


def bucket_pick(df: DataFrame, values: Sequence[str], *, by: Sequence[str], ts: str, step: int,
                order: Sequence[str] = (), which: str = "last") -> DataFrame:
    """First or last row of each ``step`` bucket; ``bucket`` is the bucket start."""
    packed = F.struct(ts, *values)
    at = F.struct(ts, *order)
    pick = F.max_by(packed, at) if which == "last" else F.min_by(packed, at)
    rows = df.withColumn("bucket", C.chunk_start(F.col(ts), step))
    return rows.groupBy(*by, "bucket").agg(pick.alias("_r")).select(*by, "bucket", "_r.*")


def dense_grid(df: DataFrame, *, by: Sequence[str], step: int, chunk: int,
               at: str = "bucket") -> DataFrame:
    """Every bucket between the first and the last one of a key.

    Unfolded in two levels (chunks, then buckets of a chunk), so no row ever holds an
    array longer than a chunk.
    """
    if chunk % step:
        raise ValueError("chunk must be a multiple of step")
    ends = df.groupBy(*by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    first, last = C.chunk_start(F.col("_lo"), chunk), C.chunk_start(F.col("_hi"), chunk)
    spans = ends.withColumn("_c", F.explode(F.sequence(first, last, F.lit(chunk))))
    spans = spans.repartition(*by, "_c")
    lo = F.greatest("_lo", "_c")
    hi = F.least(F.col("_hi"), F.col("_c") + F.lit(chunk - step))
    return spans.select(*by, F.explode(F.sequence(lo, hi, F.lit(step))).alias(at))


def resample(df: DataFrame, value: str, *, by: Sequence[str], ts: str, step: int, chunk: int,
             order: Sequence[str] = (), label: str = "start", fill: bool = True) -> DataFrame:
    """Last value per bucket on a dense grid, forward filled.

    A bucket labelled by its start sees ticks up to ``start + step``; use ``label='end'``
    where the grid must not look ahead.
    """
    last = bucket_pick(df, [value], by=by, ts=ts, step=step, order=order).drop(ts)
    full = dense_grid(last, by=by, step=step, chunk=chunk)
    rows = full.join(last, [*by, "bucket"], "left")
    if fill:
        rows = C.fill_forward(rows, {value: "_f"}, by=by, ts="bucket", chunk=chunk)
        rows = rows.drop(value).withColumnRenamed("_f", value)
    at = F.col("bucket") + (step if label == "end" else 0)
    return rows.select(*by, at.alias(ts), value)


def interpolate(df: DataFrame, value: str, *, by: Sequence[str], ts: str, step: int, limit: int,
                chunk: int) -> DataFrame:
    """Linear fill of at most ``limit`` missing grid rows in a row; a trailing gap carries on."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"),
                                                      F.col(value).alias("v")))
    rows = df.withColumn("_k", known).withColumn("_neg", -F.col(ts))
    rows = C.fill_forward(rows, {"_k": "_p"}, by=by, ts=ts, chunk=chunk)
    rows = C.fill_forward(rows, {"_k": "_n"}, by=by, ts="_neg", chunk=chunk)
    steps = (F.col(ts) - F.col("_p.t")) / step
    span = F.col("_n.t") - F.col("_p.t")
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (
        F.col(ts) - F.col("_p.t")) / F.when(span > 0, span)
    filled = F.when(steps <= limit, F.coalesce(between, F.col("_p.v")))
    out = F.coalesce(F.col(value), filled)
    return rows.withColumn(value, out).drop("_k", "_neg", "_p", "_n")


def dedupe_last(df: DataFrame, *, by: Sequence[str], ts: str, order: Sequence[str]) -> DataFrame:
    """One row per key and time, the last in ``order``."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return (df.groupBy(*by, ts).agg(F.max_by(packed, F.struct(*order)).alias("_r"))
            .select("_r.*"))


def changes(df: DataFrame, value: str, *, by: Sequence[str], ts: str, order: Sequence[str] = (),
            chunk: int, eps: float = 1e-9) -> DataFrame:
    """Rows whose value differs from the row before; the first known value counts."""
    rows = C.previous(df, {value: "_p"}, by=by, ts=ts, order=order, chunk=chunk)
    moved = F.col("_p").isNull() | (F.abs(F.col(value) - F.col("_p")) > eps)
    return rows.filter(F.col(value).isNotNull() & moved).drop("_p")


def run_length(df: DataFrame, cond: Column, out: str, *, by: Sequence[str], ts: str,
               order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Number of consecutive rows, ending here, on which ``cond`` held."""
    rows = df.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    rows = C.running_sum(rows, F.lit(1), "_i", by=by, ts=ts, order=order, chunk=chunk)
    rows = rows.withColumn("_off", F.when(~F.col("_ok"), F.col("_i")))
    rows = C.fill_forward(rows, {"_off": "_last"}, by=by, ts=ts, order=order, chunk=chunk)
    return rows.withColumn(out, F.col("_i") - F.coalesce("_last", F.lit(0))).drop(
        "_ok", "_i", "_off", "_last")


def sequence_epochs(df: DataFrame, gap: Column, out: str, *, by: Sequence[str], ts: str,
                    order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Epoch number: running count of sequence gaps."""
    return C.running_sum(df, F.coalesce(gap, F.lit(False)).cast("long"), out, by=by, ts=ts,
                         order=order, chunk=chunk)


def rank_markets(df: DataFrame, reference: Column, *, by: str = "series", n: int) -> DataFrame:
    """Nearest settlement first, within it nearest strike; role current or upcoming_i.

    Only the best ``n`` of each bucket can be among the best ``n`` of the series, so the
    candidates are cut per (series, settlement hour spread) before the final ranking.
    """
    dist = F.abs(F.col("strike") - reference)
    rows = df.withColumn("_d", F.coalesce(dist, F.lit(0.0)))
    order = [F.col("close_ts"), F.col("_d"), F.col("ticker")]
    spread = F.pmod(F.xxhash64("ticker"), F.lit(16))
    rows = rows.withColumn("_s", spread)
    part = Window.partitionBy(by, "_s").orderBy(*order)
    rows = rows.withColumn("_k", F.row_number().over(part)).filter(F.col("_k") <= n)
    final = Window.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)
    role = F.when(F.col("rank") == 1, "current").otherwise(
        F.concat(F.lit("upcoming_"), (F.col("rank") - 1).cast("string")))
    return rows.withColumn("role", role).drop("_d", "_s", "_k")


def grid_return(df: DataFrame, value: str, n: int, out: str, *, by: Sequence[str], ts: str,
                step: int, chunk: int) -> DataFrame:
    """Log return over ``n`` grid rows; the grid is dense, so the lag is an exact time."""
    rows = C.with_halo(df, ts, chunk, before=n * step)
    lag = F.lag(F.log(value), n).over(C.chunk_window(by, ts))
    return C.drop_halo(rows.withColumn(out, F.log(value) - lag))


def forward_changes(df: DataFrame, value: str, horizons: dict[str, int], *, by: Sequence[str],
                    ts: str, step: int, chunk: int) -> DataFrame:
    """Change of ``value`` after n grid rows, one column per horizon."""
    rows = C.with_halo(df, ts, chunk, after=max(horizons.values()) * step)
    win = C.chunk_window(by, ts)
    for out, n in horizons.items():
        rows = rows.withColumn(out, F.lead(value, n).over(win) - F.col(value))
    return C.drop_halo(rows)


def exact_lag(df: DataFrame, columns: dict[str, tuple[str, int]], *, by: Sequence[str],
              t: str = "t") -> DataFrame:
    """Value at exactly ``t - k`` of the same key, null if that time is absent."""
    out = df
    for name, (source, k) in columns.items():
        past = df.select(*by, (F.col(t) + k).alias(t), F.col(source).alias(name))
        out = out.join(past, [*by, t], "left")
    return out
