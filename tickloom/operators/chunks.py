"""Time chunking: the layout that keeps one hot series from landing in one task.

A window partitioned by instrument alone puts the whole instrument in one task.
Every ordered operator here partitions by ``(key, chunk)`` instead, where a chunk
is a fixed span of time, and brings in what it needs from the neighbours:

* a bounded look-back or look-ahead copies the rows near a chunk edge into the
  next chunk (``with_halo``);
* an unbounded one reduces each chunk to one summary row, scans that small table
  per key, and joins the running value back (``chunk_carry``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
HOME = "_home"


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Columns of a one-row table on every row, as scalar subqueries instead of a join."""
    return df.select("*", *[row.select(c).scalar().alias(c) for c in row.columns])


def chunk_start(ts: Column, length: int) -> Column:
    """Start of the chunk holding ``ts``; integer arithmetic, exact for nanoseconds."""
    return ts - F.pmod(ts, F.lit(length))


def with_chunk(df: DataFrame, ts: str, length: int) -> DataFrame:
    return df.withColumn(CHUNK, chunk_start(F.col(ts), length))


def with_halo(df: DataFrame, ts: str, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy each row into every chunk that may look back ``before`` or ahead ``after`` to it.

    ``_home`` marks the one copy that lives in its own chunk; keep only those rows
    once the window has been evaluated.
    """
    t = F.col(ts)
    first = chunk_start(t - F.lit(after), length)
    final = chunk_start(t + F.lit(before), length)
    spread = df.withColumn(CHUNK, F.explode(F.sequence(first, final, F.lit(length))))
    return spread.withColumn(HOME, F.col(CHUNK) == chunk_start(t, length))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col(HOME)).drop(CHUNK, HOME)


def chunk_window(by: Sequence[str], *order) -> Window:
    return Window.partitionBy(*by, CHUNK).orderBy(*order)


def chunk_carry(df: DataFrame, by: Sequence[str], summary: dict[str, Column],
                running: dict[str, tuple[str, str]]) -> DataFrame:
    """Join onto each row the state its chunk starts with.

    ``summary`` reduces one chunk to one row (partial aggregation runs map-side);
    ``running`` maps an output name to ``(summary column, how)`` with how one of
    ``sum`` (exclusive running total), ``min`` (smallest so far) or ``last`` (latest
    non-null), each over the chunks before this one.
    The scanned table has one row per key and chunk.
    """
    keys = [*by, CHUNK]
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in summary.items()])
    earlier = (Window.partitionBy(*(by or [F.lit(0)])).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    outs = []
    for name, (source, how) in running.items():
        if how == "sum":
            outs.append(F.coalesce(F.sum(source).over(earlier), F.lit(0)).alias(name))
        elif how == "min":
            outs.append(F.min(source).over(earlier).alias(name))
        elif how == "last":
            outs.append(F.last(source, ignorenulls=True).over(earlier).alias(name))
        else:
            raise ValueError(f"unknown carry {how}")
    carried = table.select(*keys, *outs)
    return df.join(carried, keys, "left")


def running_sum(df: DataFrame, value: Column, out: str, *, by: Sequence[str], ts: str,
                order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Running total per key in time order, current row included."""
    base = with_chunk(df.withColumn("_v", value), ts, chunk)
    base = chunk_carry(base, by, {"_total": F.sum("_v")}, {"_before": ("_total", "sum")})
    frame = chunk_window(by, ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_before") + F.coalesce(F.sum("_v").over(frame), F.lit(0))
    return base.withColumn(out, total).drop("_v", "_before", CHUNK)


def running_sum_min(df: DataFrame, value: Column, total: str, low: str, *, by: Sequence[str],
                    ts: str, order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Running total and the lowest it has been so far, current row included in both."""
    base = with_chunk(df.withColumn("_v", value), ts, chunk)
    frame = chunk_window(by, ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_local", F.sum("_v").over(frame))
    keys = [*by, CHUNK]
    table = base.groupBy(*keys).agg(F.sum("_v").alias("_t"), F.min("_local").alias("_m"))
    earlier = (Window.partitionBy(*(by or [F.lit(0)])).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    table = table.withColumn("_opening", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    table = table.withColumn("_floor", F.min(F.col("_opening") + F.col("_m")).over(earlier))
    base = base.join(table.select(*keys, "_opening", "_floor"), keys, "left")
    base = base.withColumn(total, F.col("_opening") + F.col("_local"))
    return base.withColumn(low, F.least(F.min(total).over(frame), F.col("_floor"))).drop(
        "_v", "_local", "_opening", "_floor", CHUNK)


def previous(df: DataFrame, columns: dict[str, str], *, by: Sequence[str], ts: str,
             order: Sequence[str] = (), chunk: int) -> DataFrame:
    """``lag`` by one row per key; ``columns`` maps source to output name."""
    base = with_chunk(df, ts, chunk)
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)])
    base = chunk_carry(
        base.withColumn("_row", packed), by,
        {"_tail": F.max_by("_row", F.struct(ts, *order))}, {"_prior": ("_tail", "last")})
    win = chunk_window(by, ts, *order)
    base = base.withColumn("_prev", F.coalesce(F.lag("_row").over(win), F.col("_prior")))
    for i, out in enumerate(columns.values()):
        base = base.withColumn(out, F.col(f"_prev.f{i}"))
    return base.drop("_row", "_prior", "_prev", CHUNK)


def fill_forward(df: DataFrame, columns: dict[str, str], *, by: Sequence[str], ts: str,
                 order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Latest non-null value at or before each row; ``columns`` maps source to output."""
    base = with_chunk(df, ts, chunk)
    at = F.struct(ts, *order)
    summary, running = {}, {}
    for i, source in enumerate(columns):
        known = F.col(source).isNotNull()
        summary[f"_s{i}"] = F.max_by(F.col(source), F.when(known, at))
        running[f"_c{i}"] = (f"_s{i}", "last")
    base = chunk_carry(base, by, summary, running)
    frame = chunk_window(by, ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    for i, (source, out) in enumerate(columns.items()):
        base = base.withColumn(out, F.coalesce(
            F.last(source, ignorenulls=True).over(frame), F.col(f"_c{i}")))
    return base.drop(CHUNK, *running)


def fill_max(df: DataFrame, value: str, out: str, *, by: Sequence[str] = (), ts: str, order: Sequence[str] = (),
             chunk: int) -> DataFrame:
    """Largest ``value`` (a number) at or before each row."""
    base = with_chunk(df.withColumn("_v", -F.col(value)), ts, chunk)
    base = chunk_carry(base, by, {"_low": F.min("_v")}, {"_before": ("_low", "min")})
    frame = chunk_window(by, ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    return base.withColumn(out, -F.least(F.min("_v").over(frame), F.col("_before"))).drop("_v", "_before", CHUNK)


def trailing(df: DataFrame, aggregates: dict[str, Column | tuple[str, str]], *, by: Sequence[str], ts: str,
             span: int, until: int = 0, chunk: int) -> DataFrame:
    """Aggregates over rows with time in ``[ts - span, ts - until]`` of the same key.

    ``(how, column)`` with how one of ``avg``, ``sum`` or ``count`` (of non-null values) is put
    together from running totals, so a row costs the same however many its window holds. A Column
    is any aggregate, evaluated over a frame: every row then walks all rows of its window.
    """
    frames = {out: agg for out, agg in aggregates.items() if isinstance(agg, Column)}
    totals = {out: agg for out, agg in aggregates.items() if out not in frames}
    base = _trailing_totals(df, totals, by=by, ts=ts, span=span, until=until) if totals else df
    if frames:
        base = with_halo(base, ts, chunk, before=span)
        frame = chunk_window(by, ts).rangeBetween(-span, -until)
        for out, agg in frames.items():
            base = base.withColumn(out, agg.over(frame))
        base = drop_halo(base)
    return base.select(*df.columns, *aggregates)


def _trailing_totals(df: DataFrame, aggregates: dict[str, tuple[str, str]], *, by: Sequence[str], ts: str,
                     span: int, until: int) -> DataFrame:
    """Sums and counts over ``[ts - span, ts - until]``, without subtracting one total from another.

    Time is cut into blocks just as long as the window, which so holds the end of one block and the
    start of the next: a running total up to its end plus one, in reversed time, down to its start.
    """
    length = span - until + 1  # whole instants, both ends included
    columns = list(dict.fromkeys(c for _, c in aggregates.values()))
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    rows = df.filter(F.col(ts).isNotNull())
    data = rows.select(*keys, F.col(ts).alias("_t"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    place = [f"_k{i}" for i in range(len(by))] + [CHUNK]

    def total(rows: DataFrame, at: Column, order: Column, name: str) -> DataFrame:
        """Adds ``_{name}_s0``, ``_{name}_n0``, ...: totals of the block of ``at``, in ``order`` as far as ``at``."""
        probes = rows.select(*keys, at.alias("_t"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
        both = with_chunk(probes.unionByName(data, allowMissingColumns=True), "_t", length)
        frame = Window.partitionBy(*place).orderBy(order).rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        sums = [f(f"_v{i}").over(frame).alias(f"_{name}_{x}{i}") for i in range(len(columns))
                for x, f in (("s", F.sum), ("n", F.count))]
        return both.select("_row", *sums).filter(F.col("_row").isNotNull()).select(
            "_row.*", *[f"_{name}_{x}{i}" for i in range(len(columns)) for x in "sn"])

    start, end = F.col(ts) - F.lit(span), F.col(ts) - F.lit(until)
    out = total(rows, end, F.col("_t").asc(), "to")
    out = total(out, start, F.col("_t").desc(), "from")
    one = F.pmod(start, F.lit(length)) == 0  # the window is a block
    for name, (how, column) in aggregates.items():
        i = columns.index(column)
        n = F.col(f"_to_n{i}") + F.when(one, F.lit(0)).otherwise(F.col(f"_from_n{i}"))
        head, tail = F.col(f"_to_s{i}"), F.when(~one, F.col(f"_from_s{i}"))
        both = F.coalesce(head + tail, head, tail)
        if how not in ("avg", "sum", "count"):
            raise ValueError(f"unknown total {how}")
        out = out.withColumn(name, n if how == "count" else both if how == "sum" else both / F.when(n > 0, n))
    return out
