"""Tabular inputs: sampler days, L2 lake, per-second rows, venue prices, features, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import prices as P
from tickloom.sources.csvdays import RANGE_BYTES, read_csv_days


def read_sampler_raw(spark: SparkSession, paths: Sequence[str], features: Sequence[str] = (),
                     range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sampler CSV days. Days written before a column existed give null in it.

    One scan for any number of days, plain or packed: each range of a file is read by the
    header of that file. A path is a file, a folder or a pattern. Text that does not read as
    its type is null. Packed files do not split: convert them once with ``sampler_to_table``.
    """
    wanted = schema.SAMPLER + "".join(f", {c} DOUBLE" for c in features)
    fields = [f.strip().split(" ") for f in wanted.split(",")]
    raw = read_csv_days(spark, paths, [n for n, _ in fields], range_bytes)
    return raw.select(*[F.col(n).try_cast(t).alias(n) for n, t in fields])


def sampler_rows(raw: DataFrame, features: Sequence[str] = (), cb_stale_ms: int = 5000,
                 max_spread: float = 0.15) -> DataFrame:
    """Usable sampler rows with the derived inputs of the models.

    Keeps two-sided uncrossed quotes within the spread limit and the 900 s window. The
    second price is null unless quoted and not older than ``cb_stale_ms``; missing
    features and NaN become null.
    """
    bid, ask, tte = F.col("ybid"), F.col("yask"), F.col("tte_ms") / 1000
    ok = P.valid_book(bid, ask, max_spread) & P.valid_tte(tte)
    sizes = F.col("perp_bid_sz") + F.col("perp_ask_sz")
    cb_ok = ((F.col("cb_bid") > 0) & (F.col("cb_ask") > 0)
             & P.fresh(F.col("cb_age_ms"), cb_stale_ms))
    return raw.filter(ok).select(
        "ticker", "ts_ms", tte.alias("tte_s"),
        ((F.col("perp_bid") + F.col("perp_ask")) / 2).alias("spot"),
        bid, ask, ((bid + ask) / 2).alias("mid"),
        F.when(sizes > 0, (F.col("perp_bid_sz") - F.col("perp_ask_sz"))
               / F.when(sizes > 0, sizes)).alias("imb1"),
        F.when(cb_ok, (F.col("cb_bid") + F.col("cb_ask")) / 2).alias("cb_mid"),
        F.when(F.col("cb_age_ms") >= 0, F.col("cb_age_ms")).alias("cb_age_ms"),
        *[null_nan(F.col(c)).alias(c) for c in features])


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def sampler_to_table(rows: DataFrame, path: str) -> None:
    date = F.to_date(F.timestamp_millis("ts_ms"))
    rows.withColumn("date", date).write.mode("append").partitionBy("date").parquet(path)


def union_days(days: Sequence[DataFrame]) -> DataFrame:
    """Several days as one table; events that span files come together by ticker."""
    out = days[0]
    for day in days[1:]:
        out = out.unionByName(day, allowMissingColumns=True)
    return out


def read_l2(spark: SparkSession, base: str, *, stream: str, venue: str, market: str, symbol: str,
            first: str, last: str) -> DataFrame:
    """Three columns of the snapshot lake, partitions pruned to one symbol and date range."""
    df = spark.read.schema(schema.L2_SNAPSHOT).parquet(base)
    return (df.filter((F.col("stream") == stream) & (F.col("venue") == venue)
                      & (F.col("market") == market) & (F.col("symbol") == symbol))
            .filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
            .select("recv_ts_ns", "bids_json", "asks_json"))


def read_event_rows(spark: SparkSession, base: str) -> DataFrame:
    """Per-second rows joined to the settled event they belong to."""
    rows = spark.read.option("header", True).schema(schema.EVENT_ROWS).csv(f"{base}/rows.csv*")
    meta = (spark.read.option("header", True).schema(schema.EVENTS_META)
            .csv(f"{base}/events_meta.csv").select("ticker", "open_ts", "close_ts", "result"))
    return rows.join(meta, "ticker")


def read_venue_px(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema.VENUE_PX).csv(path)


def read_ticks(spark: SparkSession, base: str, source: str) -> DataFrame:
    df = spark.read.schema(schema.TICKS).csv(f"{base}/{source}.csv")
    return df.select(F.lit(source).alias("instrument"), F.unix_micros("ts").alias("ts"), "mid")


def read_features(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Feature rows keyed by ``t_ms`` or by ``t`` in seconds."""
    raw = spark.read.option("header", True).csv(path)
    return feature_rows(raw, names)


def feature_rows(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    times = [F.expr("try_cast(t_ms AS BIGINT)")] if "t_ms" in raw.columns else []
    if "t" in raw.columns:
        times.append(F.expr("try_cast(t AS BIGINT)") * 1000)
    return raw.select(F.coalesce(*times).alias("t_ms"),
                      *[F.col(c).cast("double").alias(c) for c in names])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return meta_rows(spark.read.option("wholetext", True).text(path))


def meta_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Settled events of a ticker map: strike known and result yes or no."""
    entries = text.select(F.explode(F.from_json(F.col(column), schema.META_CACHE))
                          .alias("ticker", "m"))
    return entries.select("ticker", "m.*").filter(
        F.col("strike").isNotNull() & F.col("result").isin("yes", "no"))
