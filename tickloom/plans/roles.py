"""Stand-in tables: the engine's roles played by the given star-schema tables.

Every registered query starts from one of these. Each role exists twice, as a
DataFrame and as the SQL text the oracle starts from, and scales with its source.
Times are microseconds since the epoch, as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; their clock carries no zone and is read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price series per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), micros("ts").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("px"), "user_id",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))


TICKS = """ticks AS (
  SELECT event_type AS instrument, epoch_us(ts) AS ts, event_id AS seq, value AS px, user_id,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k
  FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted and scored rows: one event per instrument and day, 900 s long on its own clock.

    The day stands for the event window, so one event second is 96 s of the source.
    """
    t = ticks(spark, sf_dir)
    day = F.col("ts") - F.pmod("ts", F.lit(DAY))
    date = F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd")
    tte = (F.lit(DAY) - F.pmod("ts", F.lit(DAY))) / F.lit(96e6)
    half = F.lit(0.005) + F.lit(0.001) * F.pmod("seq", F.lit(10))
    mid = F.lit(0.03) + F.lit(0.0094) * F.col("k")
    wobble = (F.pmod(F.col("seq") * 7919, F.lit(241)) - 120) / F.lit(1000.0)
    return t.select(
        F.concat_ws("-", "instrument", date).alias("ticker"), "instrument", date.alias("date"),
        "ts", "seq", day.alias("open_ts"), tte.alias("tte_s"),
        (F.lit(100.0) + F.col("px") / 10).alias("spot"), F.lit(101.0).alias("strike"),
        mid.alias("mid"), (mid - half).alias("ybid"), (mid + half).alias("yask"),
        F.greatest(F.least(mid + wobble, F.lit(0.99)), F.lit(0.01)).alias("fair"),
        F.pmod(F.dayofmonth(F.timestamp_micros("ts")) + F.length("instrument"), F.lit(2))
        .cast("int").alias("outc"),
    ).withColumn("gap", F.col("fair") - F.col("mid"))


SCORED = TICKS + f""", scored0 AS (
  SELECT instrument || '-' || strftime(make_timestamp(ts), '%Y-%m-%d') AS ticker, instrument,
         strftime(make_timestamp(ts), '%Y-%m-%d') AS date, ts, seq, ts - ts % {DAY} AS open_ts,
         ({DAY} - ts % {DAY}) / 96e6::DOUBLE AS tte_s, 100.0::DOUBLE + px / 10 AS spot,
         101.0::DOUBLE AS strike,
         0.03::DOUBLE + 0.0094::DOUBLE * k AS mid,
         0.005::DOUBLE + 0.001::DOUBLE * (seq % 10) AS half,
         ((seq * 7919) % 241 - 120) / 1000.0::DOUBLE AS wobble,
         CAST((day(make_timestamp(ts)) + length(instrument)) % 2 AS INTEGER) AS outc
  FROM ticks),
scored AS (
  SELECT ticker, instrument, date, ts, seq, open_ts, tte_s, spot, strike, mid,
         mid - half AS ybid, mid + half AS yask,
         greatest(least(mid + wobble, 0.99::DOUBLE), 0.01::DOUBLE) AS fair, outc,
         greatest(least(mid + wobble, 0.99::DOUBLE), 0.01::DOUBLE) - mid AS gap
  FROM scored0)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed fills: order lines, ordered by ship date then line identity."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("instrument"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("int").cast("string")).alias("venue_trade_id"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")) * 100
         + F.col("l_quantity").cast("int")).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 9973).alias("px"),
        F.col("l_tax").alias("fee"), micros("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("market_id"))


FILLS = """fills AS (
  SELECT 'part.' || l_partkey AS instrument, 
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
           || '-' || CAST(l_quantity AS INTEGER) AS venue_trade_id,
         ((l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey) * 100 + CAST(l_quantity AS INTEGER) AS seq,
         CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS side, l_quantity AS qty,
         l_extendedprice / l_quantity / 9973 AS px, l_tax AS fee, epoch_us(l_shipdate) AS ts,
         l_orderkey AS order_id, l_suppkey AS market_id
  FROM lineitem)"""


def strategy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed strategy trades for the report tables, one per order line."""
    li = table(spark, sf_dir, "lineitem")
    mid0 = F.lit(0.02) + F.col("l_discount") * 9 + F.col("l_linenumber") / 100.0
    cost = F.lit(0.25) + F.col("l_discount") * 3
    won = (F.col("l_tax") > 0.04).cast("int")
    gap = F.lit(0.03) + F.col("l_tax") / 2
    return li.select(
        F.col("l_returnflag").alias("model"),
        F.when(F.col("l_linenumber") % 2 == 0, 0.03).otherwise(0.05).alias("delta"),
        F.col("l_orderkey").alias("ticker"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        (F.col("l_quantity") * 6).alias("tte"), mid0.alias("mid0"), cost.alias("cost"),
        won.alias("won"), (won - cost).alias("net"), gap.alias("gap"),
        (F.col("l_suppkey") % 2).cast("int").alias("side_yes"),
        (F.col("l_linenumber") / 200.0).alias("slip"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 2).alias("close_s"),
        (F.col("l_discount") - 0.05).alias("close_dmid"),
        (F.col("l_discount") - 0.05 - gap).alias("close_dfair"),
        (F.col("l_discount") / 2 - gap).alias("close_dfair_fx"),
        F.col("l_linenumber").alias("n_try"))


TRADES = """trades AS (
  SELECT l_returnflag AS model,
         CASE WHEN l_linenumber % 2 = 0 THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END AS delta,
         l_orderkey AS ticker, strftime(l_shipdate, '%Y-%m-%d') AS date, l_quantity * 6 AS tte,
         0.02::DOUBLE + l_discount * 9 + l_linenumber / 100.0::DOUBLE AS mid0,
         0.25::DOUBLE + l_discount * 3 AS cost, CAST(l_tax > 0.04::DOUBLE AS INTEGER) AS won,
         CAST(l_tax > 0.04::DOUBLE AS INTEGER) - (0.25::DOUBLE + l_discount * 3) AS net,
         0.03::DOUBLE + l_tax / 2 AS gap, CAST(l_suppkey % 2 AS INTEGER) AS side_yes,
         l_linenumber / 200.0::DOUBLE AS slip,
         CASE WHEN l_linestatus = 'F' THEN l_quantity * 2 END AS close_s,
         l_discount - 0.05::DOUBLE AS close_dmid,
         l_discount - 0.05::DOUBLE - (0.03::DOUBLE + l_tax / 2) AS close_dfair,
         l_discount / 2 - (0.03::DOUBLE + l_tax / 2) AS close_dfair_fx, l_linenumber AS n_try
  FROM lineitem)"""
