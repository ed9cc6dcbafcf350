"""Parsing of recorded logs and raw venue frames, and the scalar functions.

The frames are built by Spark from the given tables, so the text grows with them; the
oracle computes the expected values straight from the columns.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tickloom.functions import instruments as I
from tickloom.functions import ladders as L
from tickloom.functions import prices as P
from tickloom.operators import chunks as C
from tickloom.operators import volumes as V
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, HOUR, SCORED, TICKS, scored, table, ticks
from tickloom.sources import events as EV
from tickloom.sources import feeds, files, logs



def S(template, *args):
    """Text with ``%s``, ``%d`` and zero-padded ``%0nd`` places, as one concatenation."""
    parts, values = re.split(r"%(s|d|0\dd)", template), list(args)
    out = []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            if part:
                out.append(F.lit(part))
            continue
        value = values.pop(0)
        value = (F.col(value) if isinstance(value, str) else value).cast("string")
        out.append(F.lpad(value, int(part[1]), "0") if part.startswith("0") else value)
    return F.concat(*out)


def text(c):
    return F.col(c).cast("string")


def pick(key, *options):
    """One of the options by ``key`` modulo their number."""
    out = None
    for i, option in enumerate(options[:-1]):
        cond = F.pmod(F.col(key), F.lit(len(options))) == i
        out = F.when(cond, option) if out is None else out.when(cond, option)
    return out.otherwise(options[-1])


IDS = """ids AS (SELECT o_orderkey AS n, o_custkey AS m,
  CASE o_orderkey % 5 WHEN 0 THEN 'kalshi.M' || o_custkey || '.YES'
    WHEN 1 THEN 'kalshi.M' || o_custkey || '.NO' WHEN 2 THEN 'polymarket.0x' || o_custkey || '.UP'
    WHEN 3 THEN 'polymarket.0x' || o_custkey || '.DOWN' ELSE 'binance.usdt_perp.S' || o_custkey END AS id
  FROM orders)"""


def ids(spark, sf):
    m = text("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("m"), pick(
            "o_orderkey", F.concat(F.lit("kalshi.M"), m, F.lit(".YES")),
            F.concat(F.lit("kalshi.M"), m, F.lit(".NO")),
            F.concat(F.lit("polymarket.0x"), m, F.lit(".UP")),
            F.concat(F.lit("polymarket.0x"), m, F.lit(".DOWN")),
            F.concat(F.lit("binance.usdt_perp.S"), m)).alias("id"))


@query("instrument_ids", f"""WITH {IDS}
SELECT n, id, CASE WHEN n % 5 < 2 THEN 'kalshi' WHEN n % 5 < 4 THEN 'polymarket' END AS venue,
  CASE WHEN n % 5 < 2 THEN 'M' || m WHEN n % 5 < 4 THEN '0x' || m END AS market_id,
  CASE n % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'UP' WHEN 3 THEN 'DOWN' END AS outcome,
  CASE WHEN n % 5 = 4 THEN 'CryptoPerp' WHEN n % 5 >= 2 THEN 'PredictionOutcome' ELSE 'Other' END AS kind
FROM ids""")
def instrument_ids(spark, sf):
    c = F.col("id")
    return ids(spark, sf).select(
        "n", "id", I.venue_of(c).alias("venue"), I.market_id(c).alias("market_id"),
        I.outcome_label(c).alias("outcome"), I.instrument_kind(c).alias("kind"))


@query("outcome_mapping", f"""WITH {IDS}
SELECT n, CASE n % 5 WHEN 0 THEN 'kalshi.M' || m || '.NO' WHEN 1 THEN 'kalshi.M' || m || '.YES'
    WHEN 2 THEN 'polymarket.0x' || m || '.DOWN' WHEN 3 THEN 'polymarket.0x' || m || '.UP' ELSE id END
    AS complement,
  CASE WHEN n % 2 = 0 AND n % 5 = 0 THEN 'kalshi.M' || m || '.NO'
       WHEN n % 2 = 0 AND n % 5 = 2 THEN 'polymarket.0x' || m || '.DOWN' ELSE id END AS traded,
  CASE n % 5 WHEN 1 THEN 'kalshi.M' || m || '.YES' WHEN 3 THEN 'polymarket.0x' || m || '.UP'
    ELSE id END AS yes_side
FROM ids""")
def outcome_mapping(spark, sf):
    c = F.col("id")
    direction = F.when(F.col("n") % 2 == 0, -1).otherwise(1)
    return ids(spark, sf).select("n", I.complement(c).alias("complement"),
                                 I.traded_instrument(c, direction).alias("traded"),
                                 I.yes_side(c).alias("yes_side"))


TOPICS = """topics AS (SELECT event_id AS n, epoch_us(ts) * 1000 AS ts_ns, event_type AS k,
  CASE event_id % 4 WHEN 0 THEN 'market.binance.' || event_type || '.book'
    WHEN 1 THEN 'market.kalshi.' || event_type || '.x.trade' WHEN 2 THEN 'signal.' || event_type
    ELSE 'market' END AS topic FROM events)"""


def topics(spark, sf):
    k = F.col("instrument")
    return ticks(spark, sf).select(
        F.col("seq").alias("n"), (F.col("ts") * 1000).alias("ts_ns"), pick(
            "seq", F.concat(F.lit("market.binance."), k, F.lit(".book")),
            F.concat(F.lit("market.kalshi."), k, F.lit(".x.trade")),
            F.concat(F.lit("signal."), k), F.lit("market")).alias("topic"), "px", "instrument")


@query("topic_wildcards", f"""WITH {TOPICS}
SELECT n, n % 4 <> 2 AS all_market, n % 4 = 0 AS one_level, n % 4 < 2 AS venue_any,
       n % 4 = 1 AS ends_trade FROM topics""")
def topic_wildcards(spark, sf):
    t = F.col("topic")
    return topics(spark, sf).select(
        "n", I.topic_match(t, "market.#").alias("all_market"),
        I.topic_match(t, "market.*.*.book").alias("one_level"),
        I.topic_match(t, "market.*.#.*").alias("venue_any"),
        I.topic_match(t, "#.trade").alias("ends_trade"))


@query("partition_columns", f"""WITH {TOPICS}
SELECT n, CASE n % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'trade' WHEN 2 THEN 'signal' ELSE 'market' END
    AS stream, CASE n % 4 WHEN 0 THEN 'binance' WHEN 1 THEN 'kalshi' ELSE 'src' END AS venue,
  strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS date FROM topics""")
def partition_columns(spark, sf):
    rows = EV.with_partitions(topics(spark, sf).withColumn("source", F.lit("src")))
    return rows.select("n", "stream", "venue", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("event_log_parse", """
SELECT CASE WHEN event_id % 7 = 6 THEN 'bad' WHEN event_id % 3 = 0 THEN 'Book'
    WHEN event_id % 3 = 1 THEN 'Trade' ELSE 'Calib' END AS kind, event_type AS key, count(*) AS n,
  round(sum(CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 3 = 0 THEN 4 * user_id + 1
    WHEN event_id % 3 = 1 THEN user_id / 4.0::DOUBLE ELSE 18446744073709551615 - user_id END), 3) AS total
FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE event_type END AS event_type
      FROM events) GROUP BY 1, 2""")
def event_log_parse(spark, sf):
    u, k = F.col("user_id"), F.col("instrument")
    head = '{"topic":"market.x.%s.b","source":"s","ts_ns":%d,"seq":%d,"payload":{'
    book = S(head + '"Book":{"instrument":"%s","bids":[[%d,1.0],[1,2]],"asks":[[%d,3]],'
             '"update_id":null,"exch_ts_ns":1,"recv_ts_ns":2}}}', k, F.col("ts") * 1000, "seq", k,
             u * 2, u * 2 + 1)
    trade = S(head + '"Trade":{"instrument":"%s","price":%s,"qty":1,"side":"Buy","exch_ts_ns":1,'
              '"recv_ts_ns":2}}}', k, F.col("ts") * 1000, "seq", k, (u / 4).cast("string"))
    big = F.lit("18446744073709551615").cast("decimal(20,0)") - u
    calib = S(head + '"Calib":{"instrument":"%s","seq":1,"ts_ns":1,"d_b":0.5,"d_rho":0.25,'
              '"model_hash":%s}}}', k, F.col("ts") * 1000, "seq", k,
              big.cast("decimal(20,0)").cast("string"))
    line = F.when(F.col("seq") % 7 == 6, F.lit('{"topic": oops')).otherwise(
        pick("seq", book, trade, calib))
    rows = EV.parse_lines(ticks(spark, sf).select(line.alias("value")))
    kind = F.when(F.col(EV.BAD).isNotNull(), "bad").otherwise(EV.payload_kind())
    top = L.from_pairs(F.col("payload.Book.bids")), L.from_pairs(F.col("payload.Book.asks"))
    value = F.coalesce(L.best(top[0]) + L.best(top[1]), F.col("payload.Trade.price"),
                       F.col("payload.Calib.model_hash").cast("double"))
    return rows.groupBy(kind.alias("kind"), EV.payload_key().alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 3).alias("total"))


@query("sampler_rows", f"""WITH {TICKS}
SELECT seq, round(px + 0.5::DOUBLE, 6) AS spot, round(k / 100.0::DOUBLE + 0.02::DOUBLE, 6) AS mid,
  CASE WHEN user_id + k > 0 THEN round((user_id - k) / (user_id + k)::DOUBLE, 6) + 0.0 END AS imb1,
  CASE WHEN seq % 8000 <= 5000 THEN round(px + 2, 6) END AS cb_mid,
  CASE WHEN seq % 5 = 0 THEN NULL ELSE round(px * 2, 6) END AS band5
FROM ticks WHERE k > 0 AND seq % 6 <> 1 AND (seq * 211) % 1000 > 0 AND (seq * 211) % 1000 <= 900""")
def sampler_rows(spark, sf):
    px, k = F.col("px"), F.col("k")
    none = F.lit(None).cast("double")
    wide = F.when(F.col("seq") % 6 == 1, 0.2).otherwise(0.04)
    raw = ticks(spark, sf).select(
        "seq", "instrument", (F.col("ts") / 1000).cast("long").alias("ts_ms"),
        F.col("instrument").alias("ticker"), (F.pmod(F.col("seq") * 211, F.lit(1000)) * 1000)
        .alias("tte_ms"), px.alias("perp_bid"), (px + 1).alias("perp_ask"),
        (k / 100).alias("ybid"), (k / 100 + wide).alias("yask"),
        F.col("user_id").cast("double").alias("perp_bid_sz"), k.cast("double")
        .alias("perp_ask_sz"), (px + 1).alias("cb_bid"), (px + 3).alias("cb_ask"),
        F.pmod("seq", F.lit(8000)).cast("double").alias("cb_age_ms"),
        F.when(F.col("seq") % 5 == 0, F.lit(float("nan"))).otherwise(px * 2).alias("band5"))
    # keep the row id through the ticker, the reader keeps only its own columns
    raw = raw.withColumn("ticker", text("seq"))
    rows = files.sampler_rows(raw, ["band5"])
    return rows.select(F.col("ticker").cast("long").alias("seq"), *[
        F.round(c, 6).alias(c) for c in ("spot", "mid", "imb1", "cb_mid", "band5")])


@query("settlement_metadata", """
SELECT 'T' || o_orderkey AS ticker, o_totalprice AS strike,
       CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS result
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 3""")
def settlement_metadata(spark, sf):
    o = table(spark, sf, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "yes").when(
        F.col("o_orderstatus") == "O", "no").otherwise("")
    strike = F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice"))
    entry = F.struct(F.concat(F.lit("T"), text("o_orderkey")), F.struct(
        strike.alias("strike"), result.alias("result"), F.lit("x").alias("close_ts")))
    # one map text per customer, whose orders are few
    maps = o.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry)))
                                      .alias("value"))
    return files.meta_rows(maps).select("ticker", "strike", "result")


@query("feature_file_keys", f"""WITH {TICKS}
SELECT CASE WHEN seq % 2 = 0 THEN ts // 1000000 * 1000 ELSE ts // 1000 END AS t_ms,
       round(px, 6) AS imb1 FROM ticks""")
def feature_file_keys(spark, sf):
    t = ticks(spark, sf)
    even = F.col("seq") % 2 == 0
    raw = t.select(F.when(~even, F.expr("ts div 1000")).cast("string").alias("t_ms"),
                   F.when(even, F.expr("ts div 1000000")).cast("string").alias("t"),
                   text("px").alias("imb1"))
    return files.feature_rows(raw, ["imb1"]).select("t_ms", F.round("imb1", 6).alias("imb1"))


LI = """li AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS o, l_linenumber AS n,
  l_partkey AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"))


def cents(c):
    """Whole cents as a decimal text with three places."""
    return S("%d.%02d0", F.floor(c / 100), F.pmod(c, F.lit(100)))


def probe_log(spark, sf):
    li = lines(spark, sf)
    drift = F.col("n") * 50 - 100
    signed = S("%s%d.%02d", F.when(drift < 0, "-").otherwise(""), F.floor(F.abs(drift) / 100),
               F.pmod(F.abs(drift), F.lit(100)))
    chase = S("\x1b[2m2024-01-01T00:00:00Z\x1b[0m INFO chase: CHASE trade=%s signal_ask=%s "
              "fill_ask=%s drift_c=%s ask_sz=%d.0 filled=%s", "id", cents(F.col("q")),
              cents(F.col("q") + F.col("n")), signed, "q",
              F.when(F.col("n") < 5, "true").otherwise("false"))
    hold = S("INFO hold: HOLD trade=%s inst=kalshi.A%d.YES h=%d qty=%d.00 filled=%d.00 entry=0.400 "
             "exit=%s gross_c=%s net_c=%s", "id", "p", F.col("n") * 100, "q", "q",
             cents(F.col("q")), signed, signed)
    maker = S("INFO maker: MAKER trade=%s inst=kalshi.A%d.YES outcome=%s offer=0.500 bid0=0.480 "
              "cross=%s maker_net=0.5000 taker_net=0.4600 gain_c=%s", "id", "p",
              pick("o", F.lit("maker_fill"), F.lit("reject"), F.lit("timeout")),
              cents(F.col("q")), signed)
    trade = S('INFO executor: TRADE {"trade_id": "%s", "outcome": "Closed", "pnl_net": %s}', "id",
              signed)
    return li.select(F.explode(F.array(chase, hold, maker, trade, F.lit("INFO noise"))).alias("value"))


@query("probe_log_chase", f"""WITH {LI}
SELECT id AS trade_id, round(q / 100.0::DOUBLE, 6) AS signal_ask,
       round((n * 50 - 100) / 100.0::DOUBLE, 6) + 0.0 AS drift_c, n < 5 AS filled FROM li""")
def probe_log_chase(spark, sf):
    return logs.parse_log(probe_log(spark, sf), "chase").select(
        "trade_id", "signal_ask", "drift_c", "filled")


@query("probe_log_hold", f"""WITH {LI}
SELECT n * 100 AS hold_ms, count(*) AS n, round(avg(q / 100.0::DOUBLE), 6) AS exit,
       round(avg((n * 50 - 100) / 100.0::DOUBLE), 6) + 0.0 AS net_c FROM li GROUP BY n""")
def probe_log_hold(spark, sf):
    return logs.parse_log(probe_log(spark, sf), "hold").groupBy("hold_ms").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("exit"), 6).alias("exit"),
        F.round(F.avg("net_c"), 6).alias("net_c"))


@query("calibration_log", f"""WITH {SCORED}
SELECT 'kalshi.' || ticker || '.YES' AS instrument, CAST(floor(tte_s) AS DOUBLE) AS tte_s,
       CAST(seq % 90 AS INTEGER) AS rows, round((seq % 200 - 100) / 1000.0::DOUBLE, 6) + 0.0 AS d_b,
       round((seq % 50) / 100.0::DOUBLE, 6) AS d_rho FROM scored""")
def calibration_log(spark, sf):
    db = F.pmod("seq", F.lit(200)) - 100
    line = S("2024-01-01T00:00:00.0Z INFO fit: calib kalshi.%s.YES tte=%ds rows=%d db=%s0.%03d0 "
             "dr=+0.%02d00 bce=0.5000", "ticker", F.floor("tte_s"), F.pmod("seq", F.lit(90)),
             F.when(db < 0, "-").otherwise("+"), F.abs(db), F.pmod("seq", F.lit(50)))
    rows = logs.parse_log(scored(spark, sf).select(line.alias("value")), "calib")
    return rows.select("instrument", "tte_s", "rows", "d_b", "d_rho")


def with_recv(df):
    return df.withColumn("recv_ts_ns", F.lit(1_700_000_000_000_000_000))


@query("feed_bid_trades", f"""WITH {LI}
SELECT id AS trade_id, 'kalshi.P' || p || '.YES' AS instrument,
  round(CASE o % 4 WHEN 0 THEN (q + 10) / 100.0::DOUBLE WHEN 1 THEN (q + 10) / 100.0::DOUBLE
    ELSE 1 - (q + 10) / 100.0::DOUBLE END, 6) AS price, CAST(n AS DOUBLE) AS qty,
  CASE WHEN o % 2 = 1 THEN 'Sell' ELSE 'Buy' END AS side,
  1577836800000000000 + (n * 1000000000::BIGINT) AS exch_ts_ns FROM li""")
def feed_bid_trades(spark, sf):
    c = F.col("q") + 10
    field = pick("o", S('"yes_price_dollars":"0.%d"', c), S('"yes_price":%d', c),
                 S('"no_price_dollars":"0.%d"', c), S('"no_price":"%d"', c))
    raw = S('{"ticker":"P%d","trade_id":"%s","count":%d,%s,"taker_outcome_side":"%s",'
            '"created_time":"2020-01-01T00:00:0%dZ"}', "p", "id", "n", field,
            F.when(F.col("o") % 2 == 1, "no").otherwise("yes"), "n")
    rows = feeds.bid_trade(with_recv(lines(spark, sf).select(raw.alias("raw"))))
    return rows.select("trade_id", "instrument", F.round("price", 6).alias("price"), "qty", "side",
                       "exch_ts_ns")


BOOK_LEVELS = """lv AS (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber % 2 AS yes,
  CAST(l_quantity AS BIGINT) % 40 + l_linenumber * 2 AS c, CAST(l_quantity AS BIGINT) % 9 AS q
  FROM lineitem)"""


def bid_frames(spark, sf):
    """One snapshot frame per order; sizes of zero must be dropped by the parser."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
        (F.col("l_quantity").cast("long") % 40 + F.col("l_linenumber") * 2).alias("c"),
        (F.col("l_quantity").cast("long") % 9).alias("q"))
    yes = F.when(F.col("n") % 2 == 1, S('["0.%02d","%d"]', "c", "q"))
    no = F.when(F.col("n") % 2 == 0, S("[%d,%d]", "c", "q"))
    rows = li.groupBy("o").agg(F.concat_ws(",", F.collect_list(yes)).alias("y"),
                               F.concat_ws(",", F.collect_list(no)).alias("w"))
    return with_recv(rows.select("o", S(
        '{"seq":%d,"msg":{"market_ticker":"K%d","yes_dollars_fp":[%s],"no":[%s]}}', "o", "o", "y",
        "w").alias("raw")))


@query("feed_bid_snapshot_books", f"""WITH {BOOK_LEVELS},
b AS (SELECT o, max(c) FILTER (yes = 1 AND q > 0) AS y, max(c) FILTER (yes = 0 AND q > 0) AS w,
  sum(q) FILTER (yes = 1) AS yq, sum(q) FILTER (yes = 0) AS nq FROM lv GROUP BY o)
SELECT 'kalshi.K' || o || '.YES' AS instrument, round(y / 100.0::DOUBLE, 6) AS bid,
  round(1 - w / 100.0::DOUBLE, 6) AS ask, CAST(coalesce(yq, 0) AS DOUBLE) AS bid_depth,
  CAST(coalesce(nq, 0) AS DOUBLE) AS ask_depth FROM b
UNION ALL
SELECT 'kalshi.K' || o || '.NO', round(w / 100.0::DOUBLE, 6), round(1 - y / 100.0::DOUBLE, 6),
  CAST(coalesce(nq, 0) AS DOUBLE), CAST(coalesce(yq, 0) AS DOUBLE) FROM b""")
def feed_bid_snapshot_books(spark, sf):
    books = feeds.bid_books(feeds.bid_snapshot(bid_frames(spark, sf)))
    b, a = F.col("bids"), F.col("asks")
    return books.select("instrument", F.round(L.best(b), 6).alias("bid"),
                        F.round(L.best(a), 6).alias("ask"), L.total_qty(b).alias("bid_depth"),
                        L.total_qty(a).alias("ask_depth"))


@query("feed_bid_deltas", f"""WITH {LI}
SELECT 'P' || p AS ticker, o AS book_seq, CASE WHEN n % 2 = 1 THEN 'yes' ELSE 'no' END AS side,
  round((q + 10) / 100.0::DOUBLE, 6) AS px, CAST(q - 25 AS DOUBLE) AS delta
FROM li WHERE n <> 7""")
def feed_bid_deltas(spark, sf):
    c = F.col("q") + 10
    px = pick("o", S('"price":%d', c), S('"price_dollars":"0.%02d"', c))
    side = F.when(F.col("n") == 7, "").when(F.col("n") % 2 == 1, "Yes").otherwise("no")
    raw = S('{"seq":%d,"msg":{"market_ticker":"P%d","side":"%s",%s,"delta_fp":"%d"}}', "o", "p",
            side, px, F.col("q") - 25)
    return feeds.bid_delta(with_recv(lines(spark, sf).select(raw.alias("raw")))).select(
        "ticker", "book_seq", "side", F.round("px", 6).alias("px"), "delta")


@query("feed_token_changes", f"""WITH {LI}
SELECT 'tok' || p AS asset_id, CASE WHEN n % 2 = 1 THEN 'bid' ELSE 'ask' END AS side,
  round((q + 10) / 100.0::DOUBLE, 6) AS px, CAST(q % 5 AS DOUBLE) AS qty FROM li WHERE n <> 7""")
def feed_token_changes(spark, sf):
    side = F.when(F.col("n") == 7, "HOLD").when(F.col("n") % 2 == 1, "BUY").otherwise("sell")
    item = S('{"asset_id":"tok%d","price":"0.%02d","size":"%d","side":"%s"}', "p",
             F.col("q") + 10, F.col("q") % 5, side)
    frames = lines(spark, sf).groupBy("o").agg(F.concat_ws(",", F.collect_list(item)).alias("c"))
    name = pick("o", F.lit("price_changes"), F.lit("changes"))
    raw = S('[{"event_type":"price_change","%s":[%s]},{"event_type":"tick"}]', name, "c")
    rows = feeds.token_changes(feeds.token_frames(with_recv(frames.select(raw.alias("raw")))))
    return rows.select("asset_id", "side", F.round("px", 6).alias("px"), "qty")


@query("feed_token_books_trades", f"""WITH {BOOK_LEVELS}
SELECT 'book' AS kind, 'tok' || o AS asset_id,
  round(max(c) FILTER (yes = 1 AND q > 0) / 100.0::DOUBLE, 6) AS bid,
  round(min(c) FILTER (yes = 0 AND q > 0) / 100.0::DOUBLE, 6) AS ask,
  CAST(coalesce(sum(q), 0) AS DOUBLE) AS qty FROM lv WHERE o % 3 <> 0 GROUP BY o
UNION ALL
SELECT 'trade', 'tok' || o, round(max(c) / 100.0::DOUBLE, 6), NULL, CAST(max(q) AS DOUBLE)
FROM lv WHERE o % 3 = 0 GROUP BY o""")
def feed_token_books_trades(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
        (F.col("l_quantity").cast("long") % 40 + F.col("l_linenumber") * 2).alias("c"),
        (F.col("l_quantity").cast("long") % 9).alias("q"))
    level = S('{"price":"0.%02d","size":"%d"}', "c", "q")
    g = li.groupBy("o").agg(
        F.concat_ws(",", F.collect_list(F.when(F.col("n") % 2 == 1, level))).alias("b"),
        F.concat_ws(",", F.collect_list(F.when(F.col("n") % 2 == 0, level))).alias("a"),
        F.max("c").alias("c"), F.max("q").alias("q"))
    raw = F.when(F.col("o") % 3 != 0, S(
        '{"event_type":"book","asset_id":"tok%d","bids":[%s],"asks":[%s]}', "o", "b", "a")).otherwise(
        S('{"type":"last_trade_price","asset_id":"tok%d","price":"0.%02d","size":%d,"side":"BUY"}',
          "o", "c", "q"))
    frames = feeds.token_frames(with_recv(g.select(raw.alias("raw"))))
    b = feeds.token_book(frames)
    books = b.select(F.lit("book").alias("kind"), "asset_id",
                     F.round(L.best(F.col("bids")), 6).alias("bid"),
                     F.round(L.best(F.col("asks")), 6).alias("ask"),
                     (L.total_qty(F.col("bids")) + L.total_qty(F.col("asks"))).alias("qty"))
    trades = feeds.token_trade(frames).select(
        F.lit("trade").alias("kind"), "asset_id", F.round("price", 6).alias("bid"),
        F.lit(None).cast("double").alias("ask"), "qty")
    return books.unionByName(trades)


@query("feed_market_catalogs", """
SELECT 'kalshi.K' || o_orderkey || '.YES' AS instrument,
  CASE WHEN year(o_orderdate) > 1997 THEN 'Upcoming' WHEN year(o_orderdate) = 1997 THEN 'Live'
       ELSE 'Expired' END AS status, 1.0::DOUBLE AS min_order_size,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS strike
FROM orders
UNION ALL
SELECT 'polymarket.0x' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.UP' ELSE '.YES' END,
  'tok' || (o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END), 5.0::DOUBLE, NULL
FROM orders""")
def feed_market_catalogs(spark, sf):
    o = table(spark, sf, "orders")
    year = F.year("o_orderdate")
    strike = F.when(F.col("o_orderkey") % 3 == 0, F.concat(
        F.lit(',"floor_strike":'), text("o_totalprice"))).otherwise("")
    raw = S('{"ticker":"K%d","open_time":"%d-01-01T00:00:00Z","close_time":"%d-12-31T23:59:59Z"%s}',
            "o_orderkey", year, year, strike)
    now = I.rfc3339_ns(F.lit("1997-07-01T00:00:00Z"))
    one = feeds.bid_market(with_recv(o.select(raw.alias("raw"))), now).select(
        "instrument", "status", "min_order_size", "strike")
    names = pick("o_orderkey", F.lit('"[\\"Up\\", \\"Down\\"]"'), F.lit('["No","Yes"]'))
    raw2 = S('{"conditionId":"0x%d","clobTokenIds":"[\\"tok%d\\", \\"tok%d\\"]","outcomes":%s,'
             '"orderMinSize":"5"}', "o_orderkey", "o_custkey", F.col("o_custkey") + 1, names)
    two = feeds.token_market(with_recv(o.select(raw2.alias("raw"), F.lit(0).alias("start_s"))), 900)
    return one.unionByName(two.select(
        F.col("up_instrument").alias("instrument"), F.col("up_token").alias("status"),
        "min_order_size", F.lit(None).cast("double").alias("strike")))


@query("feed_perp_depth", f"""WITH {LI}, g AS (
  SELECT o, min(q) AS lo, max(q) AS hi, count(*) AS c, sum(q) AS s FROM li GROUP BY o)
SELECT o * 10 AS first_id, o * 10 + 9 AS last_id, o * 10 - 1 AS prev_id,
  CAST(c AS INTEGER) AS levels, CAST(s AS DOUBLE) AS qty,
  CASE WHEN o % 2 = 0 THEN o * 1000000 ELSE 1700000000000000000 END AS exch_ts_ns FROM g""")
def feed_perp_depth(spark, sf):
    g = lines(spark, sf).groupBy("o").agg(
        F.concat_ws(",", F.collect_list(S('["0.%02d","%d"]', "n", "q"))).alias("b"))
    at = F.when(F.col("o") % 2 == 0, S(',"T":%d', "o")).otherwise("")
    body = S('{"e":"depthUpdate","U":%d,"u":%d,"pu":%d%s,"b":[%s],"a":[]}', F.col("o") * 10,
             F.col("o") * 10 + 9, F.col("o") * 10 - 1, at, "b")
    raw = pick("o", S('{"stream":"x","data":%s}', body), body)
    rows = feeds.perp_depth(with_recv(g.select(raw.alias("raw"))))
    return rows.select("first_id", "last_id", "prev_id", F.size("bids").alias("levels"),
                       L.total_qty(F.col("bids")).alias("qty"), "exch_ts_ns")


@query("feed_reference_tickers", f"""WITH {TICKS}
SELECT CASE seq % 5 WHEN 0 THEN 'spot' WHEN 1 THEN 'us' WHEN 2 THEN 'channel' WHEN 3 THEN 'book'
    ELSE 'perp' END AS feed, count(*) AS n, CAST(sum(k) AS DOUBLE) AS bid,
  CAST(sum(k + 1) AS DOUBLE) AS ask, CAST(sum(user_id) AS DOUBLE) AS bid_sz FROM ticks GROUP BY 1""")
def feed_reference_tickers(spark, sf):
    b, a, q = F.col("k"), F.col("k") + 1, F.col("user_id")
    frames = with_recv(ticks(spark, sf).select("seq", pick(
        "seq",
        S('{"type":"ticker","best_bid":"%d","best_ask":"%d","best_bid_size":"%d"}', b, a, q),
        S('{"u":1,"b":"%d","a":"%d","B":"%d","A":"1"}', b, a, q),
        S('{"channel":"ticker","data":[{"bid":%d,"ask":%d,"bid_qty":%d}]}', b, a, q),
        S('{"event":"data","data":{"microtimestamp":"5","bids":[["%d","%d"]],"asks":[["%d","1"]]}}',
          b, q, a),
        S('{"stream":"x","data":{"e":"bookTicker","b":"%d","a":"%d","B":"%d","A":"2","E":7}}', b, a, q)
    ).alias("raw")))
    parsers = [("spot", feeds.spot_ticker), ("us", feeds.spot_us_ticker),
               ("channel", feeds.channel_ticker), ("book", feeds.book_channel),
               ("perp", feeds.perp_ticker)]
    out = None
    for i, (name, parse) in enumerate(parsers):
        rows = parse(frames.filter(F.col("seq") % 5 == i)).withColumn("feed", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.sum("bid").alias("bid"),
                                   F.sum("ask").alias("ask"), F.sum("bid_sz").alias("bid_sz"))


@query("taker_volume", f"""WITH RECURSIVE {TICKS},
c AS (SELECT instrument, seq, ts, sum(k) OVER (PARTITION BY instrument ORDER BY ts, seq) AS cum FROM ticks),
n AS (SELECT c.*, d.seq AS next_seq FROM (SELECT *, ts + {2 * HOUR} AS due FROM c) c ASOF LEFT JOIN (
  SELECT instrument, ts, min(seq) AS seq FROM c GROUP BY ALL) d ON c.instrument = d.instrument AND c.due <= d.ts),
w AS (SELECT n.* FROM n JOIN (SELECT instrument, min((ts, seq)) AS f FROM c GROUP BY 1) m
    ON n.instrument = m.instrument AND (n.ts, n.seq) = m.f
  UNION ALL SELECT n.* FROM w JOIN n ON n.instrument = w.instrument AND n.seq = w.next_seq)
SELECT instrument || '.vol' AS instrument, seq AS trade_id, ts * 1000 AS recv_ts_ns, CAST(cum AS DOUBLE) AS cum FROM w""")
def taker_volume(spark, sf):
    """Trade frames of two overlapping connections; every third trade is received by both."""
    trade = S('{"e":"aggTrade","a":%d,"q":"%d","p":"1","m":true}', "seq", "k")
    t = ticks(spark, sf)
    raw = pick("seq", S('{"stream":"x@aggTrade","data":%s}', trade), trade,
               S('{"stream":"x@aggTrade","data":%s}', trade))
    copies = F.when(F.col("seq") % 3 == 0, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    frames = t.select(F.concat("instrument", F.lit(".vol")).alias("instrument"), "seq", "ts", raw.alias("raw"),
                      F.explode(copies).alias("late"))
    frames = frames.select("instrument", ((F.col("ts") + F.col("late") * HOUR) * 1000).alias("recv_ts_ns"),
                           (F.col("seq") * 10 + F.col("late")).alias("n"), "raw")
    rows = V.taker_volume(feeds.perp_agg_trade(frames), by=["instrument"], ts="recv_ts_ns", order=["n"],
                          gap=2 * HOUR * 1000, chunk=2 * DAY * 1000)
    return rows.select("instrument", "trade_id", "recv_ts_ns", "cum")


@query("volume_counter_rejoined", f"""WITH {TICKS},
c AS (SELECT instrument, seq, ts, sum(k) OVER (PARTITION BY instrument, ts // {3 * DAY} ORDER BY ts, seq) AS v FROM ticks),
d AS (SELECT *, lag(v) OVER (PARTITION BY instrument ORDER BY ts, seq) AS p FROM c)
SELECT instrument, seq, CAST(sum(CASE WHEN v >= p THEN v - p ELSE v END)
  OVER (PARTITION BY instrument ORDER BY ts, seq) AS DOUBLE) AS total FROM d""")
def volume_counter_rejoined(spark, sf):
    """A counter that starts again every three days."""
    t = ticks(spark, sf).withColumn("_run", F.expr(f"ts div {3 * DAY}"))
    points = C.running_sum(t, F.col("k").cast("double"), "cum", by=["instrument", "_run"], ts="ts",
                           order=["seq"], chunk=DAY)
    rows = V.rejoined_counter(points, by=["instrument"], ts="ts", order=["seq"], chunk=DAY)
    return rows.select("instrument", "seq", "total")


@query("feed_change_carry", f"""WITH {TICKS}, c AS (
  SELECT seq, ts, CASE WHEN seq % 3 = 0 THEN k + 1 END AS b, CASE WHEN seq % 3 = 1 THEN k + 2 END AS a
  FROM ticks WHERE seq % 3 < 2),
f AS (SELECT seq, last_value(b IGNORE NULLS) OVER w AS bid, last_value(a IGNORE NULLS) OVER w AS ask
  FROM c WINDOW w AS (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask FROM f
WHERE bid IS NOT NULL AND ask IS NOT NULL""")
def feed_change_carry(spark, sf):
    event = pick("seq", S('{"type":"change","side":"bid","price":"%d","remaining":"1"}', F.col("k") + 1),
                 S('{"type":"change","side":"ask","price":"%d","remaining":"2"}', F.col("k") + 2),
                 F.lit('{"type":"trade"}'))
    frames = ticks(spark, sf).select("seq", (F.col("ts") * 1000).alias("recv_ts_ns"), S(
        '{"type":"update","events":[%s]}', event).alias("raw"))
    return feeds.change_feed(frames, order="seq", chunk=DAY * 1000).select("seq", "bid", "ask")


@query("feed_futures_top", f"""WITH {TICKS}
SELECT 'databento.' || CASE WHEN user_id % 3 = 0 THEN 'id' || user_id ELSE 'R' || user_id END AS instrument,
  count(*) AS n, round(sum(k / 4.0::DOUBLE), 6) AS bid FROM ticks WHERE seq % 6 <> 0 GROUP BY 1""")
def feed_futures_top(spark, sf):
    t = ticks(spark, sf)
    undef = F.lit(feeds.UNDEF_PRICE)
    frames = t.select(F.col("user_id").alias("instrument_id"), F.when(
        F.col("seq") % 6 == 0, undef).otherwise(F.col("k") * 250_000_000).alias("bid_px"),
        (F.col("k") * 250_000_000 + 1).alias("ask_px"))
    symbols = t.select(F.col("user_id").alias("instrument_id"), F.concat(
        F.lit("R"), text("user_id")).alias("root")).filter("instrument_id % 3 <> 0").distinct()
    return feeds.futures_top(frames, symbols).groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("bid"), 6).alias("bid"))


@query("ticker_settlement_and_strike", """
WITH o AS (SELECT o_orderkey AS n, o_custkey AS c, date_trunc('day', o_orderdate + INTERVAL 30 YEAR)
             + INTERVAL (o_orderkey % 12 + 8) HOUR AS local FROM orders)
SELECT n, epoch_us(timezone('America/New_York', local)) * 1000 AS settle_ns,
  epoch_us(local + INTERVAL 4 HOUR) * 1000 AS fixed_ns, round(c + 0.25::DOUBLE, 6) AS strike
FROM o""")
def ticker_settlement_and_strike(spark, sf):
    # the source dates are moved on by 30 years, ticker years have two digits from 2000
    day = F.upper(F.date_format(F.add_months("o_orderdate", 360), "yyMMMdd"))
    ticker = S("KX-%s%02d00-T%d.25", day, F.pmod("o_orderkey", F.lit(12)) + 8, "o_custkey")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), ticker.alias("t"))
    t = F.col("t")
    return rows.select("n", I.settlement_ns(t).alias("settle_ns"),
                       I.settlement_ns(t, fixed_offset_h=-4).alias("fixed_ns"),
                       I.strike_of(t).alias("strike"))


@query("event_windows", f"""WITH {TICKS}
SELECT seq, ts - ts % {HOUR} + i * {HOUR} AS starts FROM ticks, (SELECT unnest([0, 1, 2]) AS i)""")
def event_windows(spark, sf):
    return ticks(spark, sf).select("seq", F.explode(I.next_windows(F.col("ts"), HOUR, 2))
                                   .alias("starts"))


@query("clock_units", f"""WITH {TICKS}
SELECT seq, CASE seq % 4 WHEN 0 THEN ts // 1000000 * 1000000000 WHEN 1 THEN ts // 1000 * 1000000
  ELSE ts * 1000 END AS ns, ts * 1000 AS parsed_ns FROM ticks""")
def clock_units(spark, sf):
    value = pick("seq", F.expr("ts div 1000000"), F.expr("ts div 1000"), F.col("ts"),
                 F.col("ts") * 1000)
    iso = F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return ticks(spark, sf).select("seq", I.epoch_ns(value).alias("ns"),
                                   I.rfc3339_ns(iso).alias("parsed_ns"))


@query("fees_and_scores", f"""WITH {SCORED}
SELECT seq, round(0.07::DOUBLE * mid * (1 - mid) * 20, 6) AS fee,
  round(ceil(round(0.07::DOUBLE * mid * (1 - mid) * 20 * 100, 9)) / 100, 6) AS fee_up,
  round(ln(mid / (1 - mid)), 6) + 0.0 AS logit, round(1 / (1 + exp(-gap)), 6) AS sig,
  round(least(greatest(tte_s / 900, 1e-4), 1), 6) AS tau,
  round((spot - strike) / 50 / sqrt(least(greatest(tte_s / 900, 1e-4), 1)), 6) + 0.0 AS z
FROM scored""")
def fees_and_scores(spark, sf):
    m = F.col("mid")
    return scored(spark, sf).select(
        "seq", F.round(P.fee(m, F.lit(20)), 6).alias("fee"),
        F.round(P.fee(m, F.lit(20), round_up_cents=True), 6).alias("fee_up"),
        F.round(P.logit(m), 6).alias("logit"), F.round(P.sigmoid(F.col("gap")), 6).alias("sig"),
        F.round(P.tau(F.col("tte_s")), 6).alias("tau"),
        F.round(P.z_prime(F.col("spot"), F.col("strike"), F.lit(50.0), F.col("tte_s")), 6)
        .alias("z"))


RISK = dict(yes_bucket=(0.2, 0.8), stale_ms=1500, min_tte_ms=60_000, max_tte_ms=600_000, ttl_ms=500,
            max_order_notional=12.0)


@query("pre_trade_gate", f"""WITH {SCORED}
SELECT seq, CASE WHEN seq % 1700 > 1500 THEN 'stale book'
    WHEN yask < 0.2::DOUBLE OR yask > 0.8::DOUBLE THEN 'price bucket'
    WHEN seq % 11 = 0 THEN 'no expiry' WHEN tte_s * 1000 < 60000 THEN 'tte min'
    WHEN tte_s * 1000 > 600000 THEN 'tte max' WHEN seq % 600 > 500 THEN 'stale signal'
    WHEN least(20, 0.5::DOUBLE * (seq % 50)) * yask > 12 THEN 'notional' END AS reason,
  round(least(20, 0.5::DOUBLE * (seq % 50)), 6) AS size,
  abs(seq % 80 - 40 + CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * 10) <= 40
    OR abs(seq % 80 - 40 + CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * 10) <= abs(seq % 80 - 40)
    AS exposure_ok,
  coalesce(CASE WHEN seq % 3 = 0 THEN 2.0::DOUBLE END, 5.0::DOUBLE) AS min_size
FROM scored""")
def pre_trade_gate(spark, sf):
    seq = F.col("seq")
    size = P.plan_size(20.0, 0.5, F.pmod(seq, F.lit(50)))
    reason = P.risk_reason(
        book_age_ms=F.pmod(seq, F.lit(1700)), ask=F.col("yask"),
        tte_ms=F.when(seq % 11 != 0, F.col("tte_s") * 1000),
        signal_age_ms=F.pmod(seq, F.lit(600)), size=size, cfg=RISK)
    net = F.pmod(seq, F.lit(80)) - 40
    return scored(spark, sf).select(
        "seq", reason.alias("reason"), F.round(size, 6).alias("size"),
        P.exposure_ok(net, F.when(seq % 2 == 0, 1).otherwise(-1), F.lit(10), 40).alias("exposure_ok"),
        P.market_param(F.when(seq % 3 == 0, 2.0), 5.0).alias("min_size"))


@query("row_eligibility", f"""WITH {SCORED}
SELECT ticker, count(*) FILTER (ybid > 0 AND yask > ybid AND yask - ybid <= 0.022::DOUBLE
    AND tte_s > 0 AND tte_s <= 900) AS valid,
  count(*) FILTER (seq % 4000 <= 1500) AS fresh,
  count(*) FILTER (seq % 10 <> 0 AND (seq * 977) % 1300000 - 20000 BETWEEN -10000 AND 1200000) AS active,
  count(*) FILTER (mid BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE) AS in_band
FROM scored GROUP BY ticker""")
def row_eligibility(spark, sf):
    seq, tte = F.col("seq"), F.col("tte_s")
    expiry = F.when(seq % 10 != 0, F.lit(1))
    tte_ms = F.pmod(seq * 977, F.lit(1_300_000)) - 20_000
    flags = {
        "valid": P.valid_book(F.col("ybid"), F.col("yask"), 0.022) & P.valid_tte(tte),
        "fresh": P.fresh(F.pmod(seq, F.lit(4000)), 1500),
        "active": P.active_row(expiry, F.col("ybid"), F.col("yask"), tte_ms),
        "in_band": F.col("mid").between(0.3, 0.7)}
    return scored(spark, sf).groupBy("ticker").agg(
        *[F.count(F.when(cond, 1)).alias(name) for name, cond in flags.items()])


# ── files written from the given tables and read back ────────────────────────

def landed(spark, label: str) -> str:
    from tickloom.session import fresh_path
    return fresh_path(spark, label)


@query("snapshot_lake_scan", f"""WITH {TICKS}
SELECT ts * 1000 AS recv_ts_ns, '[[' || user_id || ', 1]]' AS bids_json, '[[' || k || ', 2]]' AS asks_json FROM ticks
WHERE instrument = 'view' AND strftime(make_timestamp(ts), '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'""")
def snapshot_lake_scan(spark, sf):
    """One symbol and date range of a partitioned lake."""
    base = landed(spark, "lake")
    day = F.timestamp_micros("ts").cast("date")
    ticks(spark, sf).select(
        (F.col("ts") * 1000).alias("recv_ts_ns"), (F.col("ts") * 1000 - 5).alias("exch_ts_ns"),
        S("[[%d, 1]]", "user_id").alias("bids_json"), S("[[%d, 2]]", "k").alias("asks_json"), F.lit("depth").alias("stream"),
        F.lit("binance").alias("venue"), F.lit("spot").alias("market"), F.col("instrument").alias("symbol"), day.alias("date")
    ).repartition("symbol", "date").write.partitionBy("stream", "venue", "market", "symbol", "date").parquet(base)
    return files.read_l2(spark, base, stream="depth", venue="binance", market="spot", symbol="view",
                         first="2024-01-05", last="2024-01-20")


@query("sampler_days_scan", f"""WITH {TICKS}
SELECT seq AS ts_ms, instrument AS ticker, k AS tte_ms, CAST(user_id AS DOUBLE) AS ybid,
  CASE WHEN ts // {DAY} % 3 > 0 THEN CAST(k AS DOUBLE) END AS cb_bid,
  CASE WHEN ts // {DAY} % 3 = 2 THEN k / 4.0::DOUBLE END AS band5 FROM ticks""")
def sampler_days_scan(spark, sf):
    """CSV days of three writers: each wrote more columns than the one before, in another order."""
    base = landed(spark, "sampler")
    age = F.expr(f"(ts div {DAY}) % 3")
    t = ticks(spark, sf).select("ts", F.col("seq").alias("ts_ms"), F.col("instrument").alias("ticker"),
                                F.col("k").alias("tte_ms"), F.col("user_id").alias("ybid"), F.col("k").alias("cb_bid"),
                                (F.col("k") / 4).alias("band5"))
    heads = [["ts_ms", "ticker", "tte_ms", "ybid"], ["cb_bid", "ticker", "ts_ms", "ybid", "tte_ms"],
             ["ticker", "band5", "ts_ms", "tte_ms", "cb_bid", "ybid"]]
    for i, head in enumerate(heads):
        out = t.filter(age == i).select(*head).write.option("header", True)
        (out.option("compression", "gzip") if i == 1 else out).csv(f"{base}/writer{i}")
    raw = files.read_sampler_raw(spark, [f"{base}/writer{i}" for i in range(3)], ["band5"])
    return raw.select("ts_ms", "ticker", "tte_ms", "ybid", "cb_bid", "band5")


@query("event_rows_scan", f"""WITH {SCORED}
SELECT ticker, ts // 1000000 AS t, round(spot, 6) AS spot, round(mid, 6) AS prob, outc AS outcome, open_ts // 1000000 AS open_ts,
  CASE WHEN outc = 1 THEN 'yes' ELSE 'no' END AS result FROM scored""")
def event_rows_scan(spark, sf):
    base = landed(spark, "rows")
    s = scored(spark, sf)
    second = lambda c: F.expr(f"{c} div 1000000")
    s.select("ticker", second("ts").alias("t"), "tte_s", "spot", F.col("mid").alias("prob"), F.lit(1).alias("n_trades"),
             "strike", F.col("outc").alias("outcome")).write.option("header", True).csv(f"{base}/rows.csv")
    s.groupBy("ticker").agg(
        second("min(open_ts)").alias("open_ts"), (second("min(open_ts)") + 86_400).alias("close_ts"), F.min("strike").alias("strike"),
        F.when(F.min("outc") == 1, "yes").otherwise("no").alias("result"), F.lit("").alias("expiration_value"),
        F.count(F.lit(1)).alias("n_trades")).write.option("header", True).csv(f"{base}/events_meta.csv")
    return files.read_event_rows(spark, base).select(
        "ticker", "t", F.round("spot", 6).alias("spot"), F.round("prob", 6).alias("prob"), "outcome", "open_ts", "result")


@query("venue_price_scan", f"""WITH {TICKS}
SELECT 'u' || user_id AS ticker, ts // 1000000 AS t, instrument AS venue, px FROM ticks""")
def venue_price_scan(spark, sf):
    path = landed(spark, "venues")
    ticks(spark, sf).select(S("u%d", "user_id").alias("ticker"), F.expr("ts div 1000000").alias("t"),
                            F.col("instrument").alias("venue"), "px").write.option("header", True).csv(path)
    return files.read_venue_px(spark, path)


@query("tick_file_scan", f"""WITH {TICKS}
SELECT instrument, ts, px AS mid FROM ticks WHERE instrument IN ('view', 'click')""")
def tick_file_scan(spark, sf):
    """Headerless files, one per source."""
    base = landed(spark, "ticks")
    t = ticks(spark, sf)
    for source in ("view", "click"):
        t.filter(F.col("instrument") == source).select(
            F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), "px").write.csv(f"{base}/{source}.csv")
    return files.read_ticks(spark, base, "view").union(files.read_ticks(spark, base, "click"))


def trade_events(spark, sf):
    """Every tick as a trade message of the event log."""
    k = F.col("instrument")
    line = S('{"topic":"market.kalshi.%s.trade","source":"s","ts_ns":%d,"seq":%d,"payload":{"Trade":{"instrument":"%s",'
             '"price":%s,"qty":%d,"side":"Buy","exch_ts_ns":%d,"recv_ts_ns":%d}}}', k, F.col("ts") * 1000, "seq", k,
             F.col("px").cast("string"), "k", F.col("ts") * 1000, F.col("ts") * 1000 + 5)
    return EV.good(EV.parse_lines(ticks(spark, sf).select(line.alias("value")))).drop(EV.BAD)


TRADES = f"""WITH {TICKS}
SELECT seq AS event_seq, instrument, px AS price, k::DOUBLE AS qty, ts * 1000 AS exch_ts_ns FROM ticks"""


@query("event_log_sink", TRADES)
def event_log_sink(spark, sf):
    """Written by stream, venue and date, read back by partition."""
    base = landed(spark, "log")
    EV.write_events(trade_events(spark, sf), base)
    from tickloom import schema
    back = spark.read.schema(f"{schema.EVENT}, stream STRING, venue STRING, date DATE").json(base)
    return EV.payload(back.filter("stream = 'trade'"), "Trade").select("event_seq", "instrument", "price", "qty", "exch_ts_ns")


@query("event_stream_source", TRADES)
def event_stream_source(spark, sf):
    """The landed log read as a stream, payloads written to a table."""
    from tickloom.streaming.state import run_to_table
    base = landed(spark, "log")
    EV.write_events(trade_events(spark, sf), f"{base}/log")
    rows = EV.payload(EV.stream_events(spark, f"{base}/log", 50), "Trade").select(
        "event_seq", "instrument", "price", "qty", "exch_ts_ns")
    run_to_table(rows, f"{base}/table", f"{base}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


@query("event_stream_sink", TRADES)
def event_stream_sink(spark, sf):
    """A stream of the log appended to a second partitioned log."""
    from tickloom import schema
    base = landed(spark, "log")
    EV.write_events(trade_events(spark, sf), f"{base}/log")
    EV.stream_to_files(EV.stream_events(spark, f"{base}/log").drop("stream", "venue", "date"), f"{base}/copy",
                       f"{base}/checkpoint", available_now=True).awaitTermination()
    back = spark.read.schema(f"{schema.EVENT}, stream STRING, venue STRING, date DATE").json(f"{base}/copy")
    return EV.payload(back, "Trade").select("event_seq", "instrument", "price", "qty", "exch_ts_ns")


@query("result_sink", f"""WITH {SCORED}
SELECT date, count(*) AS n, round(sum(gap), 6) + 0.0 AS gap FROM scored WHERE date >= '2024-01-10' GROUP BY 1""")
def result_sink(spark, sf):
    path = landed(spark, "results")
    EV.write_results(scored(spark, sf).select("ticker", "date", "gap"), path, partition_by=("date",))
    back = spark.read.schema("ticker STRING, gap DOUBLE, date STRING").parquet(path).filter("date >= '2024-01-10'")
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("gap"), 6) + 0.0).alias("gap"))
