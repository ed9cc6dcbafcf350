"""Raw venue frames to the canonical book, trade and market tables, one parser per feed.

Every parser takes a table with the frame text in ``raw`` and the local receive time in
``recv_ts_ns`` and keeps the other columns. Venues send numbers as JSON numbers or as
quoted strings, so frame schemas read them as text and cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import instruments as I
from tickloom.functions import ladders as L
from tickloom.operators import chunks as C

NS, US = 1_000_000_000, 1_000_000
UNDEF_PRICE = (1 << 63) - 1  # fixed value: "no price" in the futures feed
FIXED_SCALE = 1e9


def num(text: Column) -> Column:
    return text.try_cast("double")


def raw_levels(levels: Column, cents: bool = False) -> Column:
    """Levels given as ``[price, size]`` or ``{price, size}``; empty ones dropped, order kept."""
    def one(text):
        p = num(F.coalesce(F.get_json_object(text, "$[0]"), F.get_json_object(text, "$.price")))
        s = num(F.coalesce(F.get_json_object(text, "$[1]"), F.get_json_object(text, "$.size")))
        return L.level(p / 100 if cents else p, s)

    return F.filter(F.transform(levels, one), lambda v: v["px"].isNotNull() & (v["qty"] > 0))


def string_array(text: Column) -> Column:
    """A JSON array, or a string that holds one."""
    return F.from_json(text, "ARRAY<STRING>")


def _decode(df: DataFrame, fields: str, column: str = "raw") -> DataFrame:
    """Parse once: behind a generator, later filters cannot pull copies of the parse down."""
    return df.select("*", F.explode(F.array(F.from_json(column, fields))).alias("_m"))


# ── exchange with reflected yes/no bids ──────────────────────────────────────

def bid_snapshot(df: DataFrame) -> DataFrame:
    """Snapshot of yes and no bids (dollar fields first, whole cents as fallback)."""
    side = "{0}_dollars_fp: ARRAY<STRING>, {0}_dollars: ARRAY<STRING>, {0}: ARRAY<STRING>"
    body = f"{side.format('yes')}, {side.format('no')}, market_ticker: STRING"
    df = _decode(df, f"seq BIGINT, msg STRUCT<{body}>, orderbook_fp STRUCT<{body}>, "
                     f"orderbook STRUCT<{body}>")
    m = F.coalesce(F.col("_m.msg"), F.col("_m.orderbook_fp"), F.col("_m.orderbook"))

    def ladder(side):
        dollars = F.coalesce(m[f"{side}_dollars_fp"], m[f"{side}_dollars"])
        return F.coalesce(raw_levels(dollars), raw_levels(m[side], cents=True),
                          F.array().cast("ARRAY<STRUCT<px: DOUBLE, qty: DOUBLE>>"))

    return df.select(*[c for c in df.columns if c not in ("raw", "_m")],
                     m["market_ticker"].alias("ticker"), F.col("_m.seq").alias("book_seq"),
                     ladder("yes").alias("yes_bids"), ladder("no").alias("no_bids"))


def bid_delta(df: DataFrame) -> DataFrame:
    """Signed size change at one price of the yes or no bids."""
    df = _decode(df, "seq BIGINT, msg STRUCT<market_ticker: STRING, side: STRING, "
                     "price_dollars: STRING, price: STRING, delta_fp: STRING, delta: STRING>")
    m = F.col("_m.msg")
    px = F.coalesce(num(m["price_dollars"]), num(m["price"]) / 100)
    out = df.select(*[c for c in df.columns if c not in ("raw", "_m")],
                    m["market_ticker"].alias("ticker"), F.col("_m.seq").alias("book_seq"),
                    F.lower(m["side"]).alias("side"), px.alias("px"),
                    F.coalesce(num(m["delta_fp"]), num(m["delta"])).alias("delta"))
    return out.filter(F.col("side").isin("yes", "no") & F.col("px").isNotNull()
                      & F.col("delta").isNotNull())


def bid_trade(df: DataFrame) -> DataFrame:
    """Trade tape row, price in yes terms from whichever of four fields is present."""
    df = _decode(df, "ticker STRING, trade_id STRING, count_fp STRING, count STRING, "
                     "yes_price_dollars STRING, yes_price STRING, no_price_dollars STRING, "
                     "no_price STRING, taker_outcome_side STRING, created_time STRING")
    m = F.col("_m")
    price = F.coalesce(num(m["yes_price_dollars"]), num(m["yes_price"]) / 100,
                       1 - num(m["no_price_dollars"]), 1 - num(m["no_price"]) / 100)
    out = df.select(
        *[c for c in df.columns if c not in ("raw", "_m")], m["trade_id"].alias("trade_id"),
        F.concat(F.lit("kalshi."), m["ticker"], F.lit(".YES")).alias("instrument"),
        price.alias("price"), F.coalesce(num(m["count_fp"]), num(m["count"])).alias("qty"),
        F.when(m["taker_outcome_side"] == "no", "Sell").otherwise("Buy").alias("side"),
        F.coalesce(I.rfc3339_ns(m["created_time"]), F.col("recv_ts_ns")).alias("exch_ts_ns"))
    return out.filter(F.col("price").isNotNull() & F.col("qty").isNotNull())


def bid_market(df: DataFrame, now: Column, kind: str = "binary") -> DataFrame:
    """Catalog row: lifecycle, fixed contract economics, strike."""
    df = _decode(df, "ticker STRING, open_time STRING, close_time STRING, title STRING, "
                     "floor_strike STRING, result STRING")
    m = F.col("_m")
    opened = F.coalesce(I.rfc3339_ns(m["open_time"]), now)
    closed = I.rfc3339_ns(m["close_time"])
    out = df.select(
        *[c for c in df.columns if c not in ("raw", "_m")], m["ticker"].alias("ticker"),
        F.concat(F.lit("kalshi."), m["ticker"], F.lit(".YES")).alias("instrument"),
        F.lit(kind).alias("kind"), I.phase(now, opened, closed).alias("status"),
        opened.alias("start_ts_ns"), closed.alias("expiry_ts_ns"),
        F.when(m["result"].isin("yes", "no"), F.concat(
            F.lit("kalshi."), m["ticker"], F.lit("."), F.upper(m["result"]))).alias("winner"),
        F.lit(1.0).alias("min_order_size"), F.lit(0.01).alias("tick_size"),
        F.lit(None).cast("double").alias("fee_rate"),
        num(m["floor_strike"]).alias("strike"))
    return out.filter(F.col("ticker").isNotNull() & F.col("expiry_ts_ns").isNotNull())


def bid_books(snapshots: DataFrame, n: int | None = None) -> DataFrame:
    """Books of both outcomes: asks of one side are the other side's bids at 1 - p.

    All levels, or the top ``n`` of each side.
    """
    yes = L.normalize(F.col("yes_bids"), "bid")
    no = L.normalize(F.col("no_bids"), "bid")
    cut = lambda side: side if n is None else L.top_n(side, n)

    def book(label, own, other):
        return F.struct(
            F.concat(F.lit("kalshi."), F.col("ticker"), F.lit(f".{label}")).alias("instrument"),
            cut(own).alias("bids"), cut(L.reflect(other)).alias("asks"))

    both = F.explode(F.array(book("YES", yes, no), book("NO", no, yes)))
    keep = [c for c in snapshots.columns if c not in ("yes_bids", "no_bids", "ticker")]
    return snapshots.select(*keep, both.alias("_b")).select(*keep, "_b.*")


def both_outcomes(books: DataFrame) -> DataFrame:
    """The complement's book next to each yes book."""
    other = F.struct(I.complement(F.col("instrument")).alias("instrument"),
                     L.reflect(F.col("asks")).alias("bids"), L.reflect(F.col("bids"))
                     .alias("asks"))
    same = F.struct("instrument", "bids", "asks")
    keep = [c for c in books.columns if c not in ("instrument", "bids", "asks")]
    return books.select(*keep, F.explode(F.array(same, other)).alias("_b")).select(
        *keep, "_b.*")


# ── exchange with one token per outcome ──────────────────────────────────────

def token_frames(df: DataFrame) -> DataFrame:
    """One row per message; a frame is a message or an array of them."""
    many = F.from_json("raw", "ARRAY<STRING>")
    items = F.when(F.ltrim("raw").startswith("["), many).otherwise(F.array("raw"))
    return df.withColumn("raw", F.explode(items))


def token_book(df: DataFrame) -> DataFrame:
    df = _decode(df, "event_type STRING, type STRING, asset_id STRING, bids ARRAY<STRING>, "
                     "asks ARRAY<STRING>")
    m = F.col("_m")
    rows = df.filter(F.coalesce(m["event_type"], m["type"]) == "book")
    return rows.select(*[c for c in df.columns if c not in ("raw", "_m")],
                       m["asset_id"].alias("asset_id"),
                       L.normalize(raw_levels(m["bids"]), "bid").alias("bids"),
                       L.normalize(raw_levels(m["asks"]), "ask").alias("asks"))


def token_changes(df: DataFrame) -> DataFrame:
    """Absolute level updates; size zero removes the level."""
    change = "ARRAY<STRUCT<asset_id: STRING, price: STRING, size: STRING, side: STRING>>"
    df = _decode(df, f"event_type STRING, type STRING, price_changes {change}, "
                     f"changes {change}")
    m = F.col("_m")
    rows = df.filter(F.coalesce(m["event_type"], m["type"]) == "price_change")
    keep = [c for c in df.columns if c not in ("raw", "_m")]
    rows = rows.select(*keep, F.posexplode(F.coalesce(m["price_changes"], m["changes"]))
                       .alias("pos", "_c"))
    side = F.upper("_c.side")
    return rows.select(
        *keep, "pos", F.col("_c.asset_id").alias("asset_id"),
        num(F.col("_c.price")).alias("px"), num(F.col("_c.size")).alias("qty"),
        F.when(side == "BUY", "bid").when(side == "SELL", "ask").alias("side"),
    ).filter((F.col("asset_id") != "") & F.col("px").isNotNull() & F.col("qty").isNotNull()
             & F.col("side").isNotNull())


def token_trade(df: DataFrame) -> DataFrame:
    df = _decode(df, "event_type STRING, type STRING, asset_id STRING, price STRING, "
                     "size STRING, side STRING")
    m = F.col("_m")
    rows = df.filter(F.coalesce(m["event_type"], m["type"]) == "last_trade_price")
    return rows.select(
        *[c for c in df.columns if c not in ("raw", "_m")], m["asset_id"].alias("asset_id"),
        num(m["price"]).alias("price"), num(m["size"]).alias("qty"),
        F.when(F.upper(m["side"]) == "BUY", "Buy").otherwise("Sell").alias("side"),
        F.col("recv_ts_ns").alias("exch_ts_ns")).filter(
        F.col("price").isNotNull() & F.col("qty").isNotNull())


def token_market(df: DataFrame, window_s: int) -> DataFrame:
    """Catalog row; ``start_s`` is the window start named by the slug, expiry follows from it."""
    df = _decode(df, "conditionId STRING, condition_id STRING, id STRING, clobTokenIds STRING, "
                     "outcomes STRING, orderMinSize STRING, orderPriceMinTickSize STRING, "
                     "feeSchedule STRUCT<rate: STRING>")
    m = F.col("_m")
    cid = F.coalesce(m["conditionId"], m["condition_id"], m["id"])
    tokens, names = string_array(m["clobTokenIds"]), string_array(m["outcomes"])
    labels = F.coalesce(names, F.array().cast("ARRAY<STRING>"))
    hits = F.transform(labels, lambda o: F.lower(o).isin("up", "yes"))
    up = F.greatest(F.coalesce(F.array_position(hits, True), F.lit(1)), F.lit(1)).cast("int") - 1
    down = F.when(up == 0, 1).otherwise(0)

    def inst(i, default):
        return F.concat(F.lit("polymarket."), cid, F.lit("."),
                        F.upper(F.coalesce(F.get(labels, i), F.lit(default))))

    return df.filter(cid.isNotNull() & (F.size(tokens) >= 2)).select(
        *[c for c in df.columns if c not in ("raw", "_m")], cid.alias("market_id"),
        inst(up, "UP").alias("up_instrument"), inst(down, "DOWN").alias("down_instrument"),
        F.get(tokens, up).alias("up_token"), F.get(tokens, down).alias("down_token"),
        (F.col("start_s") * NS).alias("start_ts_ns"),
        ((F.col("start_s") + window_s) * NS).alias("expiry_ts_ns"),
        num(m["orderMinSize"]).alias("min_order_size"),
        num(m["orderPriceMinTickSize"]).alias("tick_size"),
        num(m["feeSchedule"]["rate"]).alias("fee_rate"))


# ── reference venues ─────────────────────────────────────────────────────────

def _data(df: DataFrame) -> DataFrame:
    """Unwrap ``{stream, data: {...}}`` frames."""
    return df.withColumn("raw", F.coalesce(F.get_json_object("raw", "$.data"), F.col("raw")))


def perp_depth(df: DataFrame) -> DataFrame:
    """Sequenced depth update (first, last and previous update id); absolute sizes."""
    df = _data(df)  # field names differ only by case, so they are read by path
    first = F.get_json_object("raw", "$.U").try_cast("long")
    last = F.get_json_object("raw", "$.u").try_cast("long")
    kind = F.get_json_object("raw", "$.e")
    at = F.coalesce(F.get_json_object("raw", "$.T"), F.get_json_object("raw", "$.E"))

    def levels(path):
        pairs = F.from_json(F.get_json_object("raw", path), "ARRAY<ARRAY<STRING>>")
        return F.transform(pairs, lambda p: L.level(num(F.get(p, F.lit(0))),
                                                    num(F.get(p, F.lit(1)))))

    return df.filter((kind == "depthUpdate") & first.isNotNull() & last.isNotNull()).select(
        *[c for c in df.columns if c != "raw"], first.alias("first_id"), last.alias("last_id"),
        F.coalesce(F.get_json_object("raw", "$.pu").try_cast("long"), F.lit(-1)).alias("prev_id"),
        levels("$.b").alias("bids"), levels("$.a").alias("asks"),
        (F.coalesce(at.try_cast("long"), I.int_div(F.col("recv_ts_ns"), US)) * US)
        .alias("exch_ts_ns"))


def _ticker(df: DataFrame, bid: str, ask: str, bid_sz: str, ask_sz: str, keep_if=None,
            exch=None) -> DataFrame:
    """Best quotes read by path; rows without both prices are dropped, sizes default to 0."""
    path = lambda p: num(F.get_json_object("raw", p))
    rows = df if keep_if is None else df.filter(keep_if)
    out = rows.select(
        *[c for c in df.columns if c != "raw"], path(bid).alias("bid"), path(ask).alias("ask"),
        F.coalesce(path(bid_sz), F.lit(0.0)).alias("bid_sz"),
        F.coalesce(path(ask_sz), F.lit(0.0)).alias("ask_sz"),
        (exch if exch is not None else F.col("recv_ts_ns")).alias("exch_ts_ns"))
    return out.filter(F.col("bid").isNotNull() & F.col("ask").isNotNull())


def perp_ticker(df: DataFrame) -> DataFrame:
    """Best bid and ask frame; spot frames omit the event name."""
    df = _data(df)
    kind = F.get_json_object("raw", "$.e")
    at = F.coalesce(F.get_json_object("raw", "$.T"), F.get_json_object("raw", "$.E"))
    exch = F.coalesce(at.try_cast("long"), I.int_div(F.col("recv_ts_ns"), US)) * US
    return _ticker(df, "$.b", "$.a", "$.B", "$.A",
                   keep_if=kind.isNull() | (kind == "bookTicker"), exch=exch)


def perp_agg_trade(df: DataFrame) -> DataFrame:
    """Traded quantity and trade id (null if absent) of a trade frame; frames without quantity are dropped."""
    df = _data(df)
    qty = num(F.get_json_object("raw", "$.q"))
    rows = df.withColumn("qty", qty).withColumn(
        "trade_id", F.get_json_object("raw", "$.a").try_cast("long"))
    return rows.filter(F.col("qty").isNotNull()).drop("raw")


def spot_ticker(df: DataFrame) -> DataFrame:
    """Ticker channel with best bid and ask fields."""
    return _ticker(df, "$.best_bid", "$.best_ask", "$.best_bid_size", "$.best_ask_size",
                   keep_if=F.get_json_object("raw", "$.type") == "ticker")


def spot_us_ticker(df: DataFrame) -> DataFrame:
    return _ticker(df, "$.b", "$.a", "$.B", "$.A")


def channel_ticker(df: DataFrame) -> DataFrame:
    """Channel frames whose ``data`` is a one-element array of quotes."""
    return _ticker(df, "$.data[0].bid", "$.data[0].ask", "$.data[0].bid_qty", "$.data[0].ask_qty",
                   keep_if=F.get_json_object("raw", "$.channel") == "ticker")


def book_channel(df: DataFrame) -> DataFrame:
    """Order-book channel: best level and the venue's own microsecond clock."""
    us = F.get_json_object("raw", "$.data.microtimestamp").try_cast("long")
    return _ticker(df, "$.data.bids[0][0]", "$.data.asks[0][0]", "$.data.bids[0][1]",
                   "$.data.asks[0][1]", keep_if=F.get_json_object("raw", "$.event") == "data",
                   exch=F.coalesce(us * 1000, F.col("recv_ts_ns")))


def change_feed(df: DataFrame, *, order: str, chunk: int) -> DataFrame:
    """Best-quote change events; each frame updates one or both sides, the other carries on."""
    event = "STRUCT<type: STRING, side: STRING, price: STRING, remaining: STRING>"
    df = _decode(df, f"type STRING, events ARRAY<{event}>")
    kept = F.filter(F.col("_m.events"), lambda e: (e["type"] == "change")
                    & num(e["price"]).isNotNull() & num(e["remaining"]).isNotNull())
    rows = df.filter(F.col("_m.type") == "update").withColumn("_e", kept)

    def side(name):
        mine = F.filter("_e", lambda e: e["side"] == name)
        last = F.try_element_at(mine, F.lit(-1))
        return F.when(last.isNotNull(), L.level(num(last["price"]), num(last["remaining"])))

    rows = rows.withColumn("_bid", side("bid")).withColumn("_ask", side("ask"))
    rows = rows.filter(F.col("_bid").isNotNull() | F.col("_ask").isNotNull())
    rows = C.fill_forward(rows, {"_bid": "_b", "_ask": "_a"}, by=[], ts="recv_ts_ns",
                          order=[order], chunk=chunk)
    keep = [c for c in df.columns if c not in ("raw", "_m")]
    return rows.select(
        *keep, F.col("_b.px").alias("bid"), F.col("_a.px").alias("ask"),
        F.col("_b.qty").alias("bid_sz"), F.col("_a.qty").alias("ask_sz")).filter(
        (F.col("bid") > 0) & (F.col("ask") > 0))


def futures_top(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fixed-point top of book; ``symbols`` maps instrument id to root.

    Rows with an undefined price on either side are dropped.
    """
    defined = (F.col("bid_px") != UNDEF_PRICE) & (F.col("ask_px") != UNDEF_PRICE)
    rows = df.filter(defined).join(symbols, "instrument_id", "left")
    root = F.coalesce("root", F.concat(F.lit("id"), F.col("instrument_id").cast("string")))
    return rows.select(
        *[c for c in df.columns if c not in ("bid_px", "ask_px", "instrument_id")],
        F.concat(F.lit("databento."), root).alias("instrument"),
        (F.col("bid_px") / FIXED_SCALE).alias("bid"),
        (F.col("ask_px") / FIXED_SCALE).alias("ask"))


# ── landed REST pages ────────────────────────────────────────────────────────

def market_pages(pages: DataFrame) -> DataFrame:
    """Settled markets of paged responses; window length 900 s back from the close."""
    item = ("STRUCT<ticker: STRING, close_time: STRING, floor_strike: DOUBLE, result: STRING, "
            "expiration_value: STRING>")
    rows = pages.select(F.explode(F.from_json("raw", f"markets ARRAY<{item}>")["markets"])
                        .alias("m"))
    close_ts = I.int_div(I.rfc3339_ns(F.col("m.close_time")), NS)
    return rows.select(
        "m.ticker", (close_ts - 900).alias("open_ts"), close_ts.alias("close_ts"),
        F.col("m.floor_strike").alias("strike"), "m.result", "m.expiration_value").filter(
        F.col("strike").isNotNull() & F.col("result").isin("yes", "no")).dropDuplicates(["ticker"])


def trade_pages(pages: DataFrame) -> DataFrame:
    item = "STRUCT<yes_price_dollars: STRING, yes_price: STRING, created_time: STRING>"
    rows = pages.select("ticker", F.explode(F.from_json(
        "raw", f"trades ARRAY<{item}>")["trades"]).alias("t"))
    px = F.coalesce(num(F.col("t.yes_price_dollars")), num(F.col("t.yes_price")))
    return rows.select("ticker", I.int_div(I.rfc3339_ns(F.col("t.created_time")), NS).alias("t"),
                       px.alias("px")).filter(F.col("px").isNotNull() & F.col("t").isNotNull())


def kline_pages(pages: DataFrame) -> DataFrame:
    """Second and close of each candle row ``[open_ms, o, h, l, close, ...]``."""
    rows = pages.select("ticker", F.explode(F.from_json("raw", "ARRAY<ARRAY<STRING>>")).alias("k"))
    return rows.select("ticker", I.int_div(F.get("k", F.lit(0)).cast("long"), 1000).alias("t"),
                       num(F.get("k", F.lit(4))).alias("spot"))


def last_per_second(trades: DataFrame, by: list[str]) -> DataFrame:
    """Latest price of each second; ``order`` breaks ties inside it."""
    return trades.groupBy(*by, "t").agg(F.max_by("px", "order").alias("px"))
