"""Explicit schemas of the recorded and derived tables.

Times in nanoseconds stay BIGINT: timestamps here are only microseconds. Unsigned
64-bit hashes are DECIMAL(20,0), which holds them exactly.
"""

from __future__ import annotations

from pyspark.sql import types as T

LADDER = "ARRAY<STRUCT<px: DOUBLE, qty: DOUBLE>>"
RAW_LADDER = "ARRAY<ARRAY<DOUBLE>>"

TRIGGER = "STRUCT<move_bps: DOUBLE, window_ms: BIGINT, yes_price: DOUBLE, target_move_c: DOUBLE>"
LEG = ("STRUCT<qty: DOUBLE, vwap: DOUBLE, fees: DOUBLE, n_fills: INT, first_ts_ns: BIGINT, "
       "last_ts_ns: BIGINT>")

PAYLOADS = {
    "Book": f"instrument STRING, bids {RAW_LADDER}, asks {RAW_LADDER}, update_id BIGINT, "
            "exch_ts_ns BIGINT, recv_ts_ns BIGINT",
    "Trade": "instrument STRING, price DOUBLE, qty DOUBLE, side STRING, exch_ts_ns BIGINT, "
             "recv_ts_ns BIGINT",
    "Liq": "instrument STRING, price DOUBLE, qty DOUBLE, side STRING, recv_ts_ns BIGINT",
    "Meta": "instrument STRING, kind STRING, status STRING, start_ts_ns BIGINT, "
            "expiry_ts_ns BIGINT, winner STRING, min_order_size DOUBLE, tick_size DOUBLE, "
            "fee_rate DOUBLE, strike DOUBLE",
    "Signal": "strategy STRING, ts_ns BIGINT, reason STRING, reference STRING, target STRING, "
              f"direction TINYINT, trigger {TRIGGER}, hold_ms BIGINT, ttl_ms BIGINT",
    "Latency": "name STRING, latency_us DOUBLE, origin_ts_ns BIGINT, strategy STRING, "
               "target STRING",
    "ExecReport": "trade_id STRING, instrument STRING, state STRING, detail STRING, ts_ns BIGINT",
    "TradeRecord": "trade_id STRING, outcome STRING, direction TINYINT, instrument STRING, "
                   f"signal_ts_ns BIGINT, trigger {TRIGGER}, entry {LEG}, exit {LEG}, "
                   "hold_actual_ms BIGINT, pnl_gross DOUBLE, pnl_net DOUBLE, "
                   "slippage_entry_c DOUBLE, slippage_exit_c DOUBLE, "
                   "lat_signal_to_submit_ms DOUBLE, lat_submit_to_ack_ms DOUBLE, "
                   "lat_ack_to_fill_ms DOUBLE",
    "Position": "instrument STRING, qty DOUBLE, avg_cost DOUBLE, realized_pnl DOUBLE, "
                "fees_paid DOUBLE, mark_px DOUBLE, upnl DOUBLE, status STRING, cash_usdc DOUBLE",
    "Calib": "instrument STRING, reference STRING, seq BIGINT, ts_ns BIGINT, "
             "fitted_at_tte_s DOUBLE, rows INT, d_b DOUBLE, d_rho DOUBLE, bce DOUBLE, "
             "model_hash DECIMAL(20,0)",
}


def _struct(fields: str) -> str:
    """``a INT, b STRUCT<...>`` to ``STRUCT<a: INT, b: STRUCT<...>>``."""
    out, depth, word = [], 0, ""
    for ch in fields + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += ch
    return f"STRUCT<{', '.join(out)}>"


EVENT = ("topic STRING, source STRING, ts_ns BIGINT, seq BIGINT, payload STRUCT<"
         + ", ".join(f"{k}: {_struct(v)}" for k, v in PAYLOADS.items()) + ">")

SPOT_VENUES = ("spot", "kr", "bs", "gm")

SAMPLER = ", ".join(
    ["ts_ms BIGINT", "ticker STRING", "tte_ms BIGINT"]
    + [f"{c} DOUBLE" for c in (
        "perp_bid perp_ask ybid yask ybid_sz yask_sz cb_bid cb_ask cb_age_ms perp_bid_sz "
        "perp_ask_sz cb_bid_sz cb_ask_sz perp_age_ms cb_srv_age_ms").split()]
    + [f"{v}_{c} DOUBLE" for v in SPOT_VENUES
       for c in ("bid", "ask", "bid_sz", "ask_sz", "age_ms")])

EVENTS_META = ("ticker STRING, open_ts BIGINT, close_ts BIGINT, strike DOUBLE, result STRING, "
               "expiration_value STRING, n_trades BIGINT")
EVENT_ROWS = ("ticker STRING, t BIGINT, tte_s DOUBLE, spot DOUBLE, prob DOUBLE, n_trades BIGINT, "
              "strike DOUBLE, outcome INT")
VENUE_PX = "ticker STRING, t BIGINT, venue STRING, px DOUBLE"
TICKS = "ts TIMESTAMP, mid DOUBLE"
L2_SNAPSHOT = ("recv_ts_ns BIGINT, exch_ts_ns BIGINT, bids_json STRING, asks_json STRING, "
               "stream STRING, venue STRING, market STRING, symbol STRING, date DATE")
META_CACHE = "MAP<STRING, STRUCT<strike: DOUBLE, result: STRING, close_ts: STRING>>"
MODEL = ("arch STRUCT<hidden: INT, clamp: DOUBLE, act: STRING, logit: STRING, mode: STRING>, "
         "type STRING, rho_bar DOUBLE, rho_cb DOUBLE, rho_kr DOUBLE, b_scale DOUBLE, "
         "extras ARRAY<STRING>, mu ARRAY<DOUBLE>, sd ARRAY<DOUBLE>, "
         "layers ARRAY<STRUCT<w: ARRAY<ARRAY<DOUBLE>>, b: ARRAY<DOUBLE>>>")


def struct_of(fields: str, *first: T.StructField) -> T.StructType:
    """StructType of plain ``name TYPE`` pairs, usable before a session exists."""
    kinds = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
             "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}
    kinds |= {f"ARRAY<{n}>": T.ArrayType(k) for n, k in kinds.items()}
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([*first, *[T.StructField(n, kinds[k]) for n, k in pairs]])
