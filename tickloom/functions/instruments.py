"""Topics, instrument ids, tickers and clocks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prediction venues, their outcome labels and taker delay in milliseconds.
VENUES = {"polymarket": ("UP", "DOWN", 250), "kalshi": ("YES", "NO", 0)}


def int_div(a: Column, b: int) -> Column:
    """Whole quotient in integer arithmetic; nanoseconds do not fit a double."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def topic_regex(pattern: str) -> str:
    """Regex for a dotted topic with a leading dot: ``*`` one segment, ``#`` zero or more."""
    parts = {"*": r"\.[^.]+", "#": r"(?:\.[^.]+)*"}
    return "^" + "".join(parts.get(s, r"\." + re.escape(s)) for s in pattern.split(".")) + "$"


def topic_match(topic: Column, pattern: str) -> Column:
    return F.concat(F.lit("."), topic).rlike(topic_regex(pattern))


def venue_of(instrument: Column) -> Column:
    """Prediction venue of an id, null for any other prefix."""
    head = F.split_part(instrument, F.lit("."), F.lit(1))
    return F.when(head.isin(*VENUES), head)


def market_id(instrument: Column) -> Column:
    """Middle of ``venue.market.outcome`` for prediction venues."""
    inner = F.regexp_extract(instrument, r"^[^.]+\.(.+)\.[^.]*$", 1)
    return F.when(venue_of(instrument).isNotNull() & (inner != ""), inner)


def outcome_label(instrument: Column) -> Column:
    return F.when(venue_of(instrument).isNotNull(),
                  F.regexp_extract(instrument, r"\.([^.]*)$", 1))


def instrument_kind(instrument: Column) -> Column:
    return (F.when(instrument.startswith("binance."), "CryptoPerp")
            .when(instrument.startswith("polymarket."), "PredictionOutcome").otherwise("Other"))


def _swap(instrument: Column, pairs) -> Column:
    out = None
    for venue, have, want in pairs:
        hit = instrument.startswith(f"{venue}.") & instrument.endswith(f".{have}")
        new = F.regexp_replace(instrument, rf"\.{have}$", f".{want}")
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(instrument)


def complement(instrument: Column) -> Column:
    """The other outcome of the same market, from either side."""
    return _swap(instrument, [p for v, (y, n, _) in VENUES.items()
                              for p in ((v, y, n), (v, n, y))])


def traded_instrument(target: Column, direction: Column) -> Column:
    """Outcome bought for a signal on the yes side: itself going up, the other going down."""
    down = _swap(target, [(v, y, n) for v, (y, n, _) in VENUES.items()])
    return F.when(direction >= 0, target).otherwise(down)


def yes_side(instrument: Column) -> Column:
    return _swap(instrument, [(v, n, y) for v, (y, n, _) in VENUES.items()])


def stream_of(topic: Column) -> Column:
    """``market.<venue>...<stream>`` names its stream last; any other topic, first."""
    first = F.split_part(topic, F.lit("."), F.lit(1))
    return F.when(first == "market", F.split_part(topic, F.lit("."), F.lit(-1))).otherwise(first)


def topic_venue(topic: Column, source: Column) -> Column:
    parts = F.split(topic, r"\.")
    named = (parts[0] == "market") & (F.size(parts) > 1)
    return F.when(named, F.get(parts, F.lit(1))).otherwise(source)


def utc_date_ns(ts_ns: Column) -> Column:
    return F.to_date(F.timestamp_micros(int_div(ts_ns, 1000)))


def strike_of(ticker: Column) -> Column:
    """Strike behind the last ``-T`` of a laddered ticker."""
    text = F.regexp_extract(ticker, r"-T([0-9]+\.?[0-9]*)$", 1)
    return F.when(text != "", text.cast("double"))


def settlement_ns(ticker: Column, zone: str = "America/New_York",
                  fixed_offset_h: int | None = None) -> Column:
    """Settlement time of ``...-YYMONDD[H]HHMM...`` tickers, local to ``zone``.

    Give ``fixed_offset_h`` (for example -4) for series quoted at a fixed offset.
    """
    stamp = r"-(\d{2}[A-Z]{3}\d{2})H?(\d{4})"
    day, clock = F.regexp_extract(ticker, stamp, 1), F.regexp_extract(ticker, stamp, 2)
    proper = F.concat(F.substring(day, 1, 2), F.initcap(F.lower(F.substring(day, 3, 3))),
                      F.substring(day, 6, 2), clock)
    local = F.try_to_timestamp(proper, F.lit("yyMMMddHHmm"))
    if fixed_offset_h is None:
        utc = F.to_utc_timestamp(local, zone)
    else:
        utc = local - F.expr(f"INTERVAL '{fixed_offset_h}' HOUR")
    return F.unix_micros(utc) * 1000


def window_start(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width))


def next_windows(ts: Column, width: int, n: int) -> Column:
    """Start of the window holding ``ts`` and of the ``n`` following ones."""
    start = window_start(ts, width)
    return F.sequence(start, start + F.lit(n * width), F.lit(width))


def rfc3339_ns(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def epoch_ns(value: Column) -> Column:
    """Nanoseconds from a unix time whose unit shows in its magnitude."""
    return (F.when(value < 100_000_000_000, value * 1_000_000_000)
            .when(value < 100_000_000_000_000, value * 1_000_000)
            .when(value < 100_000_000_000_000_000, value * 1000).otherwise(value))


def phase(now: Column, opened: Column, closed: Column) -> Column:
    return (F.when(now < opened, "Upcoming").when(now < closed, "Live").otherwise("Expired"))
