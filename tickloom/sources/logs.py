"""Trader log text to typed rows, one pattern per record kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terminal colour codes and the record formats of the log.
ANSI = r"\x1b\[[0-9;]*m"
MARK = "\x01"
NUM, SIGNED = r"([\d.]+)", r"([-+]?[\d.]+)"
KINDS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "fairlog": (
        rf"^(\S+Z).*fairlog\S* (\S+) tte={NUM} px={NUM} cb=(\S+) mid={NUM} fair={NUM} "
        rf"db={SIGNED} dr={SIGNED}",
        [("at", "string"), ("instrument", "string"), ("tte_s", "double"), ("px", "double"),
         ("cb", "double"), ("mid", "double"), ("fair", "double"), ("d_b", "double"),
         ("d_rho", "double")]),
    "calib": (
        rf"^(\S+Z).*calib (\S+) tte={NUM}s rows=(\d+) db={SIGNED} dr={SIGNED}",
        [("at", "string"), ("instrument", "string"), ("tte_s", "double"), ("rows", "int"),
         ("d_b", "double"), ("d_rho", "double")]),
    "chase": (
        rf"CHASE trade=(\S+) signal_ask={NUM} fill_ask={SIGNED} drift_c={SIGNED} ask_sz={NUM} "
        r"filled=(true|false)",
        [("trade_id", "string"), ("signal_ask", "double"), ("fill_ask", "double"),
         ("drift_c", "double"), ("ask_sz", "double"), ("filled", "boolean")]),
    "hold": (
        rf"HOLD trade=(\S+) inst=(\S+) h=(\d+) qty={NUM} filled={NUM} entry={NUM} exit={NUM} "
        rf"gross_c={SIGNED} net_c={SIGNED}",
        [("trade_id", "string"), ("instrument", "string"), ("hold_ms", "long"),
         ("qty", "double"), ("filled", "double"), ("entry", "double"), ("exit", "double"),
         ("gross_c", "double"), ("net_c", "double")]),
    "maker": (
        rf"MAKER trade=(\S+) inst=(\S+) outcome=(\w+) offer={NUM} bid0={NUM} cross={NUM} "
        rf"maker_net={SIGNED} taker_net={SIGNED} gain_c={SIGNED}",
        [("trade_id", "string"), ("instrument", "string"), ("outcome", "string"),
         ("offer", "double"), ("bid0", "double"), ("cross", "double"), ("maker_net", "double"),
         ("taker_net", "double"), ("gain_c", "double")]),
    "pxmeta": (
        rf"PXMETA trade=(\S+) inst=(\S+) tte_ms=(\S+) pre_move_c=(\S+) signal_ask={NUM} "
        rf"bps={SIGNED} yes_px={NUM} tgt_c=(\S+)",
        [("trade_id", "string"), ("instrument", "string"), ("tte_ms", "long"),
         ("pre_move_c", "double"), ("signal_ask", "double"), ("bps", "double"),
         ("yes_px", "double"), ("tgt_c", "double")]),
    "pxprobe": (
        rf"PXPROBE trade=(\S+) inst=(\S+) t_ms=(\d+) bid={NUM} ask={NUM} mid={NUM} "
        rf"dmid_c={SIGNED} dask_c={SIGNED} bsz={NUM} asz={NUM} bdep={NUM}\((\d+)\) "
        rf"adep={NUM}\((\d+)\)",
        [("trade_id", "string"), ("instrument", "string"), ("t_ms", "long"), ("bid", "double"),
         ("ask", "double"), ("mid", "double"), ("dmid_c", "double"), ("dask_c", "double"),
         ("bid_sz", "double"), ("ask_sz", "double"), ("bid_depth", "double"),
         ("bid_levels", "int"), ("ask_depth", "double"), ("ask_levels", "int")]),
    "pxvol": (
        rf"PXVOL trade=(\S+) t_ms=(\d+) tvol={NUM}",
        [("trade_id", "string"), ("t_ms", "long"), ("tvol", "double")]),
    "episode": (
        rf"episode\S* (\S+) (RE-ARM|DISARM) tte={NUM} fair={NUM} mid={NUM} gap={SIGNED}",
        [("instrument", "string"), ("action", "string"), ("tte_s", "double"),
         ("fair", "double"), ("mid", "double"), ("gap", "double")]),
    "gapstats": (
        rf"delta_stats n=(\d+) mean_abs={NUM} mean_signed={SIGNED} p50={NUM} p90={NUM} p99={NUM} "
        rf"max={NUM} ge{NUM}=(\d+)",
        [("n", "long"), ("mean_abs", "double"), ("mean_signed", "double"), ("p50", "double"),
         ("p90", "double"), ("p99", "double"), ("max", "double"), ("delta", "double"),
         ("ge_delta", "long")]),
}
WORDS = {"fairlog": "fairlog", "calib": "calib ", "chase": "CHASE trade=", "hold": "HOLD trade=",
         "maker": "MAKER trade=", "pxmeta": "PXMETA trade=", "pxprobe": "PXPROBE trade=",
         "pxvol": "PXVOL trade=", "episode": "ARM tte=", "gapstats": "delta_stats n="}
TRADE_JSON = ("trade_id STRING, outcome STRING, instrument STRING, direction INT, "
              "pnl_gross DOUBLE, pnl_net DOUBLE, slippage_entry_c DOUBLE, slippage_exit_c DOUBLE")


def parse_log(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Rows of one record kind; lines of other kinds are dropped."""
    clean = F.regexp_replace(F.col(column), ANSI, "")
    keep = [c for c in lines.columns if c != column]
    if kind == "trade":
        body = F.regexp_extract(clean, r"TRADE (\{.*)$", 1)
        parsed = F.from_json(body, TRADE_JSON)
        return lines.select(*keep, parsed.alias("_r")).select(*keep, "_r.*").filter(
            F.col("trade_id").isNotNull())
    pattern, fields = KINDS[kind]
    # one pass of the pattern per line: groups are rewritten to a separated list
    whole = (pattern if pattern.startswith("^") else f"^.*?{pattern}") + ".*$"
    groups = MARK + MARK.join(f"${i}" for i in range(1, len(fields) + 1))
    split = F.split(F.regexp_replace(clean, whole, groups), MARK)
    # a plain substring test spares most lines the pattern
    parts = lines.filter(F.col(column).contains(WORDS[kind])).select(
        *keep, F.explode(F.array(split)).alias("_p"))
    parts = parts.filter(F.size("_p") == len(fields) + 1)
    cols = []
    for i, (name, dtype) in enumerate(fields, start=1):
        value = F.get("_p", F.lit(i))
        cols.append((value if dtype == "string" else value.try_cast(dtype)).alias(name))
    return parts.select(*keep, *cols)


def read_trader_log(spark, path: str, kind: str) -> DataFrame:
    return parse_log(spark.read.text(path), kind)
