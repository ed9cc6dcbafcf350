import json

import pytest
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators import surface as U
from tickloom.sources import events as EV
from tickloom.sources import files, logs


def event_line(i, topic="market.binance.P.book"):
    return json.dumps({"topic": topic, "source": "s", "ts_ns": 1781416438838654500 + i * 86_400_000_000_000,
                       "seq": i, "payload": {"Book": {
                           "instrument": "binance.P", "bids": [[1.5, 2.0]], "asks": [[1.6, 1.0]],
                           "update_id": None, "exch_ts_ns": 1, "recv_ts_ns": 2}}})


def test_event_log_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(event_line(i),) for i in range(6)] + [('{"topic":',)], "value STRING")
    events = EV.parse_lines(lines)
    assert EV.bad_count(events).collect()[0].bad_lines == 1
    base = str(tmp_path / "lake")
    EV.write_events(EV.good(events).drop(EV.BAD), base)
    back = EV.read_events(spark, base, stream="book", venue="binance", dates=("2026-06-15", "2026-06-16"))
    rows = EV.books(EV.good(back)).collect()
    assert len(rows) == 2 and rows[0].bids[0].px == 1.5 and rows[0].event_ts_ns % 10 ** 9 == 838654500
    plan = back.select("payload")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_stream_source_and_sink(spark, tmp_path):
    src = str(tmp_path / "in")
    lines = spark.createDataFrame([(event_line(i),) for i in range(4)], "value STRING")
    EV.write_events(EV.parse_lines(lines).drop(EV.BAD), src)
    stream = EV.stream_events(spark, src)
    out = str(tmp_path / "out")
    EV.stream_to_files(stream.drop("stream", "venue", "date"), out, str(tmp_path / "cp"),
                       available_now=True).awaitTermination()
    assert EV.read_events(spark, out, stream="book").count() == 4


def test_sampler_days_with_missing_columns(spark, tmp_path):
    new, old = tmp_path / "new.csv", tmp_path / "old.csv"
    new.write_text("ts_ms,ticker,tte_ms,perp_bid,perp_ask,ybid,yask,cb_bid,cb_ask,cb_age_ms,perp_bid_sz,perp_ask_sz,band5\n"
                   "1000,T,5000,10,12,0.4,0.5,11,13,100,3,1,nan\n1050,T,4950,10,12,0.4,0.7,11,13,100,3,1,0.5\n")
    old.write_text("ts_ms,ticker,tte_ms,perp_bid,perp_ask,ybid,yask\n2000,T,4000,10,12,0.4,0.5\n")
    raw = files.read_sampler_raw(spark, [str(new), str(old)], ["band5"])
    rows = files.sampler_rows(raw, ["band5"]).orderBy("ts_ms").collect()
    assert len(rows) == 2  # the wide quote is dropped
    assert rows[0].imb1 == 0.5 and rows[0].cb_mid == 12 and rows[0].band5 is None
    assert rows[1].cb_mid is None and rows[1].spot == 11
    files.sampler_to_table(files.sampler_rows(raw), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def sampler_day(day, n, extra=()):
    """A day's text, with other columns and another order than the day before; every fifth line is short."""
    head = ["ticker", "ts_ms", "tte_ms", "perp_bid", "perp_ask", "ybid", "yask", *extra]
    head = head[day % 3:] + head[:day % 3]
    lines, want = [",".join(head)], []
    for i in range(n):
        row = dict(ticker=f"T{day}-{i}", ts_ms=day * 1000 + i, tte_ms=5000, perp_bid=10 + i, perp_ask=12 + i,
                   ybid=0.4, yask=0.5, band5=i / 4, note="x" * (i % 40))
        cells = [str(row[c]) for c in head]
        if i % 5 == 4:
            cells = cells[:-1]
            row[head[-1]] = None
        lines.append(",".join(cells))
        want.append((row["ticker"], row["ts_ms"], row["yask"], row["band5"] if "band5" in extra else None))
    return "\n".join(lines) + ("\n" if day % 2 else ""), want


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 1 << 20])
def test_sampler_ranges_hold_every_line_once(spark, tmp_path, range_bytes, monkeypatch):
    import gzip

    from tickloom.sources import csvdays

    want, n = [], 4 if range_bytes < 50 else 60
    for day in range(6):
        text, rows = sampler_day(day, n, (["band5"], ["note", "band5"], [])[day % 3])
        want += rows
        if day == 3:
            (tmp_path / f"d{day}.csv.gz").write_bytes(gzip.compress(text.encode()))
        else:
            (tmp_path / f"d{day}.csv").write_text(text)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "headed.csv").write_text("ticker,ts_ms\n")
    monkeypatch.setattr(csvdays, "BLOCK_BYTES", 64)
    reader = csvdays._Reader([str(tmp_path)], ["ticker", "ts_ms", "yask", "band5"], range_bytes)
    parts = reader.partitions()
    read = [r for p in parts for b in reader.read(p) for r in zip(*[c.to_pylist() for c in b.columns])]
    num = lambda kind, v: None if v is None else kind(v)
    got = sorted((a or "", num(int, b), num(float, c), num(float, d)) for a, b, c, d in read)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(((r[0] or "", *r[1:]) for r in want), key=key)
    if range_bytes == 100:
        assert len(parts) > 20


def test_sampler_days_are_one_scan(spark, tmp_path):
    want = 0
    for day in range(12):
        text, rows = sampler_day(day, 7)
        (tmp_path / f"2026-01-{day + 1:02d}.csv").write_text(text)
        want += len(rows)
    for path in (str(tmp_path), f"file:{tmp_path}", f"{tmp_path}/2026-01-*.csv"):
        raw = files.read_sampler_raw(spark, [path], range_bytes=150)
        assert raw.count() == want
        assert raw._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    assert files.read_sampler_raw(spark, [str(tmp_path)], range_bytes=150).rdd.getNumPartitions() > 12
    with pytest.raises(Exception, match="nowhere"):
        files.read_sampler_raw(spark, [str(tmp_path / "nowhere")]).count()


def test_tabular_inputs(spark, tmp_path):
    (tmp_path / "events_meta.csv").write_text(
        "ticker,open_ts,close_ts,strike,result,expiration_value,n_trades\nA,0,900,5,yes,,60\n")
    (tmp_path / "rows.csv").write_text("ticker,t,tte_s,spot,prob,n_trades,strike,outcome\nA,1,899,5.5,0.6,2,5,1\nB,1,899,5,0.5,1,5,0\n")
    rows = files.read_event_rows(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].open_ts == 0 and rows[0].prob == 0.6
    (tmp_path / "v.csv").write_text("ticker,t,venue,px\nA,1,kraken,5.25\n")
    assert files.read_venue_px(spark, str(tmp_path / "v.csv")).collect()[0].px == 5.25
    (tmp_path / "bp.csv").write_text("2024-01-01T00:00:00.000001,5.5\n")
    tick = files.read_ticks(spark, str(tmp_path), "bp").collect()[0]
    assert tick.ts == 1704067200000001 and tick.mid == 5.5
    (tmp_path / "f.csv").write_text("t,imb1\n7,0.25\n")
    assert files.read_features(spark, str(tmp_path / "f.csv"), ["imb1"]).collect()[0].t_ms == 7000
    (tmp_path / "m.json").write_text(json.dumps({"A": {"strike": 5.0, "result": "yes", "close_ts": "x"},
                                                 "B": {"strike": None, "result": ""}}))
    assert [r.ticker for r in files.read_meta(spark, str(tmp_path / "m.json")).collect()] == ["A"]


def test_lake_scan_prunes_and_reads_three_columns(spark, tmp_path):
    base = str(tmp_path / "lake")
    df = spark.createDataFrame([(1, 1, "[[1,2]]", "[[2,1]]", "l2", "b", "P", s, d) for s in ("X", "Y")
                                for d in ("2026-01-01", "2026-01-02", "2026-01-03")],
                               "recv_ts_ns LONG, exch_ts_ns LONG, bids_json STRING, asks_json STRING, "
                               "stream STRING, venue STRING, market STRING, symbol STRING, date STRING")
    df.write.partitionBy("stream", "venue", "market", "symbol", "date").parquet(base)
    out = files.read_l2(spark, base, stream="l2", venue="b", market="P", symbol="X", first="2026-01-02", last="2026-01-03")
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "exch_ts_ns" not in plan.split("ReadSchema")[1]


def test_log_kinds(spark):
    text = """2026-07-22T11:25:03.1Z  INFO fairlog: kalshi.K.YES tte=120.0 px=100.50 cb=100.25 mid=0.5000 fair=0.5500 db=+0.00100 dr=-0.02000
\x1b[2mx\x1b[0m PXMETA trade=t1 inst=i tte_ms=? pre_move_c=+1.50 signal_ask=0.400 bps=-3.10 yes_px=0.410 tgt_c=+0.5
PXPROBE trade=t1 inst=i t_ms=100 bid=0.400 ask=0.420 mid=0.410 dmid_c=1.00 dask_c=-1.00 bsz=5 asz=6 bdep=50(3) adep=60(4)
PXVOL trade=t1 t_ms=100 tvol=12
INFO episode: kalshi.K.YES DISARM tte=100.0 fair=0.5 mid=0.4 gap=+0.1000 entry#1 gate=PASS
INFO gapstats: delta_stats n=9 mean_abs=0.0100 mean_signed=-0.0100 p50=0.0100 p90=0.0200 p99=0.0300 max=0.0400 ge0.03=2
TRADE {"trade_id": "t1", "pnl_net": -0.5, "outcome": "Closed"}
TRADE {broken"""
    lines = spark.createDataFrame([(t,) for t in text.split("\n")], "value STRING")
    get = lambda k: logs.parse_log(lines, k).collect()
    assert get("fairlog")[0].d_rho == -0.02 and get("fairlog")[0].instrument == "kalshi.K.YES"
    meta = get("pxmeta")[0]
    assert meta.tte_ms is None and meta.pre_move_c == 1.5
    assert get("pxprobe")[0].ask_levels == 4 and get("pxvol")[0].tvol == 12
    assert get("episode")[0].action == "DISARM" and get("gapstats")[0].ge_delta == 2
    assert len(get("trade")) == 1 and get("trade")[0].pnl_net == -0.5


def test_model_checks(spark, tmp_path):
    m = U.seeded_model(2, ("mom60",), hidden=4)
    js = {"arch": {"hidden": 4, "mode": "direct"}, "rho_bar": 1.0, "rho_cb": 1.1, "b_scale": 50.0,
          "extras": ["mom60"], "mu": [0.0], "sd": [1.0],
          "layers": [{"w": w.tolist(), "b": b.tolist()} for w, b in m.layers]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(js))
    loaded = U.load_model(str(path))
    assert loaded.channels == 2 and loaded.extras == ("mom60",) and len(loaded.digest) == 64
    for broken in ({"mu": []}, {"arch": {"hidden": 5, "mode": "direct"}}, {"arch": {"hidden": 4, "mode": "x"}},
                   {"rho_cb": None}, {"layers": js["layers"][:2]}):
        with pytest.raises(ValueError):
            U.model_from_json(json.dumps({**js, **broken}))


def test_schemas_parse(spark):
    for ddl in (schema.EVENT, schema.SAMPLER, schema.MODEL, schema.EVENTS_META, schema.L2_SNAPSHOT):
        spark.createDataFrame([], ddl)
    big = spark.createDataFrame([(event_line(1).replace('"seq": 1', '"seq": 1'),)], "value STRING")
    assert EV.parse_lines(big).select("payload.Book.update_id").collect()[0][0] is None


def test_results_sink(spark, tmp_path):
    df = spark.range(3).withColumn("date", F.lit("2026-01-01"))
    EV.write_results(df, str(tmp_path / "r"), "csv")
    EV.write_results(df, str(tmp_path / "p"), partition_by=("date",))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    with pytest.raises(Exception):
        EV.write_results(df, str(tmp_path / "p"))
