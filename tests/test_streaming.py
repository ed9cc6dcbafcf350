"""Streams and their batch forms give the same rows on the same files."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import folds
from tickloom.operators import signals as G
from tickloom.operators import surface as U
from tickloom.operators.ranges import link_intervals
from tickloom.streaming import state as ST

MS = 1000


def feed(spark, tmp_path, rows, ddl, files=4):
    """Write rows as several files in time order and read them back as a stream."""
    src = tmp_path / "src"
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))


def drain(spark, tmp_path, df):
    ST.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


TICK = "key STRING, ts LONG, seq LONG, v DOUBLE"


def ticks(n=240, seed=2):
    rng = random.Random(seed)
    t = 0
    out = []
    for i in range(n):
        t += rng.randrange(1, 9)
        out.append((rng.choice("ab"), t, i, round(rng.uniform(-1, 1), 3)))
    return out


@pytest.mark.parametrize("files", [1, 2, 7])
def test_throttle(spark, tmp_path, files):
    """Any number of files, in any order."""
    rows = ticks()
    random.Random(files).shuffle(rows)
    stream = feed(spark, tmp_path, rows, TICK, files)
    ends = tmp_path / "ends"
    spark.createDataFrame([], TICK).write.parquet(str(ends))
    both = stream.union(spark.readStream.schema(TICK).parquet(str(ends)))
    thin = ST.throttled(both, "key", 25, spark.createDataFrame([], TICK).schema, at=F.timestamp_millis("ts"),
                        late="5 seconds", per_ms=1)
    ST.run_to_table(thin, str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame([("a", 10**6, 0, 0.0), ("b", 10**6, 0, 0.0)], TICK).write.mode("append").parquet(str(ends))
    got = drain(spark, tmp_path, thin)
    want = folds.refractory(spark.createDataFrame(ticks(), TICK), by=["key"], ts="ts", gap=25, chunk=200)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())


def test_episodes(spark, tmp_path):
    stream = feed(spark, tmp_path, ticks(), TICK)
    got = drain(spark, tmp_path, ST.keyed(stream, "key", ST.Episodes(0.5, 0.1, "v"), TICK))
    want = folds.hysteresis(spark.createDataFrame(ticks(), TICK), "v", enter=0.5, leave=0.1, by=["key"], ts="ts",
                            order=["seq"], chunk=100)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())


def test_reference_moves(spark, tmp_path):
    rng = random.Random(7)
    rows, px, t = [], 100.0, 0
    for i in range(300):
        t += rng.randrange(20, 120) * MS
        kind = rng.choices(["ref", "quote", "meta"], [8, 3, 1])[0]
        if kind == "ref":
            px *= 1 + rng.gauss(0, 2e-4)
            rows.append(("k", "ref", t, i, "r", px, None, None))
        elif kind == "quote":
            rows.append(("k", "quote", t, i, rng.choice("AB"), round(rng.uniform(0.1, 0.9), 2), None, None))
        else:
            name = rng.choice("AB")
            rows.append(("k", "meta", t, i, name, None, rng.choice(["Live", "Live", "Expired"]), 10**9))
    ddl = "key STRING, kind STRING, ts LONG, seq LONG, instrument STRING, mid DOUBLE, status STRING, expiry LONG"
    out = "ts LONG, seq LONG, target STRING, move_bps DOUBLE, yes_price DOUBLE, direction INT"
    proc = ST.Moves(1000 * MS, 3.0, (0.2, 0.8), 60_000 * MS, 2000 * MS)
    got = drain(spark, tmp_path, ST.keyed(feed(spark, tmp_path, rows, ddl), "key", proc, out))
    df = spark.createDataFrame(rows, ddl)
    links = link_intervals(df.filter("kind = 'meta'").select(F.lit("k").alias("kind"), "instrument", "ts", "seq", "status"))
    want = G.move_signals(df.filter("kind = 'ref'").select("ts", "seq", "mid"),
                          df.filter("kind = 'quote'").select("instrument", "ts", "seq", "mid"),
                          links.withColumn("expiry", F.lit(10**9).cast("long")), window=1000 * MS, threshold_bps=3.0,
                          yes_band=(0.2, 0.8), min_tte=60_000 * MS, cooldown=2000 * MS, chunk=5000 * MS)
    a = sorted((r.seq, r.target, round(r.move_bps, 6)) for r in got.collect())
    b = sorted((r.seq, r.target, round(r.move_bps, 6)) for r in want.collect())
    assert a == b and a


def test_refits(spark, tmp_path):
    m = U.seeded_model(1, hidden=4, rho=2.0)
    rows = [("e", i, i, float(300 - i), 100 + (i % 7) / 3, 100.0, 0.4 + (i % 5) / 50) for i in range(280)]
    ddl = "ticker STRING, ts LONG, seq LONG, tte_s DOUBLE, spot DOUBLE, strike DOUBLE, mid DOUBLE"
    proc = ST.Refits(m, ["spot"], 240, 60, 60.0, 30, (6, 3))
    out = "ticker STRING, boundary DOUBLE, rows INT, d_b DOUBLE, d_rho DOUBLE"
    got = drain(spark, tmp_path, ST.keyed(feed(spark, tmp_path, rows, ddl), "ticker", proc, out)).orderBy("boundary").collect()
    want = U.calibrate(spark.createDataFrame(rows, ddl), m, px=["spot"], tte_max=240, step=60, window=60.0, first_steps=6,
                       refit_steps=3).orderBy("boundary").collect()
    assert [(r.boundary, r.rows, round(r.d_b, 9), round(r.d_rho, 9)) for r in got] == [
        (r.boundary, r.rows, round(r.d_b, 9), round(r.d_rho, 9)) for r in want]


def test_latest_and_conflation(spark, tmp_path):
    rows = [("a", i, i, float(i) if i % 2 else None, None if i % 3 else float(-i)) for i in range(1, 30)]
    ddl = "key STRING, ts LONG, seq LONG, bid DOUBLE, ask DOUBLE"
    out = "key STRING, version LONG, ts LONG, seq LONG, bid DOUBLE, ask DOUBLE"
    for files in (1, 2, 7):  # any number of files, in any order
        random.Random(files).shuffle(rows)
        stream = feed(spark, tmp_path / str(files), rows, ddl, files)
        got = ST.current(drain(spark, tmp_path / str(files), ST.keyed(stream, "key", ST.Latest(["bid", "ask"], "key"), out)), "key")
        assert [tuple(r) for r in got.collect()] == [("a", 29, 29, 29.0, -27.0)]
    batches = []
    q = ST.conflated(feed(spark, tmp_path / "c", rows, ddl), ["key"], lambda df, i: batches.append(df.count()))
    q.option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert batches and max(batches) == 1


def test_duplicates_and_late_volume(spark, tmp_path):
    rows = [("f1", "Matched", 1.0), ("f1", "Matched", 1.0), ("f1", "Confirmed", 1.0), ("f2", "Matched", 2.0)]
    fills = feed(spark, tmp_path, [(*r, i) for i, r in enumerate(rows)], "venue_trade_id STRING, status STRING, qty DOUBLE, s LONG")
    got = drain(spark, tmp_path, ST.dedupe_fills(fills.withColumn("at", F.timestamp_seconds("s"))))
    assert got.count() == 3
    trades = [("i", "t1", 100, 1.0), ("i", "t2", 100, 2.0), ("i", "t1", 100, 1.0), ("i", "t3", 103, 4.0), ("i", "t4", 101, 8.0),
              ("i", "t5", 130, 16.0), ("i", "t6", 160, 32.0)]
    ddl = "instrument STRING, trade_id STRING, s LONG, qty DOUBLE"
    once = ST.dedupe_trades(feed(spark, tmp_path / "d", trades, ddl).withColumn("at", F.timestamp_seconds("s")))
    assert drain(spark, tmp_path / "d", once).count() == 6
    vol = ST.late_volume(feed(spark, tmp_path / "v", trades[1:2] + trades[3:], ddl, files=5).withColumn("exch_at", F.timestamp_seconds("s")))
    out = {r.start.second: r.volume for r in drain(spark, tmp_path / "v", vol).collect()}
    assert out[40] == 2.0 and out[41] == 8.0 and out[43] == 4.0


@pytest.mark.parametrize("every", ["5 seconds"])
def test_heartbeat_streams(spark, tmp_path, every):
    from tickloom.operators.study import heartbeat
    rows = [("v", i) for i in range(40)]
    stream = feed(spark, tmp_path, rows, "venue STRING, s LONG").withColumn("at", F.timestamp_seconds("s"))
    out = drain(spark, tmp_path, heartbeat(stream.withWatermark("at", "1 second"), every))
    assert out.count() >= 6 and {r.n for r in out.collect()} == {5}
