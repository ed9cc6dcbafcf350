"""Reference-move signals, message selection, training jobs and streaming runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tickloom.operators import audit
from tickloom.operators import joint as J
from tickloom.operators import signals as G
from tickloom.operators import stats
from tickloom.operators import surface as U
from tickloom.plans.book_queries import r6
from tickloom.plans.registry import query
from tickloom.plans.roles import DAY, HOUR, MINUTE, SCORED, TICKS, scored, table, ticks
from tickloom.plans.strategy_queries import EPISODES, ONE, SEC, surface_sql
from tickloom.plans.source_queries import S, with_recv
from tickloom.session import fresh_path
from tickloom.sources import feeds
from tickloom.streaming import state as ST

WINDOW, COOL = 6 * HOUR, 8 * HOUR


def link_rows(spark, sf):
    """Lifecycle spans: each day one of three targets is live, for twenty hours."""
    t = ticks(spark, sf)
    days = t.select((F.col("ts") - F.pmod("ts", F.lit(DAY))).alias("from_ts")).distinct()
    name = F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "signup")]),
                        (F.pmod(F.expr(f"from_ts div {DAY}"), F.lit(3)) + 1).cast("int"))
    return days.select(F.lit("binary").alias("kind"), name.alias("instrument"), "from_ts",
                       (F.col("from_ts") + 20 * HOUR).alias("to_ts"), F.col("from_ts").alias("seq"))


@query("reference_move_signals", f"""WITH RECURSIVE {TICKS}, r AS (SELECT ts, seq, px FROM ticks WHERE instrument = 'view'),
w AS (SELECT *, ts - {WINDOW} AS want FROM r),
m AS (SELECT w.ts, w.seq, (w.px / nullif(p.px, 0) - 1) * 10000 AS bps FROM w ASOF JOIN r p ON w.want >= p.ts),
l AS (SELECT *, CASE (ts // {DAY}) % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'signup' END AS target FROM m
  WHERE abs(bps) >= 5000 AND ts % {DAY} < {20 * HOUR} AND {23 * HOUR} - ts % {DAY} >= {4 * HOUR}),
q AS (SELECT l.*, t.px AS yes, l.ts - {WINDOW} AS want FROM l ASOF JOIN ticks t ON l.target = t.instrument AND l.ts >= t.ts),
c AS (SELECT q.*, t.px AS before, row_number() OVER (ORDER BY q.ts) AS n FROM (SELECT * FROM q WHERE yes BETWEEN 2 AND 60) q
  ASOF LEFT JOIN ticks t ON q.target = t.instrument AND q.want >= t.ts),
k AS (SELECT n, ts, ts AS kept FROM c WHERE n = 1 UNION ALL
  SELECT c.n, c.ts, CASE WHEN c.ts - k.kept >= {COOL} THEN c.ts ELSE k.kept END FROM k JOIN c ON c.n = k.n + 1)
SELECT c.seq, c.target, round(bps, 4) + 0.0 AS move_bps, yes AS yes_price, round((yes - before) * 100, 4) + 0.0 AS target_move_c
FROM c JOIN k USING (n) WHERE k.kept = k.ts""")
def reference_move_signals(spark, sf):
    t = ticks(spark, sf)
    ref = t.filter("instrument = 'view'").select("ts", "seq", F.col("px").alias("mid"))
    quotes = t.select("instrument", "ts", "seq", F.col("px").alias("mid"))
    # expiry is 23 h into the day, the same for every day a target is live on
    links = link_rows(spark, sf).withColumn("expiry", F.col("from_ts") + 23 * HOUR)
    rows = _signals_by_span(ref, quotes, links)
    return rows.select("seq", "target", "yes_price", F.round("move_bps", 4).alias("move_bps"),
                       F.round("target_move_c", 4).alias("target_move_c"))


def _signals_by_span(ref, quotes, links):
    # targets recur here, so a span gets its own name: instrument@day
    name = F.concat_ws("@", "instrument", (F.col("from_ts")).cast("string"))
    named = links.withColumn("_n", name)
    spans = named.select("kind", F.col("_n").alias("instrument"), "from_ts", "to_ts", "seq", "expiry")
    mapped = named.select("instrument", "_n").join(quotes, "instrument").select(
        F.col("_n").alias("instrument"), "ts", "seq", "mid")
    out = G.move_signals(ref, mapped, spans, window=WINDOW, threshold_bps=5000.0, yes_band=(2, 60),
                         min_tte=4 * HOUR, cooldown=COOL, chunk=5 * DAY)
    return out.withColumn("target", F.split_part("target", F.lit("@"), F.lit(1)))


@query("conflated_latest", f"""WITH {TICKS}
SELECT instrument, k % 3 AS kind, max(ts) AS ts, arg_max(px, (ts, seq)) AS px FROM ticks GROUP BY 1, 2""")
def conflated_latest(spark, sf):
    t = ticks(spark, sf).withColumn("kind", F.col("k") % 3)
    return G.conflate(t, ["instrument", "kind"]).select("instrument", "kind", "ts", "px")


@query("first_triggers", f"""WITH {SCORED}, d AS (SELECT unnest([0.05, 0.1])::DOUBLE AS delta)
SELECT delta, ticker, arg_min(seq, (ts, seq)) AS seq FROM scored, d WHERE abs(gap) >= delta GROUP BY 1, 2""")
def first_triggers(spark, sf):
    return G.first_triggers(scored(spark, sf), [0.05, 0.1]).select("delta", "ticker", "seq")


@query("threshold_sweep", f"""WITH {SCORED}, d AS (SELECT unnest([0.02, 0.05, 0.1])::DOUBLE AS delta)
SELECT delta, instrument, count(*) FILTER (abs(gap) >= delta) AS hits FROM scored, d GROUP BY 1, 2""")
def threshold_sweep(spark, sf):
    rows = G.with_thresholds(scored(spark, sf), [0.02, 0.05, 0.1])
    return rows.groupBy("delta", "instrument").agg(
        F.count(F.when(F.abs("gap") >= F.col("delta"), 1)).alias("hits"))


@query("settlement_labels", """
SELECT l_orderkey AS ticker, l_linenumber AS n, l_partkey AS p, o_totalprice AS strike, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome,
  CASE WHEN (l_linenumber % 2 = 1) = (o_orderstatus = 'F') THEN 1 ELSE 0 END AS won
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def settlement_labels(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("ticker"), F.col("o_totalprice").alias("strike"),
        (F.col("o_orderstatus") == "F").cast("int").alias("outcome"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ticker"), F.col("l_linenumber").alias("n"),
                                             F.col("l_partkey").alias("p"))
    won = ((F.col("n") % 2 == 1) == (F.col("outcome") == 1)).cast("int")
    return li.join(o, "ticker").withColumn("won", won)


DEMEANED = EPISODES + f""",
g AS (SELECT *, CASE WHEN count(*) OVER z >= 5 THEN round(gap - avg(gap) OVER z, 9) END AS sig FROM scored
  WINDOW z AS (PARTITION BY ticker ORDER BY ts RANGE BETWEEN {120 * SEC} PRECEDING AND CURRENT ROW)),
rd AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS n FROM g),
wd AS (SELECT DISTINCT ticker, 0::BIGINT AS n, 0.0::DOUBLE AS st, false AS hit FROM rd
  UNION ALL
  SELECT rd.ticker, rd.n, CASE WHEN wd.st = 0 THEN CASE WHEN abs(rd.sig) >= 0.05::DOUBLE THEN sign(rd.sig) ELSE 0 END
      WHEN rd.sig * wd.st <= 0.02::DOUBLE THEN 0 ELSE wd.st END, coalesce(wd.st = 0 AND abs(rd.sig) >= 0.05::DOUBLE, false)
  FROM wd JOIN rd ON rd.ticker = wd.ticker AND rd.n = wd.n + 1)"""


@query("union_variants", DEMEANED + """
SELECT 'm0' AS model, ticker, seq FROM hits
UNION ALL SELECT 'm0.dm120', ticker, seq FROM wd JOIN rd USING (ticker, n) WHERE hit AND tte_s > 60""")
def union_variants(spark, sf):
    """Crossings of the gap and of the gap less its mean over the last 120 s, five samples at least."""
    from tickloom.operators import chunks as C
    from tickloom.operators import trades as T
    from tickloom.plans.strategy_queries import hits
    rows = C.trailing(scored(spark, sf), {"_mean": ("avg", "gap"), "_n": ("count", "gap")}, by=["ticker"], ts="ts",
                      span=120 * SEC, chunk=DAY)
    sig = F.when(F.col("_n") >= 5, F.round(F.col("gap") - F.col("_mean"), 9))
    demeaned = T.gap_crossings(rows.withColumn("sig", sig), 0.05, rearm=0.02, sig="sig", tte_min=60.0, chunk=DAY)
    return hits(spark, sf).select(F.lit("m0").alias("model"), "ticker", "seq").unionByName(
        demeaned.select(F.lit("m0.dm120").alias("model"), "ticker", "seq"))


@query("union_of_days", f"""WITH {SCORED}
SELECT instrument, count(*) AS n, count(CASE WHEN date >= '2024-01-15' THEN spot END) AS with_spot FROM scored GROUP BY 1""")
def union_of_days(spark, sf):
    from tickloom.sources.files import union_days
    s = scored(spark, sf).select("instrument", "date", "seq", "spot")
    days = union_days([s.filter("date >= '2024-01-15'"), s.filter("date < '2024-01-15'").drop("spot")])
    return days.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count("spot").alias("with_spot"))


@query("tickers_on_all_venues", """
SELECT user_id AS ticker FROM events WHERE event_type IN ('click', 'view') AND value > 60 GROUP BY 1 HAVING count(DISTINCT event_type) = 2""")
def tickers_on_all_venues(spark, sf):
    v = ticks(spark, sf).filter("px > 60").select(F.col("user_id").alias("ticker"),
                                                  F.col("instrument").alias("venue"))
    return audit.tickers_across(v, ["click", "view"])


@query("concatenated_levels", f"""WITH {TICKS}
SELECT ts - ts % {HOUR} AS t, arg_max(px, (user_id, seq)) AS level FROM ticks GROUP BY 1""")
def concatenated_levels(spark, sf):
    from tickloom.operators.grid import dedupe_last
    t = ticks(spark, sf).withColumn("t", F.col("ts") - F.pmod("ts", F.lit(HOUR)))
    return dedupe_last(t, by=[], ts="t", order=["user_id", "seq"]).select("t", F.col("px").alias("level"))


@query("aligned_sampler_grid", f"""WITH {TICKS}, mk AS (SELECT instrument AS ticker, min(ts) AS s, max(ts) AS e FROM ticks GROUP BY 1),
g AS (SELECT ticker, e, unnest(range(CAST(ceil(s / {15 * MINUTE}) AS BIGINT) * {15 * MINUTE}, e + 1, {15 * MINUTE})) AS ts FROM mk),
a AS (SELECT g.*, t.px AS y FROM g ASOF JOIN ticks t ON t.instrument = g.ticker AND g.ts >= t.ts),
b AS (SELECT a.*, p.px AS perp_bid, a.ts - p.ts AS perp_age FROM a ASOF LEFT JOIN (SELECT * FROM ticks WHERE instrument = 'view') p ON a.ts >= p.ts)
SELECT b.ticker, b.ts, b.e - b.ts AS tte, b.y AS ybid, perp_bid, perp_age, c.px + 1 AS cb_ask FROM b
ASOF LEFT JOIN (SELECT * FROM ticks WHERE instrument = 'purchase') c ON b.ts >= c.ts""")
def aligned_sampler_grid(spark, sf):
    t = ticks(spark, sf)
    markets = t.groupBy(F.col("instrument").alias("ticker")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("expiry"))
    target = t.select(F.col("instrument").alias("ticker"), "ts", "seq", F.col("px").alias("ybid"),
                      (F.col("px") + 1).alias("yask"))
    src = lambda k: t.filter(F.col("instrument") == k).select(
        "ts", "seq", F.col("px").alias("bid"), (F.col("px") + 1).alias("ask"))
    out = G.aligned_grid(markets, target, {"perp": src("view"), "cb": src("purchase")},
                         step=15 * MINUTE, chunk=6 * HOUR)
    return out.select("ticker", "ts", "tte", "ybid", "perp_bid", "perp_age", "cb_ask")


@query("backfill_pages", """
SELECT 'K' || o_orderkey AS ticker, epoch_us(o_orderdate) // 1000000 - 900 AS open_ts, epoch_us(o_orderdate) // 1000000 AS close_ts,
  o_totalprice AS strike, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS result FROM orders WHERE o_orderstatus <> 'P'""")
def backfill_pages(spark, sf):
    o = table(spark, sf, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("")
    item = S('{"ticker":"K%d","close_time":"%s","floor_strike":%s,"result":"%s"}', "o_orderkey",
             F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("o_totalprice").cast("string"), result)
    # one page of markets per customer
    pages = o.groupBy("o_custkey").agg(F.concat_ws(",", F.collect_list(item)).alias("m")).select(
        S('{"cursor":"x","markets":[%s]}', "m").alias("raw"))
    return feeds.market_pages(pages).select("ticker", "open_ts", "close_ts", "strike", "result")


@query("backfill_trades_and_candles", f"""WITH {TICKS}, g AS (SELECT user_id, ts // 1000000 AS t, px, seq, k FROM ticks)
SELECT 'trade' AS kind, count(*) AS n, CAST(sum(t) AS BIGINT) AS t, round(sum(px), 4) AS px FROM g
UNION ALL SELECT 'candle', count(*), CAST(sum(t) AS BIGINT), CAST(sum(k) AS DOUBLE) FROM g""")
def backfill_trades_and_candles(spark, sf):
    t = ticks(spark, sf)
    iso = F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    trade = S('{"yes_price_dollars":"%s","created_time":"%s"}', F.col("px").cast("string"), iso)
    candle = S('[%d,"1","2","0","%d","9"]', F.expr("ts div 1000000") * 1000, "k")
    # a page holds the trades of one user
    pages = t.groupBy("user_id").agg(F.concat_ws(",", F.collect_list(trade)).alias("a"),
                                     F.concat_ws(",", F.collect_list(candle)).alias("b"))
    key = F.col("user_id").cast("string").alias("ticker")
    tr = feeds.trade_pages(pages.select(key, S('{"trades":[%s]}', "a").alias("raw")))
    ka = feeds.kline_pages(pages.select(key, S("[%s]", "b").alias("raw")))
    sums = lambda df, kind, v: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"),
                                      F.sum("t").alias("t"), F.round(F.sum(v), 4).alias("px"))
    return sums(tr, "trade", "px").unionByName(sums(ka, "candle", "spot"))


# ── training jobs ────────────────────────────────────────────────────────────

FULL = U.seeded_model(channels=1, hidden=32, rho=1.5)


def train_rows(spark, sf):
    return scored(spark, sf).drop("fair", "gap").withColumn("imb", F.pmod("seq", F.lit(21)) / 10.0 - 1)


@query("trained_surface")
def trained_surface(spark, sf):
    _, params, losses = U.train(train_rows(spark, sf), FULL, px=["spot"], second=SEC)
    return params.withColumn("first_loss", F.lit(losses[0])).withColumn("last_loss", F.lit(losses[-1])).select(
        "ticker", *r6("d_b", "d_rho", "first_loss", "last_loss"))


@query("joint_surface")
def joint_surface(spark, sf):
    _, params, losses = J.train(train_rows(spark, sf), FULL, px=["spot"], second=SEC)
    return params.withColumn("first_loss", F.lit(losses[0])).withColumn("last_loss", F.lit(losses[-1])).select(
        "ticker", *r6("d_b", "d_rho", "first_loss", "last_loss"))


@query("joint_venues")
def joint_venues(spark, sf):
    """Two price channels with offset and scale of their own, structured network, quote and settlement blended."""
    rows = train_rows(spark, sf).withColumn("cb", F.col("spot") + F.pmod("seq", F.lit(7)) / 10 - 0.3).withColumn(
        "target", J.blended(F.col("mid"), F.col("outc"), 0.2))
    start = replace(U.seeded_model(channels=2, hidden=32, rho=1.5), mode="structured")
    model, params, losses = J.train(rows, start, px=["spot", "cb"], second=SEC, target="target",
                                    descent=J.Descent(per_channel=True))
    return params.select("ticker", *[F.col(c)[i].alias(f"{c}_{v}") for c in ("d_b", "d_rho") for i, v in enumerate(["spot", "cb"])],
                         F.lit(model.rhos[0]).alias("rho_spot"), F.lit(model.rhos[1]).alias("rho_cb"),
                         F.lit(losses[-1]).alias("last_loss")).select(
        "ticker", *r6("d_b_spot", "d_b_cb", "d_rho_spot", "d_rho_cb", "rho_spot", "rho_cb", "last_loss"))


@query("finetuned_surface")
def finetuned_surface(spark, sf):
    rows = train_rows(spark, sf)
    _, tested, losses = J.finetune(rows, FULL, px=["spot"], second=SEC, fit_above=300.0, min_rows=1)
    return tested.withColumn("last_loss", F.lit(losses[-1] if losses else None).cast("double")).select(
        "ticker", "n", *r6("kl", "loss_model", "loss_market", "last_loss"))


@query("static_fit_sweep")
def static_fit_sweep(spark, sf):
    samples = U.fit_samples(scored(spark, sf), second=SEC)
    return U.fit_sweep(samples, ONE, [300, 600], px=["spot"], min_rows=20)


RESIDUAL = f"""WITH RECURSIVE {SCORED}, rows AS (SELECT ticker, ts, fair, outc, ln(fair / (1 - fair)) AS lo, (spot - 102) / 5 AS mom FROM scored),
ev AS (SELECT ticker, row_number() OVER (ORDER BY min(ts), ticker) AS i, count(*) OVER () AS n FROM rows GROUP BY ticker),
val AS (SELECT ticker FROM ev WHERE i > n - greatest(1, floor(n * 0.1::DOUBLE))),
fit AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY ticker) AS w FROM rows WHERE ticker NOT IN (SELECT ticker FROM val)),
mo AS (SELECT avg(mom) AS mu, stddev_pop(mom) + 1e-9 AS sd FROM fit),
z AS (SELECT lo, w, outc, greatest(-5, least(5, (mom - mu) / sd)) AS z FROM fit, mo),
newton AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, a + (hzz * g0 - hz * gz) / (h0 * hzz - hz * hz), b + (h0 * gz - hz * g0) / (h0 * hzz - hz * hz) FROM (
    SELECT i, a, b, sum(w * (outc - q)) AS g0, sum(w * z * (outc - q)) AS gz, sum(w * q * (1 - q)) AS h0,
      sum(w * z * q * (1 - q)) AS hz, sum(w * z * z * q * (1 - q)) AS hzz
    FROM (SELECT i, a, b, w, z, outc, 1 / (1 + exp(-(lo + a + b * z))) AS q FROM newton, z WHERE i < 20) GROUP BY i, a, b)),
ab AS (SELECT a, b, mu, sd FROM newton, mo WHERE i = 20)"""


def residual_rows(spark, sf):
    return scored(spark, sf).withColumn("logit", F.log(F.col("fair") / (1 - F.col("fair")))).withColumn(
        "mom", (F.col("spot") - 102) / 5)


@query("residual_momentum", RESIDUAL + """
SELECT round(a, 6) AS alpha, round(b, 6) AS beta, round(mu, 6) AS mom_mu, round(sd, 6) AS mom_sd FROM ab""")
def residual_momentum(spark, sf):
    return U.residual_fit(residual_rows(spark, sf)).select(*r6("alpha", "beta", "mom_mu", "mom_sd"))


@query("residual_losses", RESIDUAL + """,
adj AS (SELECT ticker, outc, fair, greatest(0.01::DOUBLE, least(0.99::DOUBLE, 1 / (1 + exp(-(
    ln(greatest(0.01::DOUBLE, least(0.99::DOUBLE, fair)) / (1 - greatest(0.01::DOUBLE, least(0.99::DOUBLE, fair))))
    + a + b * greatest(-5, least(5, (mom - mu) / sd))))))) AS fair_adj
  FROM rows JOIN val USING (ticker), ab)
SELECT ticker, count(*) AS n, round(avg(-ln(CASE WHEN outc = 1 THEN fair ELSE 1 - fair END)), 6) AS loss,
  round(avg(-ln(CASE WHEN outc = 1 THEN fair_adj ELSE 1 - fair_adj END)), 6) AS loss_adj FROM adj GROUP BY ticker""")
def residual_losses(spark, sf):
    """Outcome loss of the held-out events, with and without the momentum residual."""
    rows = residual_rows(spark, sf)
    split = U.split_events(rows.groupBy("ticker").agg(F.min("ts").alias("open_ts")), 0.1)
    late = rows.join(split.filter("split = 'val'").select("ticker"), "ticker", "left_semi")
    adj = U.residual_adjusted(late, U.residual_fit(rows))
    loss = lambda c: F.avg(stats.log_loss(F.col(c), F.col("outc"), 0.01))
    return adj.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), loss("fair").alias("loss"),
                                     loss("fair_adj").alias("loss_adj")).select("ticker", "n", *r6("loss", "loss_adj"))


@query("feature_ablation")
def feature_ablation(spark, sf):
    from tickloom.operators import training as TR
    return TR.ablate(train_rows(spark, sf), {"base": [], "imb": ["imb"]}, px=["spot"], second=SEC,
                     fit_above=300.0)


@query("online_rehearsal")
def online_rehearsal(spark, sf):
    from tickloom.operators import training as TR
    rows = scored(spark, sf).drop("fair", "gap")
    return TR.rehearse(rows, FULL, px=["spot"], second=SEC, fit_above=600.0, horizon=30 * SEC,
                       min_rows=15, chunk=DAY)


@query("lead_model")
def lead_model(spark, sf):
    from tickloom.operators import training as TR
    rows = scored(spark, sf).withColumn("d_b", F.lit(0.0)).withColumn("d_rho", F.lit(0.0))
    return TR.train_lead(rows, horizon=4 * SEC, slack=SEC // 4, chunk=DAY)


OTHER = U.seeded_model(channels=1, hidden=8, rho=1.5, seed=11)


def at_model(model, spot):
    """The network over column ``src.{spot}``, under the name its rows keep."""
    return surface_sql(model, [spot], "tte_s", "strike", "d_b", "d_rho", [])


@query("fair_replay_audit", f"""WITH {SCORED},
w AS (SELECT ticker, ts + 500 AS ts, tte_s, mid, strike, seq, spot + (seq % 5 - 2) / 50.0::DOUBLE AS px0, 0.001::DOUBLE AS d_b, 0.0::DOUBLE AS d_rho FROM scored),
q AS (SELECT ticker, ts AS at_ts, spot FROM scored),
j AS (SELECT w.*, q.spot, abs(q.at_ts - w.ts) <= {SEC} AS near FROM w ASOF JOIN q ON w.ticker = q.ticker AND w.ts + 1000 >= q.at_ts),
src AS (SELECT * FROM j WHERE near),
l AS ({at_model(OTHER, "px0")}), a AS ({at_model(ONE, "px0")}), b AS ({at_model(ONE, "spot")}),
e AS (SELECT 'A' AS "check", abs(a.p - l.p) AS e FROM a JOIN l USING (seq) UNION ALL SELECT 'B', abs(b.p - l.p) FROM b JOIN l USING (seq))
SELECT "check", count(*) AS n, round(max(e), 6) AS max, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90
FROM e GROUP BY 1""")
def fair_replay_audit(spark, sf):
    """The log was written by another model, from prices slightly off the sampler's."""
    from tickloom.operators import training as TR
    rows = scored(spark, sf).drop("fair", "gap").withColumn("d_b", F.lit(0.001)).withColumn("d_rho", F.lit(0.0)).withColumn(
        "px0", F.col("spot") + (F.pmod("seq", F.lit(5)) - 2) / 50)
    logged = U.score(rows, OTHER, px=["px0"]).select(
        "ticker", (F.col("ts") + 500).alias("ts"), "tte_s", "px0", "fair", "d_b", "d_rho")
    return TR.audit_fair(logged, rows.select("ticker", "ts", "spot", "strike"), ONE, px=["spot"],
                         tol=SEC, lead=1000, chunk=DAY).select("check", "n", *r6("max", "median", "p90"))


@query("calibration_replay_audit")
def calibration_replay_audit(spark, sf):
    """Check C: parameters logged by another model against the refit of this one."""
    from tickloom.operators import training as TR
    samples = U.fit_samples(scored(spark, sf), second=SEC)
    fits = dict(px=["spot"], tte_max=300, step=100, window=240.0, min_rows=10)
    logged = U.calibrate(samples, OTHER, **fits).select("ticker", "boundary", "d_b", "d_rho")
    return TR.audit_calibration(logged, samples, ONE, **fits).select("ticker", "boundary", *r6("diff_b", "diff_rho"))


# ── streams over the given files ─────────────────────────────────────────────

def tick_stream(spark, sf):
    given = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(given).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    return raw.select(
        F.col("event_type").alias("instrument"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("px"), "user_id",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))


def streamed(spark, df, label):
    out = fresh_path(spark, label)
    ST.run_to_table(df, f"{out}/table", f"{out}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{out}/table")


LATE = 400  # days that files may be out of order


def drained(spark, rows, late, build, label, sf):
    """``build(rows)`` over all files, and over closing rows behind the last, so that nothing still waits."""
    rocks(spark)
    out = fresh_path(spark, label)
    last = ticks(spark, sf).groupBy("user_id").agg((F.max("ts") + 3 * late * DAY).alias("ts"), F.max("seq").alias("seq"))
    ends = last.select(*[F.col(f.name) if f.name in last.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in rows.schema])
    ends.limit(0).write.parquet(f"{out}/ends")
    df = build(rows.union(spark.readStream.schema(ends.schema).parquet(f"{out}/ends")))
    ST.run_to_table(df, f"{out}/table", f"{out}/checkpoint")
    ends.write.mode("append").parquet(f"{out}/ends")
    ST.run_to_table(df, f"{out}/table", f"{out}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{out}/table")


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("stream_throttle", f"""WITH RECURSIVE {TICKS}, r AS (SELECT user_id, ts, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM ticks),
w AS (SELECT user_id, n, seq, ts, ts AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.seq, r.ts, CASE WHEN r.ts - w.kept >= {8 * HOUR} THEN r.ts ELSE w.kept END FROM w JOIN r
  ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, ts, seq FROM w WHERE ts = kept""")
def stream_throttle(spark, sf):
    rows = tick_stream(spark, sf).select("user_id", "ts", "seq")
    return drained(spark, rows, LATE, lambda both: ST.throttled(
        both, "user_id", 8 * HOUR, rows.schema, at=F.timestamp_micros("ts"), late=f"{LATE} days"), "throttle", sf)


@query("stream_late_volume", f"""WITH {TICKS}
SELECT instrument, ts - ts % {HOUR} AS start, round(sum(px), 6) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2""")
def stream_late_volume(spark, sf):
    rows = tick_stream(spark, sf).select("instrument", "user_id", "ts", "seq", F.col("px").alias("qty"))
    out = drained(spark, rows, LATE, lambda both: ST.late_volume(
        both.withColumn("exch_at", F.timestamp_micros("ts")), late=f"{LATE} days", every="1 hour"), "volume", sf)
    return out.select("instrument", F.unix_micros("start").alias("start"), *r6("volume"), "n")


@query("stream_trade_dedupe", f"""WITH {TICKS}
SELECT instrument, seq AS trade_id, px FROM ticks""")
def stream_trade_dedupe(spark, sf):
    """Every trade is polled twice, a minute apart."""
    rows = tick_stream(spark, sf).select(
        "instrument", F.col("seq").alias("trade_id"), "px", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("poll"))
    polls = rows.withColumn("at", F.timestamp_micros(F.col("ts") + F.col("poll") * MINUTE))
    out = ST.dedupe_trades(polls, late=f"{LATE} days").select("instrument", "trade_id", "px")
    return streamed(spark, out, "trades")


@query("stream_fill_dedupe", f"""WITH {TICKS}
SELECT 'v' || seq AS venue_trade_id, unnest(['Matched', 'Confirmed']) AS status FROM ticks""")
def stream_fill_dedupe(spark, sf):
    """Every status of a fill is reported twice."""
    rows = tick_stream(spark, sf).select(
        F.concat(F.lit("v"), "seq").alias("venue_trade_id"), F.timestamp_micros("ts").alias("at"),
        F.explode(F.array(*map(F.lit, ["Matched", "Confirmed", "Matched", "Confirmed"]))).alias("status"))
    return streamed(spark, ST.dedupe_fills(rows, late=f"{LATE} days").select("venue_trade_id", "status"), "fills")


@query("stream_latest_state", f"""WITH {TICKS}
SELECT instrument, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(px, (ts, seq)) FILTER (k % 3 = 0) AS bid,
  arg_max(px, (ts, seq)) FILTER (k % 3 <> 0) AS ask
FROM ticks GROUP BY 1""")
def stream_latest_state(spark, sf):
    rocks(spark)
    rows = tick_stream(spark, sf).select("instrument", "ts", "seq", F.when(F.col("k") % 3 == 0, F.col("px")).alias("bid"),
                                         F.when(F.col("k") % 3 != 0, F.col("px")).alias("ask"))
    out = ST.keyed(rows, "instrument", ST.Latest(["bid", "ask"], "instrument"),
                   "instrument STRING, version LONG, ts LONG, seq LONG, bid DOUBLE, ask DOUBLE")
    return ST.current(streamed(spark, out, "latest"), "instrument")
