import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import surface as U
from tickloom.operators import training as TR

SECOND = 1_000_000


def events(spark, model, truth, n=400, strike=100.0, seed=1):
    """Rows whose mid is the surface under known event parameters."""
    rng = np.random.default_rng(seed)
    out = []
    for t, (db, dr) in truth.items():
        tte = np.linspace(890, 5, n)
        px = strike + np.cumsum(rng.normal(0, 0.4, n))
        p = U.sigmoid(U.logits(model, px[:, None], tte, strike, db, dr))
        out += [(t, int((900 - s) * SECOND), i, float(s), float(x), strike, float(m), 1)
                for i, (s, x, m) in enumerate(zip(tte, px, p))]
    return spark.createDataFrame(out, "ticker STRING, ts LONG, seq LONG, tte_s DOUBLE, spot DOUBLE, strike DOUBLE, mid DOUBLE, outc INT")


def test_scoring_forms_agree(spark):
    m = U.seeded_model(2, ("x",), hidden=32, rho=2.0)
    rng = np.random.default_rng(2)
    data = [tuple(map(float, (100 + rng.normal(), 100 + rng.normal(), rng.uniform(1, 900), 100, rng.normal() / 50,
                              rng.normal() / 5, rng.normal() * 4))) for _ in range(50)] + [(None, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "a DOUBLE, c DOUBLE, tte_s DOUBLE, strike DOUBLE, d_b DOUBLE, d_rho DOUBLE, x DOUBLE")
    c = F.col
    lo = U.logit_column(m, px=[c("a"), c("c")], tte=c("tte_s"), strike=c("strike"), d_b=c("d_b"), d_rho=c("d_rho"), extras=[c("x")])
    rows = U.score(df, m, px=["a", "c"]).withColumn("lo", lo).collect()
    for r, d in zip(rows, data):
        if d[0] is None:
            assert r.fair is None
            continue
        a = np.array([d])
        want = U.logits(m, a[:, :2], a[:, 2], a[:, 3], a[:, 4], a[:, 5], a[:, 6:])[0]
        assert abs(r.lo - want) < 1e-9 and abs(r.fair - U.sigmoid(want)) < 1e-9


def test_structured_mode_keeps_sign():
    from dataclasses import replace
    m = replace(U.seeded_model(1, hidden=8), mode="structured")
    x = np.array([[1.0, -0.5], [-1.0, -0.5]])
    out = U.forward(m, x)
    assert out[0] > 0 > out[1]


def test_fit_recovers_known_parameters(spark):
    # a surface that does not saturate: on a saturated one the fixed-step fit can stop in a
    # local minimum, as it does by design
    m = U.seeded_model(1, hidden=16, rho=2.0, scale=0.8)
    truth = {"A": (0.05, 0.2), "B": (-0.08, -0.15)}
    rows = events(spark, m, truth)
    calib = U.calibrate(U.fit_samples(rows, second=SECOND), m, px=["spot"], tte_max=300, step=60, window=0)
    last = {r.ticker: r for r in calib.filter("boundary = 60").collect()}
    assert calib.count() == 10
    series = U.fair_series(rows, m, px=["spot"], second=SECOND, calib=calib)
    assert series.agg(F.avg(F.abs("gap"))).collect()[0][0] < 0.01
    for t, (db, dr) in truth.items():
        cols = _cols(rows.filter("tte_s > 60"), t)
        assert last[t].bce <= U.fit_loss(m, *cols, db, dr) + 1e-3 < U.fit_loss(m, *cols, 0.0, 0.0)


def _cols(rows, ticker):
    p = rows.filter(F.col("ticker") == ticker).toPandas()
    return p[["spot"]].to_numpy(), p.tte_s.to_numpy(), p.mid.to_numpy(), 100.0


def test_short_boundaries_skip_or_wait(spark):
    m = U.seeded_model(1, hidden=4)
    rows = events(spark, m, {"A": (0.0, 0.0)}).filter("tte_s > 400 OR tte_s < 200")
    kw = dict(px=["spot"], tte_max=360, step=60, window=60.0, min_rows=20, first_steps=3, refit_steps=2)
    s = U.fit_samples(rows, second=SECOND)
    assert [r.boundary for r in U.calibrate(s, m, **kw).collect()] == [120.0, 60.0]
    assert U.calibrate(s, m, on_short="wait", **kw).count() == 0


def test_gradient_matches_finite_differences(spark):
    m = U.seeded_model(1, ("mom",), hidden=5)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, (100 + rng.normal(), rng.uniform(10, 800), 100, 0, 0, rng.uniform(0.1, 0.9),
                                                  rng.uniform(0.5, 2), rng.normal()))) for _ in range(60)],
                               "spot DOUBLE, tte_s DOUBLE, strike DOUBLE, d_b DOUBLE, d_rho DOUBLE, mid DOUBLE, weight DOUBLE, mom DOUBLE")
    _, g = U.gradient(df, m, px=["spot"])
    theta = U.flatten(m)
    for i in (0, 7, len(theta) // 2, len(theta) - 1):
        e = np.zeros_like(theta)
        e[i] = 1e-5
        hi, _ = U.gradient(df, U.unflatten(m, theta + e), px=["spot"])
        lo, _ = U.gradient(df, U.unflatten(m, theta - e), px=["spot"])
        assert g[i] == pytest.approx((hi - lo) / 2e-5, abs=1e-6)


def test_training_lowers_the_loss(spark):
    rows = events(spark, U.seeded_model(1, hidden=16, rho=2.0, scale=1.5, seed=1), {"A": (0.0, 0.0), "B": (0.02, 0.1)}, n=120)
    _, params, losses = U.train(rows, U.seeded_model(1, hidden=8, rho=2.0, seed=9), px=["spot"], rounds=1, steps=8,
                                second=SECOND, event_steps=10)
    assert losses[-1] < losses[0] and params.count() == 2


def test_demeaned_gap_matches_direct_recompute(spark):
    m = U.seeded_model(1, hidden=8, rho=2.0, scale=1.5)
    rows = events(spark, m, {"A": (0.03, 0.1)}, n=300).withColumn("mid", F.col("mid") + 0.02 * F.sin(F.col("seq")))
    calib = spark.createDataFrame([("A", float(b), 0.001 * b, 0.0) for b in (300, 200, 100)],
                                  "ticker STRING, boundary DOUBLE, d_b DOUBLE, d_rho DOUBLE")
    series = U.fair_series(rows, m, px=["spot"], second=SECOND, step=100, calib=calib)
    out = U.demean(series, m, px=["spot"], second=SECOND, window=120, step=100, history=rows)
    p = rows.toPandas()
    for r in out.collect():
        near = p[(p.tte_s >= r.tte_s) & (p.tte_s <= r.tte_s + 120) & (p.tte_s <= r.boundary + 120)]
        fair = U.sigmoid(U.logits(m, near[["spot"]].to_numpy(), near.tte_s.to_numpy(), 100.0, r.d_b, r.d_rho))
        assert r.gbar == pytest.approx((fair - near.mid).mean(), abs=1e-9)


def test_audit_of_exact_log_is_clean(spark):
    m = U.seeded_model(1, hidden=8, rho=2.0)
    rows = events(spark, m, {"A": (0.0, 0.0)}, n=100).withColumn("d_b", F.lit(0.0)).withColumn("d_rho", F.lit(0.0))
    logged = U.score(rows, m, px=["spot"]).select("ticker", "ts", "tte_s", F.col("spot").alias("px0"), "fair", "d_b", "d_rho")
    out = TR.audit_fair(logged, rows.select("ticker", "ts", "spot", "strike"), m, px=["spot"], tol=1500, lead=1, chunk=10**8)
    assert all(r["max"] < 1e-9 and r.n == 100 for r in out.collect())
    calib = U.calibrate(U.fit_samples(rows, second=SECOND), m, px=["spot"], window=0, first_steps=5,
                        refit_steps=3)
    diff = TR.audit_calibration(calib, U.fit_samples(rows, second=SECOND), m, px=["spot"], tte_max=300, step=60,
                                window=0, first_steps=5, refit_steps=3)
    assert diff.agg(F.max(F.abs("diff_b"))).collect()[0][0] == 0


def test_residual_momentum_recovers_slope(spark):
    rng = np.random.default_rng(3)
    base, mom = rng.normal(size=4000), rng.normal(size=4000)
    y = rng.random(4000) < U.sigmoid(base + 0.2 + 0.7 * mom)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(base, mom, y)], "logit DOUBLE, mom DOUBLE, outc INT")
    r = U.residual_momentum(df).collect()[0]
    assert r.beta == pytest.approx(0.7, abs=0.15) and r.alpha == pytest.approx(0.2, abs=0.12)


def test_feature_grammar():
    kinds = {n: X.parse(n).kind for n in ("imb1", "imb1avg10", "imb20", "dbasis60", "band5", "pcbmom1", "pmom15", "mom180", "vsurge", "basis")}
    assert kinds == {"imb1": "imb1", "imb1avg10": "imb1avg", "imb20": "imb", "dbasis60": "dbasis", "band5": "band",
                     "pcbmom1": "pcbmom", "pmom15": "pmom", "mom180": "mom", "vsurge": "vsurge", "basis": "basis"}
    assert X.parse("vsurge").args == (60, 600) and X.parse("vsurge120_1200").args == (120, 1200)
    with pytest.raises(ValueError):
        X.parse("surprise5")


def test_identity_is_of_the_numbers():
    from dataclasses import replace

    a, b = U.seeded_model(2, hidden=4), U.seeded_model(2, hidden=4)
    assert U.identity(a) == U.identity(b) != U.identity(replace(a, b_scale=51.0))
    assert U.identity(replace(a, digest="d")) == "d"


def test_residual_takes_training_events_equally_and_holds_momentum(spark):
    rng, data = np.random.default_rng(5), []
    for e in range(20):
        for i in range(60 if e % 2 else 20):
            mom = 400.0 if i == 0 and e == 0 else float(rng.normal())
            data.append((f"e{e:02d}", e * 1000 + i, float(rng.normal()), mom, e % 2))
    df = spark.createDataFrame(data + [("e00", 1, None, 1.0, 1), ("e01", 2, 0.0, None, 0)],
                               "ticker STRING, ts LONG, logit DOUBLE, mom DOUBLE, outc INT")
    got = U.residual_fit(df).collect()[0]
    train = [r for r in data if r[0] < "e18"]
    mom = np.array([r[3] for r in train])
    assert (got.mom_mu, got.mom_sd) == pytest.approx((mom.mean(), mom.std() + 1e-9))
    z, y, lo = np.clip((mom - mom.mean()) / mom.std(), -5, 5), np.array([r[4] for r in train]), np.array([r[2] for r in train])
    w = np.array([1 / sum(s[0] == r[0] for s in train) for r in train])
    miss = w * (y - U.sigmoid(lo + got.alpha + got.beta * z))
    assert abs(miss.sum()) < 1e-6 and abs((miss * z).sum()) < 1e-6 and z.max() == 5
    rows = spark.createDataFrame([("a", 0.5, 1e9), ("b", 0.5, None)], "ticker STRING, fair DOUBLE, mom DOUBLE")
    adj = {r.ticker: r.fair_adj for r in U.residual_adjusted(rows, U.residual_fit(df)).collect()}
    want = U.sigmoid(got.alpha + 5 * got.beta)
    assert adj == {"a": pytest.approx(min(max(want, 0.01), 0.99)), "b": None}


def test_samples_of_one_instant_have_a_fixed_winner(spark):
    data = [("a", 5, 2.0), ("a", 5, 1.0), ("a", 7, 0.5), ("a", 1_000_001, 9.0), ("b", 3, None), ("b", 3, 4.0)]
    for part in (data, data[::-1]):
        df = spark.createDataFrame(part, "ticker STRING, ts LONG, mid DOUBLE").repartition(4)
        got = {tuple(r) for r in U.fit_samples(df, second=SECOND).collect()}
        assert got == {("a", 5, 1.0), ("a", 1_000_001, 9.0), ("b", 3, None)}


def test_calibration_audit_compares_two_models(spark):
    one, other = U.seeded_model(1, hidden=4, rho=1.5), U.seeded_model(1, hidden=4, rho=1.5, seed=11)
    rng = np.random.default_rng(2)
    data = [("a", (900 - t) * SECOND, float(t), 100 + float(rng.normal()), 100.0, 0.4) for t in range(61, 181, 3)]
    df = spark.createDataFrame(data, "ticker STRING, ts LONG, tte_s DOUBLE, spot DOUBLE, strike DOUBLE, mid DOUBLE")
    fits = dict(px=["spot"], tte_max=60, step=60, window=120.0, min_rows=10, first_steps=20)
    logged = U.calibrate(df, other, **fits)
    got = TR.audit_calibration(logged, df, one, **fits).collect()
    p = sorted(data, key=lambda r: r[1])
    px, tte, mid = np.array([[r[3]] for r in p]), np.array([r[2] for r in p]), np.array([r[5] for r in p])
    want = np.subtract(U.fit(other, px, tte, mid, 100.0, steps=20), U.fit(one, px, tte, mid, 100.0, steps=20))
    assert [(r.ticker, r.boundary) for r in got] == [("a", 60.0)] and np.abs(want).max() > 0
    assert (got[0].diff_b, got[0].diff_rho) == pytest.approx(tuple(want), abs=1e-9)
