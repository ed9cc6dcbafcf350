"""Registered training jobs against plain NumPy loops with the full steps and widths."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import SF
from tickloom.operators import surface as U
from tickloom.operators import training as TR
from tickloom.plans import signal_queries as Q
from tickloom.plans.roles import DAY, scored

MIDDLE = "/root/testdata/sf0.01"


def fitted(model, samples):
    return {t: U.fit(model, p[["spot"]].to_numpy(), p.tte_s.to_numpy(), p.mid.to_numpy(), p.strike.iloc[0], steps=150)
            for t, p in samples.sort_values("ts").groupby("ticker")}


def stepped(theta, slope, passes):
    m, v, losses = np.zeros_like(theta), np.zeros_like(theta), []
    for t in range(1, passes + 1):
        loss, g = slope(theta)
        losses.append(loss)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta, losses


@pytest.fixture
def one_instrument(monkeypatch):
    monkeypatch.setattr(Q, "scored", lambda *a: scored(*a).filter("instrument = 'click'"))


def test_trained_surface(spark, one_instrument):
    model, losses = U.seeded_model(1, hidden=32, rho=1.5), []
    p = U.fit_samples(Q.scored(spark, SF), second=Q.SEC).toPandas()
    w = 1 / p.groupby("ticker").ticker.transform("count").to_numpy()
    for _ in range(2):
        params = fitted(model, p)
        at = np.array([params[t] for t in p.ticker])
        x = U.inputs(model, p[["spot"]].to_numpy(), p.tte_s.to_numpy(), p.strike.to_numpy() + 50 * at[:, 0], at[:, 1], None)

        def slope(theta):
            loss, g = U.backprop(U.unflatten(model, theta), x, np.clip(p.mid.to_numpy(), 0.01, 0.99), w)
            return loss / w.sum(), g / w.sum()

        theta, part = stepped(U.flatten(model), slope, 25)
        model, losses = U.unflatten(model, theta), losses + part
    got = contract.queries()["trained_surface"](spark, SF).collect()
    assert len(got) == len(params) and losses[-1] < losses[0]
    assert (got[0].first_loss, got[0].last_loss) == pytest.approx((losses[0], losses[-1]), abs=2e-3)
    # events of two or three rows let rounding grow over 150 steps, so not each one can be held to it
    assert np.median([np.abs(np.subtract((r.d_b, r.d_rho), params[r.ticker])).max() for r in got]) < 1e-2


def test_online_rehearsal(spark, one_instrument):
    model = U.seeded_model(1, hidden=32, rho=1.5)
    p = U.fit_samples(Q.scored(spark, MIDDLE), second=Q.SEC).toPandas()
    early, late = p[p.tte_s > 600], p[p.tte_s <= 600]
    early = early[early.groupby("ticker").ticker.transform("count") >= 15]
    params = fitted(model, early)
    brier = [np.mean((U.sigmoid(U.logits(model, q[["spot"]].to_numpy(), q.tte_s.to_numpy(), 101.0, *params[t])) - q.outc) ** 2)
             for t, q in late.groupby("ticker") if t in params]
    got = contract.queries()["online_rehearsal"](spark, MIDDLE).first()
    assert got.events == len(brier) > 0
    assert got.brier_model == pytest.approx(np.mean(brier), abs=1e-3)


def test_lead_model_learns_from_earlier_events_only(spark):
    rows = scored(spark, SF)
    opened = rows.groupBy("ticker").agg(F.min("ts").alias("ts")).toPandas().sort_values(["ts", "ticker"]).ticker.tolist()
    later = set(opened[len(opened) - len(opened) // 2:])
    p = U.lead_rows(rows, 4 * Q.SEC, slack=Q.SEC // 4, chunk=DAY).toPandas()
    tau = np.clip(p.tte_s / 900, 1e-4, 1)
    x = np.stack([(p.spot - p.strike) / np.exp(1.5) / np.sqrt(tau), np.log(tau), p.base / 4], axis=1)
    base, y = p.base.to_numpy(), np.clip(p.mid_next.to_numpy(), 0.01, 0.99)
    test = p.ticker.isin(later).to_numpy()
    start = replace(U.seeded_model(2, hidden=32, seed=3), rhos=(0.0, 0.0))

    def slope(theta):
        net, a = U.unflatten(start, theta), x[~test]
        raw = U.forward(net, a)
        t = np.tanh(raw / 1.5)
        err = (U.sigmoid(base[~test] + 1.5 * t) - y[~test]) * (1 - t * t)
        return 0.0, U.backprop(net, a, U.sigmoid(raw) - err, np.ones(len(a)))[1] / len(a)

    theta, _ = stepped(U.flatten(start) * 0.3, slope, 60)
    prob = U.sigmoid(base + 1.5 * np.tanh(U.forward(U.unflatten(start, theta), x) / 1.5))
    quote = U.sigmoid(base)
    got = {r.split: r for r in contract.queries()["lead_model"](spark, SF).collect()}
    for name, own in (("train", ~test), ("val", test)):
        gap, move, q = (prob - quote)[own], (y - quote)[own], np.clip(prob[own], 0.01, 0.99)
        big = np.abs(gap) > 0.05
        assert (got[name].n, got[name].n_big) == (own.sum(), pytest.approx(big.sum(), abs=2))
        assert got[name].loss_model == pytest.approx(np.mean(-y[own] * np.log(q) - (1 - y[own]) * np.log(1 - q)), abs=1e-4)
        assert got[name].slope == pytest.approx(np.polyfit(gap, move, 1)[0], abs=1e-2)


def test_ablation_takes_full_steps(spark, monkeypatch):
    seen = []

    def train(rows, start, **kw):
        seen.append((start.layers[0][1].shape[0], kw["rounds"], kw["steps"], kw["event_steps"]))
        return start, None, []

    monkeypatch.setattr(TR.U, "train", train)
    contract.queries()["feature_ablation"](spark, SF)
    assert seen == [(32, 2, 25, 150)] * 2


def test_batches_hold_every_row_once(spark):
    table = spark.range(1000).withColumn("x", F.col("id") % 7)
    parts = U.in_batches(table, 100, "dealt")
    assert len(parts) == 10 and all(b.columns == table.columns for b in parts)
    assert sorted(r.id for b in parts for r in b.collect()) == list(range(1000))
    theta, losses = U.adam(np.zeros(1), [1.0, 3.0], lambda b, th: (b, 1.0, np.ones(1)), 5, 0.01)
    assert losses == [2.0] * 5 and theta[0] == pytest.approx(-0.1)


def test_descent_in_shards(spark, monkeypatch):
    """One job per pass; one shard takes the steps of ``adam``, several are averaged by their rows."""
    table = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") / 50).alias("y"))

    def slope(theta, a):
        miss = theta[0] + theta[1] * a[:, 0] - a[:, 1]
        return float(np.sum(miss ** 2)), np.array([np.sum(miss), np.sum(miss * a[:, 0])])

    def per_batch(batch, theta):
        loss, g = slope(theta, batch)
        return loss / len(batch), len(batch), g / len(batch)

    batches = [b.toPandas().to_numpy() for b in U.in_batches(table, 100, "dealt")]
    jobs = []
    plain = type(table).toPandas
    monkeypatch.setattr(type(table), "toPandas", lambda df: jobs.append(df) or plain(df))
    one = U.packed_shards(table, 100, "packed")
    assert sorted(one.first().sizes) == sorted(len(b) for b in batches) and one.count() == 1
    theta, losses = U.descend(one, np.zeros(2), slope, 2, 6, 0.05)
    assert len(jobs) == 6
    expect, means = U.adam(np.zeros(2), batches, per_batch, 6, 0.05)
    assert theta == pytest.approx(expect, rel=1e-9) and losses == pytest.approx(means, rel=1e-9)

    monkeypatch.setattr(U, "SHARD_BATCHES", 3)
    shards = U.packed_shards(table, 100, "packed")
    theta, losses = U.descend(shards, np.zeros(2), slope, 2, 60, 0.2)
    rows = np.concatenate([np.frombuffer(r.data).reshape(-1, 2) for r in shards.collect()])
    assert shards.count() == 4 and sorted(map(tuple, rows)) == sorted(map(tuple, table.collect()))
    assert sum(r.share for r in shards.collect()) == pytest.approx(1)
    assert losses[-1] < losses[0] / 3 and theta[0] == pytest.approx(10, abs=2)

    nothing = U.packed_shards(table.filter("x < 0"), 100, "packed")
    assert U.descend(nothing, np.ones(2), slope, 2, 2, 0.1)[0].tolist() == [1, 1]
