"""Joint training against finite differences and plain NumPy loops."""

from dataclasses import replace

import numpy as np
import pytest

from tickloom.operators import joint as J
from tickloom.operators import surface as U

SEC = 1_000_000
DDL = "ticker STRING, ts LONG, tte_s DOUBLE, spot DOUBLE, cb DOUBLE, strike DOUBLE, mid DOUBLE, outc INT, x DOUBLE"


def rows(events=6, seconds=40, seed=3):
    """Quotes of a known surface: each event is shifted by an offset of its own."""
    rng, out = np.random.default_rng(seed), []
    for e in range(events):
        for s in range(seconds):
            spot = 100 + rng.normal(0, 4)
            tte = 900.0 - 20 * s
            z = (spot - 101 - 3 * (e % 3 - 1)) / 5 / np.sqrt(max(tte, 1) / 900)
            out.append((f"e{e}", (e * 1000 + s) * SEC, tte, float(spot), float(spot + rng.normal(0, 1)), 101.0,
                        float(U.sigmoid(z)), e % 2, float(rng.normal())))
    return out


def arrays(data, px, extras):
    t = sorted(data, key=lambda r: (r[0], r[1]))
    names = ["ticker", "ts", "tte_s", "spot", "cb", "strike", "mid", "outc", "x"]
    col = lambda c: np.array([r[names.index(c)] for r in t])
    tickers, event = np.unique(col("ticker"), return_inverse=True)
    w = 1 / np.bincount(event)[event]
    ex = np.stack([col(c) for c in extras], axis=1) if extras else np.zeros((len(t), 0))
    return tickers, {"px": np.stack([col(c) for c in px], axis=1), "tte": col("tte_s"), "strike": col("strike"), "event": event,
                     "y": np.clip(col("mid"), 0.01, 0.99), "w": w, "extras": ex}


@pytest.mark.parametrize("mode", ["direct", "structured"])
@pytest.mark.parametrize("per_channel", [False, True])
def test_gradient_of_every_parameter_kind(mode, per_channel):
    model = replace(U.seeded_model(2, ["x"], hidden=5, rho=1.4), mode=mode)
    _, a = arrays(rows(3, 12), ["spot", "cb"], ["x"])
    rng = np.random.default_rng(1)
    shape = (3, 2 if per_channel else 1)
    d_b, d_rho = rng.normal(0, 0.02, shape), rng.normal(0, 0.1, shape)
    theta = J.flatten(model)

    def loss(theta, d_b, d_rho):
        m = J.unflatten(model, theta)
        b = np.broadcast_to(m.b_scale * d_b, (3, 2))[a["event"]] + a["strike"][:, None]
        # every channel moved so that the library's scoring needs no event parameters
        px = (a["px"] - b) / np.exp(np.broadcast_to(d_rho, (3, 2))[a["event"]])
        lo = U.forward(m, U.inputs(m, px, a["tte"], 0.0, 0.0, a["extras"]))
        return np.sum(a["w"] * (np.log1p(np.exp(lo)) - lo * a["y"]))

    got, net, scales, g_b, g_rho = J.slope(J.unflatten(model, theta), a["px"], a["tte"], a["strike"], a["event"], d_b, d_rho,
                                           a["y"], a["w"], a["extras"])
    assert got == pytest.approx(loss(theta, d_b, d_rho))

    def differences(x, of):
        out = np.zeros(x.size)
        for i in range(x.size):
            e = np.zeros(x.size)
            e[i] = 1e-5
            out[i] = (of(x + e.reshape(x.shape)) - of(x - e.reshape(x.shape))) / 2e-5
        return out

    assert np.r_[net, scales] == pytest.approx(differences(theta, lambda x: loss(x, d_b, d_rho)), abs=1e-5)
    assert g_b.ravel() == pytest.approx(differences(d_b, lambda x: loss(theta, x, d_rho)), abs=1e-4)
    assert g_rho.ravel() == pytest.approx(differences(d_rho, lambda x: loss(theta, d_b, x)), abs=1e-5)


def plain(model, shards, d, per_channel=False, px=("spot",), extras=()):
    """The same descent as one loop, written with one flat parameter vector per shard."""
    d = d.for_mode(model.mode)
    net = [J.flatten(model)] + [np.zeros_like(J.flatten(model))] * 2
    held, losses = {}, []
    for p in range(d.passes):
        after, total, weight = [], 0.0, 0.0
        for s, data in shards.items():
            tickers, a = arrays(data, px, extras)
            width = len(px) if per_channel else 1
            n_net, n_ev = len(net[0]), len(tickers) * width
            own = held.get(s, [np.zeros(2 * n_ev)] * 3)
            x, m, v = (np.r_[net[i], own[i]] for i in range(3))
            n = len(a["tte"])
            order = np.random.default_rng([d.seed, s, p]).permutation(n)
            steps = -(-n // d.batch)
            for i in range(steps):
                ix = order[i * d.batch:(i + 1) * d.batch]
                d_b, d_rho = x[n_net:n_net + n_ev].reshape(-1, width), x[n_net + n_ev:].reshape(-1, width)
                part = {c: a[c][ix] for c in a}
                loss, g, g_s, g_b, g_rho = J.slope(J.unflatten(model, x[:n_net]), part["px"], part["tte"], part["strike"],
                                                   part["event"], d_b, d_rho, part["y"], part["w"], part["extras"])
                total += loss
                k = len(px)
                # priors: derivative of the mean over batch rows of the squared parameters
                pull_b, pull_rho = np.zeros_like(d_b), np.zeros_like(d_rho)
                for e in part["event"]:
                    pull_b[e] += 2 * d.prior_b * d_b[e] / len(ix) / width
                    pull_rho[e] += 2 * d.prior_rho * d_rho[e] / len(ix) / width
                w = part["w"].sum()
                g = np.r_[g / w + d.decay * x[:n_net - k], g_s / w, (g_b / w + pull_b).ravel(), (g_rho / w + pull_rho).ravel()]
                t = p * steps + i + 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                rate = np.where(np.arange(len(x)) < n_net - k, d.rate, d.event_rate)
                x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            held[s] = [y[n_net:] for y in (x, m, v)]
            after.append((len(tickers), [y[:n_net] for y in (x, m, v)]))
            weight += len(tickers)
        net = [sum(c * y[i] for c, y in after) / sum(c for c, _ in after) for i in range(3)]
        losses.append(total / weight)
    return net[0], held, losses


@pytest.mark.parametrize("mode,per_channel,shard_rows", [("direct", False, 10_000), ("structured", True, 10_000),
                                                         ("direct", False, 80)])
def test_train_is_the_plain_loop(spark, frame, mode, per_channel, shard_rows):
    from pyspark.sql import functions as F
    data, px = rows(), ["spot", "cb"] if per_channel else ["spot"]
    model = replace(U.seeded_model(len(px), hidden=6, rho=1.5), mode=mode)
    d = J.Descent(passes=4, batch=50, rate=0.01, event_rate=0.02, per_channel=per_channel, shard_rows=shard_rows)
    n = max(1, -(-len(data) // shard_rows))
    df = frame(data, DDL)
    where = dict(df.select("ticker", F.pmod(F.xxhash64("ticker"), F.lit(n)).cast("int")).distinct().collect())
    shards = {}
    for r in data:
        shards.setdefault(where[r[0]], []).append(r)
    assert n == 1 or len(shards) > 1
    theta, held, losses = plain(model, shards, d, per_channel, px)
    got, params, got_losses = J.train(df, model, px=px, second=SEC, descent=d)
    assert J.flatten(got) == pytest.approx(theta, abs=1e-9)
    assert got_losses == pytest.approx(losses, abs=1e-9) and losses[-1] < losses[0]
    mine = {r.ticker: np.r_[r.d_b, r.d_rho] for r in params.collect()}
    for s, part in shards.items():
        tickers = sorted({r[0] for r in part})
        both = held[s][0].reshape(2, len(tickers), -1)
        for i, t in enumerate(tickers):
            assert mine[t] == pytest.approx(both[:, i].ravel(), abs=1e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("joint_")]


def test_offsets_of_events_are_found(frame):
    d = J.Descent(passes=30, batch=32, rate=0.01, event_rate=0.01)
    _, params, losses = J.train(frame(rows(), DDL), U.seeded_model(1, hidden=8, rho=1.6), px=["spot"], second=SEC,
                                descent=d)
    at = {r.ticker: 50 * r.d_b for r in params.collect()}
    assert at["e1"] - at["e0"] == pytest.approx(3, abs=1) and at["e2"] - at["e1"] == pytest.approx(3, abs=1)
    assert losses[-1] < losses[0]


def test_rows_without_values_and_empty_tables(frame):
    data = rows(2, 5)
    holes = data + [("e9", 1, None, 1.0, 1.0, 1.0, 0.5, 0, 0.0), (None, 1, 5.0, 1.0, 1.0, 1.0, 0.5, 0, 0.0)]
    model, d = U.seeded_model(1, hidden=3, rho=1.5), J.Descent(passes=2)
    one = J.train(frame(data, DDL), model, px=["spot"], second=SEC, descent=d)
    # the same rows twice are one row per second
    two = J.train(frame(holes + data, DDL), model, px=["spot"], second=SEC, descent=d)
    assert J.flatten(one[0]) == pytest.approx(J.flatten(two[0])) and {r.ticker for r in two[1].collect()} == {"e0", "e1"}
    none = J.train(frame([], DDL), model, px=["spot"], second=SEC, descent=d)
    assert J.flatten(none[0]) == pytest.approx(J.flatten(model)) and none[1].count() == 0 and none[2] == []


def test_aligned_prices_score_an_event_with_parameters_per_channel(frame):
    from pyspark.sql import functions as F
    model = U.seeded_model(2, hidden=4, rho=1.5)
    df = frame(rows(1, 6), DDL).withColumn("d_b", F.array(F.lit(0.02), F.lit(-0.01))).withColumn(
        "d_rho", F.array(F.lit(0.3), F.lit(-0.2)))
    moved = df.select("ts", "tte_s", "strike", *J.aligned_prices(["spot", "cb"], model), F.lit(0.0).alias("d_b"),
                      F.lit(0.0).alias("d_rho"))
    got = [r.fair for r in U.score(moved, model, px=["spot", "cb"]).orderBy("ts").collect()]
    _, a = arrays(rows(1, 6), ["spot", "cb"], [])
    lo = [U.forward(replace(model, rhos=(1.5 + 0.3, 1.5 - 0.2)),
                    U.inputs(replace(model, rhos=(1.8, 1.3)), (p - s - 50 * np.array([0.02, -0.01]))[None], t[None], 0.0, 0.0, None))[0]
          for p, s, t in zip(a["px"], a["strike"], a["tte"])]
    assert got == pytest.approx(list(U.sigmoid(np.array(lo))), abs=1e-9)


def test_finetune_starts_warm_and_measures_the_later_half(frame):
    data = rows(5, 44)
    model, _, _ = J.train(frame(data, DDL), U.seeded_model(1, hidden=6, rho=1.5), px=["spot"], second=SEC,
                          descent=J.Descent(passes=20, batch=32, rate=0.01, event_rate=0.01))
    tuned, tested, losses = J.finetune(frame(data, DDL), model, px=["spot"], second=SEC, fit_above=500.0, min_rows=5,
                                       event_steps=40)
    assert {r.ticker for r in tested.collect()} == {"e2", "e3", "e4"} and len(losses) == 8
    cold = J.train(frame([r for r in data if r[0] < "e2"], DDL), U.seeded_model(1, hidden=6, rho=1.5), px=["spot"], second=SEC,
                   descent=J.Descent(passes=1))[2]
    assert losses[0] < cold[0]
    # the network moves by at most its rate per step, the scale by four times that
    step = np.abs(J.flatten(tuned) - J.flatten(model))
    assert 0 < step[:-1].max() < 8 * 5e-4 * 1.5 and step[-1] < 8 * 2e-3 * 1.5


def test_a_pass_moves_neither_rows_nor_state(frame, monkeypatch):
    plans, write = [], J.bucketed

    def spy(df, n, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, n, label)

    monkeypatch.setattr(J, "bucketed", spy)
    J.train(frame(rows(), DDL), U.seeded_model(1, hidden=3, rho=1.5), px=["spot"], second=SEC,
            descent=J.Descent(passes=1, shard_rows=80))
    passes = [p for p in plans if "FlatMapCoGroups" in p]
    assert len(passes) == 1 and "Exchange" not in passes[0]
