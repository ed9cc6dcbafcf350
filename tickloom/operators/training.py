"""Model studies built on the surface: ablation, fine-tuning, rehearsal, lead model, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import prices as P
from tickloom.operators import audit
from tickloom.operators import stats as S
from tickloom.operators import surface as U
from tickloom.operators.asof import asof_join
from tickloom.operators.chunks import attach_row
from tickloom.operators.study import gap_slope
from tickloom.session import materialize


def held_out(rows: DataFrame, model: U.Model, *, px: Sequence[str], second: int, fit_above: float,
             steps: int, min_rows: int = 30) -> DataFrame:
    """Per event: fit on early rows, score the rest; KL to the market and outcome losses."""
    samples = U.fit_samples(rows, second=second)
    calib = U.calibrate(samples.filter(F.col("tte_s") > fit_above), model, px=px, tte_max=1, step=1,
                        window=0, min_rows=1, first_steps=steps).select("ticker", "d_b", "d_rho")
    scored = U.score(samples.filter(F.col("tte_s") <= fit_above).join(calib, "ticker"), model, px=px)
    o = F.col("outc")
    return scored.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.kl_divergence(F.col("mid"), F.col("fair"))).alias("kl"),
        F.avg(S.log_loss(F.col("fair"), o, 0.01)).alias("loss_model"),
        F.avg(S.log_loss(F.col("mid"), o, 0.01)).alias("loss_market")).filter(F.col("n") >= min_rows)


def train_and_test(rows: DataFrame, start: U.Model, *, px: Sequence[str], second: int,
                   fit_above: float, frac: float = 0.1, rounds: int = 2, steps: int = U.EPOCHS,
                   event_steps: int = U.FIRST_STEPS, min_rows: int = 1) -> tuple[U.Model, DataFrame]:
    """Train on the earlier events, measure on the last ones. Fine-tuning starts from a trained model."""
    meta = rows.groupBy("ticker").agg(F.min("ts").alias("open_ts"))
    split = U.split_events(meta, frac).select("ticker", "split")
    marked = rows.join(split, "ticker")
    model, _, _ = U.train(marked.filter("split = 'train'"), start, px=px, rounds=rounds, steps=steps,
                          second=second, event_steps=event_steps)
    return model, held_out(marked.filter("split = 'val'"), model, px=px, second=second,
                           fit_above=fit_above, steps=event_steps, min_rows=min_rows)


def ablate(rows: DataFrame, sets: dict[str, Sequence[str]], *, px: Sequence[str], second: int,
           fit_above: float = 300.0, hidden: int = 32, steps: int = U.EPOCHS,
           event_steps: int = U.FIRST_STEPS, base: str = "base", frac: float = 0.1) -> DataFrame:
    """Held-out KL and outcome loss per feature set, with paired differences to the base set.

    Features are scaled by moments of the training events alone.
    """
    rows = materialize(rows, "ablation")
    split = U.split_events(rows.groupBy("ticker").agg(F.min("ts").alias("open_ts")), frac)
    training = rows.join(split.filter("split = 'train'").select("ticker"), "ticker", "left_semi")
    parts = None
    for name, extras in sets.items():
        part = rows
        if extras:
            mom = training.agg(*[f(c).alias(f"{c}{i}") for c in extras
                             for i, f in enumerate((F.avg, F.stddev_pop))]).first()
            mu = tuple(float(mom[f"{c}0"]) for c in extras)
            sd = tuple(float(mom[f"{c}1"]) + 1e-9 for c in extras)
        else:
            mu = sd = ()
        start = replace(U.seeded_model(len(px), extras, hidden, rho=1.5), mu=mu, sd=sd)
        _, events = train_and_test(part, start, px=px, second=second, fit_above=fit_above, frac=frac, steps=steps,
                                   event_steps=event_steps)
        events = events.withColumn("features", F.lit(name))
        parts = events if parts is None else parts.unionByName(events)
    parts = materialize(parts, "ablation")
    ref = parts.filter(F.col("features") == base).select(
        "ticker", F.col("kl").alias("_k0"), F.col("loss_model").alias("_l0"))
    both = parts.join(ref, "ticker")
    dk, dl = F.col("kl") - F.col("_k0"), F.col("loss_model") - F.col("_l0")
    return both.groupBy("features").agg(
        F.count(F.lit(1)).alias("events"), F.avg("kl").alias("kl"), F.avg(dk).alias("d_kl"),
        S.paired_t(dk).alias("t_kl"), F.avg("loss_model").alias("loss_model"),
        F.avg("loss_market").alias("loss_market"), S.paired_t(dl).alias("t_loss"))


def rehearse(rows: DataFrame, model: U.Model, *, px: Sequence[str], second: int, fit_above: float,
             horizon: int, min_rows: int, chunk: int, steps: int = 150) -> DataFrame:
    """Fit early, predict late: Brier against the outcome and slope of the market's move on the gap."""
    samples = U.fit_samples(rows, second=second)
    calib = U.calibrate(samples.filter(F.col("tte_s") > fit_above), model, px=px, tte_max=1, step=1,
                        window=0, min_rows=min_rows, first_steps=steps).select("ticker", "d_b", "d_rho")
    late = samples.filter(F.col("tte_s") <= fit_above).join(calib, "ticker")
    scored = materialize(U.score(late, model, px=px), "rehearsal")
    ahead = asof_join(scored, scored.select("ticker", "ts", "mid"), by=["ticker"],
                      at=F.col("ts") + horizon, direction="forward", take={"mid": "_next"}, chunk=chunk)
    ahead = ahead.withColumn("gap", F.col("fair") - F.col("mid")).withColumn(
        "move", F.col("_next") - F.col("mid")).filter(F.col("move").isNotNull())
    slope = gap_slope(ahead)
    brier = lambda c: F.pow(F.col(c) - F.col("outc"), 2)
    events = scored.groupBy("ticker").agg(F.avg(brier("fair")).alias("b"), F.avg(brier("mid")).alias("m"))
    out = events.agg(F.count(F.lit(1)).alias("events"), F.avg("b").alias("brier_model"),
                     F.avg("m").alias("brier_market"))
    return attach_row(out, slope)


LEAD_EPOCHS, LEAD_BATCH = 60, 8192  # passes over the training rows, and rows of one step


def train_lead(rows: DataFrame, *, horizon: int, slack: int, chunk: int, hidden: int = 32, steps: int = LEAD_EPOCHS,
               lr: float = 0.01, b_scale: float = 50.0, rho: float = 1.5, frac: float = 0.5) -> DataFrame:
    """Residual on the martingale: how far the quote will have moved, at most 1.5 logits.

    Trained on the earlier events, measured on them and on the last ``frac``. One row per split:
    loss of the quote itself, of the model, slope of the move on its gap, and the rows with a gap
    above 5 cents with their mean move in the gap's direction.
    """
    scale = F.exp(F.lit(rho) + F.col("d_rho"))
    z = P.z_prime(F.col("spot"), F.col("strike") + b_scale * F.col("d_b"), scale, F.col("tte_s"))
    split = U.split_events(rows.groupBy("ticker").agg(F.min("ts").alias("open_ts")), frac).select("ticker", "split")
    data = U.lead_rows(rows, horizon, slack=slack, chunk=chunk).join(split, "ticker").select(
        z.alias("c0"), F.log(P.tau(F.col("tte_s"))).alias("c1"), (F.col("base") / 4).alias("c2"),
        "base", S.clip(F.col("mid_next"), 0.01, 0.99).alias("y"), "split")
    data = materialize(data, "lead")
    numbers = ["c0", "c1", "c2", "base", "y"]
    model = replace(U.seeded_model(2, hidden=hidden, seed=3), rhos=(0.0, 0.0))

    def correction(net, x):
        return U.LEAD_CLAMP * np.tanh(U.forward(net, x) / U.LEAD_CLAMP)

    def slope(theta, a):
        net, x, base, y = U.unflatten(model, theta), a[:, :3], a[:, 3], a[:, 4]
        raw = U.forward(net, x)
        t = np.tanh(raw / U.LEAD_CLAMP)
        lo = base + U.LEAD_CLAMP * t
        loss = np.sum(np.maximum(lo, 0) - lo * y + np.log1p(np.exp(-np.abs(lo))))
        # chain rule: the loss slope in the logit, through the clamp, into the network
        slope = (U.sigmoid(lo) - y) * (1 - t * t)
        _, g = U.backprop(net, x, U.sigmoid(raw) - slope, np.ones(len(x)))
        return loss, g

    shards = U.packed_shards(data.filter("split = 'train'").select(*numbers), LEAD_BATCH, "lead")
    theta, _ = U.descend(shards, U.flatten(model) * 0.3, slope, len(numbers), steps, lr)
    shared = data.sparkSession.sparkContext.broadcast(U.unflatten(model, theta))

    def predict(batches):
        for pdf in batches:
            a = pdf[numbers].to_numpy(dtype=float)
            lo = a[:, 3] + correction(shared.value, a[:, :3])
            yield pd.DataFrame({"p": U.sigmoid(lo), "base": a[:, 3], "y": a[:, 4], "split": pdf["split"]})

    out = data.mapInPandas(predict, "p DOUBLE, base DOUBLE, y DOUBLE, split STRING")
    quote = P.sigmoid(F.col("base"))
    out = out.withColumn("gap", F.col("p") - quote).withColumn("move", F.col("y") - quote)
    big = F.abs("gap") > 0.05
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.cross_entropy(F.col("y"), quote, 0.01)).alias("loss_quote"),
        F.avg(S.cross_entropy(F.col("y"), F.col("p"), 0.01)).alias("loss_model"),
        F.regr_slope("move", "gap").alias("slope"), F.count(F.when(big, 1)).alias("n_big"),
        F.avg(F.when(big, F.signum("gap") * F.col("move"))).alias("capture"))


def audit_fair(logged: DataFrame, sampler: DataFrame, model: U.Model, *, px: Sequence[str], tol: int,
               lead: int, chunk: int) -> DataFrame:
    """Replay of logged fair values: A from the logged prices, B from the sampler's.

    Each record is paired with the sampler row at or before ``ts + lead``, not more than
    ``tol`` away; logged prices are columns ``px0..``.
    """
    cols = [c for c in sampler.columns if c not in ("ticker", "ts")]
    rows = asof_join(logged, sampler, by=["ticker"], at=F.col("ts") + lead, tol=tol + lead,
                     take={c: c for c in cols}, match_ts="_at", chunk=chunk)
    rows = rows.filter(F.abs(F.col("_at") - F.col("ts")) <= tol)
    a = U.score(rows, model, px=[f"px{i}" for i in range(len(px))], out="fair_a")
    both = U.score(a, model, px=px, out="fair_b")
    parts = None
    for name in ("a", "b"):
        err = both.withColumn("_e", F.col(f"fair_{name}") - F.col("fair"))
        part = audit.error_summary(err, "_e").withColumn("check", F.lit(name.upper()))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def audit_calibration(logged: DataFrame, samples: DataFrame, model: U.Model, *, px: Sequence[str],
                      tte_max: int, step: int, window: float = 120.0, **fit_args) -> DataFrame:
    """Check C: logged against refitted parameters per event and boundary."""
    again = U.calibrate(samples, model, px=px, tte_max=tte_max, step=step, window=window, **fit_args)
    return logged.join(again.select("ticker", "boundary", F.col("d_b").alias("_b"), F.col("d_rho").alias("_r")),
                       ["ticker", "boundary"]).select(
        "ticker", "boundary", (F.col("d_b") - F.col("_b")).alias("diff_b"),
        (F.col("d_rho") - F.col("_r")).alias("diff_rho"))
