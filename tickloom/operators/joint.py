"""Joint training of the surface: network, channel scales and event parameters in one descent.

Events are dealt into shards. A shard's task holds the rows of its events and takes one Adam step per
batch, on the network, the channel scales and the parameters of its own events. After a pass
over the rows the shards' networks (with their Adam moments) are averaged by the number of events; event
parameters and their moments belong to one shard each and are never averaged. A pass is one Spark job, whatever
the number of its steps. With one shard this is plain mini-batch Adam over all rows.

Rows and state are bucketed by shard, so a pass moves neither; the driver holds one vector of the network.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import prices as P
from tickloom.operators import surface as U
from tickloom.operators.stats import event_weight
from tickloom.session import fresh_path, materialize, remove_scratch

PRIOR_B, PRIOR_RHO, DECAY = 1e-4, 1e-3, 1e-5  # fixed values of structured mode; direct mode has none
RATE, TUNE_RATE, TUNE_EPOCHS, TUNE_BATCH = 2e-3, 5e-4, 8, 8192  # fixed values of training and fine-tuning
SHARD_ROWS = 16 * U.BATCH  # rows of a shard, on average
BUCKETS = 2048  # most files of a table; a task then takes several shards, one after another


@dataclass(frozen=True)
class Descent:
    """Rates, priors and batches of one training; priors and decay default by the model's mode."""
    passes: int = U.EPOCHS
    batch: int = U.BATCH
    rate: float = RATE
    event_rate: float = RATE
    prior_b: float | None = None
    prior_rho: float | None = None
    decay: float | None = None
    per_channel: bool = False
    shard_rows: int = SHARD_ROWS
    seed: int = 7

    def for_mode(self, mode: str) -> Descent:
        on = mode == "structured"
        pick = lambda given, fixed: given if given is not None else fixed * on
        return replace(self, prior_b=pick(self.prior_b, PRIOR_B), prior_rho=pick(self.prior_rho, PRIOR_RHO),
                       decay=pick(self.decay, DECAY))


def blended(mid: Column, outcome: Column, share: float) -> Column:
    """Training target between the quote (share 0) and the settlement (share 1)."""
    return (1 - share) * mid + share * outcome.cast("double")


def aligned_prices(px: Sequence[str], model: U.Model, *, strike: str = "strike", d_b: str = "d_b",
                   d_rho: str = "d_rho") -> list[Column]:
    """Prices that give, with zero event parameters, the inputs of an event with its own per channel.

    ``d_b`` and ``d_rho`` are arrays, one number per channel; score the result with ``surface.score``.
    """
    return [(F.col(strike) + (F.col(c) - F.col(strike) - model.b_scale * F.col(d_b)[i]) * F.exp(-F.col(d_rho)[i]))
            .alias(c) for i, c in enumerate(px)]


# ── gradient ─────────────────────────────────────────────────────────────────

def slope(model: U.Model, px, tte, strike, event, d_b, d_rho, y, w, extras=None):
    """Loss sum and its gradients by network weights, channel scales, event offsets and event scales.

    ``event`` numbers the rows of ``d_b`` and ``d_rho``, which have one column, or one per channel.
    """
    k, one = model.channels, d_b.shape[1] == 1
    tau = np.clip(tte / P.WINDOW_S, 1e-4, 1.0)
    scale = np.exp(np.asarray(model.rhos) + d_rho[event]) * np.sqrt(tau)[:, None]
    z = (px - strike[:, None] - model.b_scale * d_b[event]) / scale
    cols = [z, np.log(tau)[:, None]]
    if model.extras:
        cols.append(np.clip((extras - np.asarray(model.mu)) / np.asarray(model.sd), -5, 5))
    acts = [np.concatenate(cols, axis=1)]
    for i, (wt, b) in enumerate(model.layers):
        h = acts[-1] @ wt.T + b
        acts.append(np.tanh(h) if i < len(model.layers) - 1 else h)
    lo = raw = acts[-1][:, 0]
    bend = lean = None
    if model.mode == "structured":
        bend = np.tanh(raw / model.clamp)
        lean = np.exp(model.clamp * bend)
        lo = z[:, 0] * lean
    loss = float(np.sum(w * (np.maximum(lo, 0) - lo * y + np.log1p(np.exp(-np.abs(lo))))))
    miss = w * (U.sigmoid(lo) - y)
    delta = (miss if bend is None else miss * lo * (1 - bend * bend))[:, None]
    net = []
    for i in range(len(model.layers) - 1, -1, -1):
        net.append(np.r_[(delta.T @ acts[i]).ravel(), delta.sum(axis=0)])
        delta = delta @ model.layers[i][0]
        if i:
            delta = delta * (1 - acts[i] ** 2)
    by_z = delta[:, :k]
    if lean is not None:
        by_z = by_z + np.eye(k)[0] * (miss * lean)[:, None]
    by_b, by_rho = -model.b_scale * by_z / scale, -z * by_z
    scales = by_rho.sum(axis=0)
    if one:
        by_b, by_rho = by_b.sum(axis=1, keepdims=True), by_rho.sum(axis=1, keepdims=True)
    g_b, g_rho = np.zeros_like(d_b), np.zeros_like(d_rho)
    np.add.at(g_b, event, by_b)
    np.add.at(g_rho, event, by_rho)
    return loss, np.concatenate(net[::-1]), scales, g_b, g_rho


def flatten(model: U.Model) -> np.ndarray:
    """Network weights, then the channel scales."""
    return np.r_[U.flatten(model), model.rhos]


def unflatten(model: U.Model, theta: np.ndarray) -> U.Model:
    k = model.channels
    return replace(U.unflatten(model, theta[:-k]), rhos=tuple(float(r) for r in theta[-k:]))


def adam(x, g, m, v, t: int, rate):
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8), m, v


def one_pass(model: U.Model, net: np.ndarray, events: np.ndarray, rows: dict, d: Descent, order: np.ndarray, t: int):
    """One step per batch of rows. ``net`` holds weights and both moments, ``events`` the same per event.

    Returns both as the pass leaves them, and the loss sum over the rows, each taken before its step.
    """
    k = model.channels
    theta, m, v = net
    at, em, ev = events
    half = at.shape[1] // 2
    rate = np.r_[np.full(len(theta) - k, d.rate), np.full(k, d.event_rate)]
    total = 0.0
    for lo in range(0, len(order), d.batch):
        ix = order[lo:lo + d.batch]
        e, w = rows["event"][ix], rows["w"][ix]
        now = unflatten(model, theta)
        loss, g_net, g_scale, g_b, g_rho = slope(
            now, rows["px"][ix], rows["tte"][ix], rows["strike"][ix], e, at[:, :half], at[:, half:], rows["y"][ix], w,
            rows["extras"][ix])
        total += loss
        share = (np.bincount(e, minlength=len(at)) / (len(ix) * half))[:, None]
        g_net = np.r_[g_net / w.sum() + d.decay * theta[:-k], g_scale / w.sum()]
        g_ev = np.c_[g_b / w.sum() + 2 * d.prior_b * share * at[:, :half],
                     g_rho / w.sum() + 2 * d.prior_rho * share * at[:, half:]]
        t += 1
        theta, m, v = adam(theta, g_net, m, v, t, rate)
        at, em, ev = adam(at, g_ev, em, ev, t, d.event_rate)
    return np.stack([theta, m, v]), np.stack([at, em, ev]), total


def event_slopes(rows: DataFrame, model: U.Model, *, px: Sequence[str], target: str = "mid", weight: str = "weight",
                 by: str = "ticker") -> DataFrame:
    """Per event: loss sum and its derivatives by ``d_b`` and ``d_rho``, at the values the rows carry.

    Near zero everywhere at the end of a training; large where an event was not fitted. Partial sums per batch.
    """
    names, k = list(model.extras), len(px)
    use = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*px, "tte_s", "strike", "d_b", "d_rho", target, weight,
                                                                     *names])]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def partial(batches):
        for pdf in batches:
            pdf = pdf.dropna()
            if pdf.empty:
                continue
            a = pdf.drop(columns=by).to_numpy(dtype=float)
            # each row stands for itself, so its derivatives are those by its own parameters
            own = np.arange(len(a))
            y, w = np.clip(a[:, k + 4], U.MID_CLIP, 1 - U.MID_CLIP), a[:, k + 5]
            _, _, _, g_b, g_rho = slope(shared.value, a[:, :k], a[:, k], a[:, k + 1], own, a[:, k + 2:k + 3], a[:, k + 3:k + 4],
                                        y, w, a[:, k + 6:])
            lo = U.logits(shared.value, a[:, :k], a[:, k], a[:, k + 1], a[:, k + 2], a[:, k + 3], a[:, k + 6:])
            loss = w * (np.maximum(lo, 0) - lo * y + np.log1p(np.exp(-np.abs(lo))))
            yield pd.DataFrame({by: pdf[by], "loss": loss, "g_b": g_b[:, 0], "g_rho": g_rho[:, 0]}).groupby(
                by, as_index=False).sum()

    sums = rows.select(by, *use).mapInPandas(
        partial, f"`{by}` {rows.schema[by].dataType.simpleString()}, loss DOUBLE, g_b DOUBLE, g_rho DOUBLE")
    return sums.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("loss", "g_b", "g_rho")])


# ── over shards ──────────────────────────────────────────────────────────────

def bucketed(df: DataFrame, n: int, label: str) -> tuple[DataFrame, str, str]:
    """Written below the shared folder, bucketed by shard; with the names to drop it by."""
    path, name = fresh_path(df.sparkSession, label), f"{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, "shard").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name), name, path


def drop(spark: SparkSession, *tables) -> None:
    for _, name, path in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_scratch(spark, [path])


def shard_pass(model: U.Model, shared, nums: Sequence[str], d: Descent, p: int):
    """Pass ``p`` over one shard: rows and event state in, event state and one row with the network out."""
    k = model.channels

    def run(key, part, held):
        part = part.sort_values(["ticker", "ts"], ignore_index=True)
        held = held.sort_values("ticker", ignore_index=True)
        a = part[nums].to_numpy(dtype=float)
        event = np.searchsorted(held["ticker"].to_numpy(), part["ticker"].to_numpy())
        table = {"px": a[:, :k], "tte": a[:, k], "strike": a[:, k + 1], "extras": a[:, k + 3:], "event": event,
                 "y": np.clip(a[:, k + 2], U.MID_CLIP, 1 - U.MID_CLIP), "w": part["weight"].to_numpy()}
        own = np.stack([np.stack(held[c].to_list()) for c in ("at", "m", "v")])
        order = np.random.default_rng([d.seed, int(key[0]), p]).permutation(len(part))
        left, own, total = one_pass(model, shared.value, own, table, d, order, p * -(-len(part) // d.batch))
        out = held[["shard", "ticker"]].assign(at=list(own[0]), m=list(own[1]), v=list(own[2]), net=None, loss=None,
                                               weight=None)
        mean = pd.DataFrame({"shard": [key[0]], "ticker": None, "at": None, "m": None, "v": None,
                             "net": [left.ravel()], "loss": [total], "weight": [table["w"].sum()]})
        return pd.concat([out.astype(object), mean.astype(object)], ignore_index=True)

    return run


def averaged(passed: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """Mean of the shards' vectors by their weight and the mean loss: one row per number, summed in Spark."""
    own = passed.filter(F.col("net").isNotNull())
    sums = own.select(F.posexplode(F.concat("net", F.array("loss"))).alias("i", "x"), "weight").groupBy("i").agg(
        (F.sum(F.when(F.col("i") < size, F.col("x") * F.col("weight")).otherwise(F.col("x"))) / F.sum("weight")).alias("x"))
    vec = sums.toPandas().sort_values("i")["x"].to_numpy()
    return vec[:-1], float(vec[-1])


def train(rows: DataFrame, model: U.Model, *, px: Sequence[str], second: int = 1_000_000, target: str = "mid",
          descent: Descent = Descent()) -> tuple[U.Model, DataFrame, list[float]]:
    """Trained model, event parameters and the mean loss of every pass; each event weighs the same.

    Takes one row per event second, without rows that miss a used value. Without any row the model comes back as
    it was. Event parameters are numbers ``d_b`` and ``d_rho``, or arrays of one per channel with ``per_channel``.
    """
    spark, d, k, names = rows.sparkSession, descent.for_mode(model.mode), len(px), list(model.extras)
    use = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*px, "tte_s", "strike", target, *names])]
    nums = [f"c{i}" for i in range(len(use))]
    clean = materialize(event_weight(U.fit_samples(rows, second=second).select("ticker", "ts", *use).dropna(
        subset=["ticker", *nums]), "ticker").drop("n_rows"), "joint_rows")
    n = max(1, -(-clean.count() // d.shard_rows))
    buckets = min(n, BUCKETS)
    shard = F.pmod(F.xxhash64("ticker"), F.lit(n)).cast("int").alias("shard")
    data = bucketed(clean.select(shard, "*").repartition(buckets, "shard"), buckets, "joint_data")
    half = k if d.per_channel else 1
    schema = (f"shard INT, ticker {rows.schema['ticker'].dataType.simpleString()}, at ARRAY<DOUBLE>, m ARRAY<DOUBLE>, v ARRAY<DOUBLE>, net ARRAY<DOUBLE>, "
              "loss DOUBLE, weight DOUBLE")
    zero = F.array_repeat(F.lit(0.0), 2 * half)
    void = F.lit(None)
    start = data[0].groupBy("shard", "ticker").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "ticker", zero.alias("at"), zero.alias("m"), zero.alias("v"),
        void.cast("array<double>").alias("net"), void.cast("double").alias("loss"), void.cast("double").alias("weight"))
    state = bucketed(start.repartition(buckets, "shard"), buckets, "joint_state")
    theta = flatten(model)
    net, losses = np.stack([theta, np.zeros_like(theta), np.zeros_like(theta)]), []

    for p in range(d.passes if clean.limit(1).count() else 0):
        shared = spark.sparkContext.broadcast(net)

        passed = bucketed(data[0].groupBy("shard").cogroup(state[0].filter(F.col("ticker").isNotNull()).groupBy("shard"))
                          .applyInPandas(shard_pass(model, shared, nums, d, p), schema), buckets, "joint_state")
        vec, loss = averaged(passed[0], net.size)
        net = vec.reshape(net.shape)
        losses.append(loss)
        drop(spark, state)
        shared.destroy()
        state = passed
    pick = (lambda lo: F.slice("at", lo + 1, half)) if d.per_channel else (lambda lo: F.col("at")[lo])
    params = materialize(state[0].filter(F.col("ticker").isNotNull()).select(
        "ticker", pick(0).alias("d_b"), pick(half).alias("d_rho")), "joint_params")
    drop(spark, data, state)
    return unflatten(model, net[0]), params, losses


def finetune(rows: DataFrame, model: U.Model, *, px: Sequence[str], second: int, fit_above: float, min_rows: int = 30,
             event_steps: int = U.FIRST_STEPS, target: str = "mid",
             descent: Descent = Descent(TUNE_EPOCHS, TUNE_BATCH, TUNE_RATE, RATE, 0.0, 0.0, 0.0)
             ) -> tuple[U.Model, DataFrame, list[float]]:
    """A trained model goes on over the earlier half of the events, with a slow rate for its network, and is
    measured on the later half: (model, held-out rows, losses). An odd event is measured; one event alone is too."""
    from tickloom.operators.training import held_out

    split = U.split_events(rows.groupBy("ticker").agg(F.min("ts").alias("open_ts")), 0.5, up=True)
    marked = rows.join(split.select("ticker", "split"), "ticker")
    tuned, _, losses = train(marked.filter("split = 'train'").drop("split"), model, px=px, second=second, target=target,
                             descent=descent)
    return tuned, held_out(marked.filter("split = 'val'"), tuned, px=px, second=second, fit_above=fit_above,
                           steps=event_steps, min_rows=min_rows), losses
