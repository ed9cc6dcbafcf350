"""The fair-probability surface: loading, scoring, per-event fits and training.

Everything numeric is NumPy inside Spark tasks; the network is about a thousand weights
and travels with the task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import prices as P
from tickloom.operators.folds import fold_groups
from tickloom.schema import struct_of

MID_CLIP, FD_STEP = 0.01, 1e-4  # fixed values of the fit
FIRST_STEPS, REFIT_STEPS, LEARNING_RATE = 150, 60, 0.05
EPOCHS, BATCH = 25, 16384  # passes over the training rows, and rows of one step


@dataclass(frozen=True)
class Model:
    """Weights and scales; ``rhos`` holds one log scale per price channel."""
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    rhos: tuple[float, ...]
    b_scale: float = 50.0
    mode: str = "direct"
    clamp: float = 2.0
    extras: tuple[str, ...] = ()
    mu: tuple[float, ...] = ()
    sd: tuple[float, ...] = ()
    label: str = "model"
    digest: str = field(default="", compare=False)

    @property
    def channels(self) -> int:
        return len(self.rhos)


def model_from_json(text: str, label: str = "model") -> Model:
    """Parse and check a model file: layer shapes, extras with their moments, mode."""
    import hashlib

    js = json.loads(text)
    layers = tuple((np.asarray(l["w"], dtype=float), np.asarray(l["b"], dtype=float))
                   for l in js["layers"])
    rhos = [float(js["rho_bar"])]
    rhos += [float(js[k]) for k in ("rho_cb", "rho_kr") if js.get(k) is not None]
    extras = tuple(js.get("extras") or ())
    mu, sd = tuple(js.get("mu") or ()), tuple(js.get("sd") or ())
    arch = js["arch"]
    if arch.get("mode", "direct") not in ("direct", "structured"):
        raise ValueError(f"unsupported mode {arch['mode']}")
    if len(layers) != 3:
        raise ValueError("expected 3 layers")
    if layers[0][1].shape[0] != arch["hidden"]:
        raise ValueError("hidden size mismatch")
    if len(mu) != len(extras) or len(sd) != len(extras):
        raise ValueError("mu and sd must match extras")
    width = len(rhos) + 1 + len(extras)
    for w, b in layers:
        if w.ndim != 2 or w.shape != (b.shape[0], width):
            raise ValueError(f"layer shape {w.shape}, expected ({b.shape[0]}, {width})")
        width = b.shape[0]
    return Model(layers, tuple(rhos), float(js.get("b_scale", 50.0)), arch.get("mode", "direct"),
                 float(arch.get("clamp", 2.0)), extras, mu, sd, label,
                 hashlib.sha256(text.encode()).hexdigest())


def load_model(path: str, label: str = "model") -> Model:
    with open(path) as f:
        return model_from_json(f.read(), label)


def seeded_model(channels: int = 1, extras: Sequence[str] = (), hidden: int = 32,
                 rho: float = 4.0, seed: int = 7, scale: float = 0.4) -> Model:
    """A small random surface, mostly increasing in price; start of training and tests."""
    rng = np.random.default_rng(seed)
    dims = [channels + 1 + len(extras), hidden, hidden, 1]
    layers = []
    for i, (a, b) in enumerate(zip(dims[:-1], dims[1:])):
        w = rng.normal(0, scale / np.sqrt(a), (b, a))
        if i == 0:
            w[:, :channels] = np.abs(w[:, :channels])
        else:
            w = np.abs(w)
        layers.append((w, rng.normal(0, 0.05, b)))
    n = len(extras)
    return Model(tuple(layers), (rho,) * channels, 50.0, "direct", 2.0, tuple(extras), (0.0,) * n,
                 (1.0,) * n)


# ── scoring ──────────────────────────────────────────────────────────────────

def inputs(model: Model, px: np.ndarray, tte: np.ndarray, b, s_shift, extras) -> np.ndarray:
    """Network input: one z per channel, log remaining time, standardised extras."""
    tau = np.clip(tte / P.WINDOW_S, 1e-4, 1.0)
    root = np.sqrt(tau)
    z = [((px[:, i] - b) / np.exp(r + s_shift)) / root for i, r in enumerate(model.rhos)]
    cols = z + [np.log(tau)]
    if model.extras:
        x = np.clip((extras - np.asarray(model.mu)) / np.asarray(model.sd), -5, 5)
        cols += list(x.T)
    return np.stack(cols, axis=1)


def forward(model: Model, x: np.ndarray) -> np.ndarray:
    h = x
    for i, (w, b) in enumerate(model.layers):
        h = h @ w.T + b
        if i < len(model.layers) - 1:
            h = np.tanh(h)
    raw = h[:, 0]
    if model.mode == "structured":
        return x[:, 0] * np.exp(model.clamp * np.tanh(raw / model.clamp))
    return raw


def logits(model: Model, px, tte, strike, d_b, d_rho, extras=None) -> np.ndarray:
    return forward(model, inputs(model, px, tte, strike + model.b_scale * d_b, d_rho, extras))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def score(df: DataFrame, model: Model, *, px: Sequence[str], tte: str = "tte_s",
          strike: str = "strike", d_b: str = "d_b", d_rho: str = "d_rho", out: str = "fair",
          extras: Sequence[str] | None = None) -> DataFrame:
    """Fair probability per row; null when an input is missing."""
    names = list(extras if extras is not None else model.extras)
    if len(px) != model.channels:
        raise ValueError(f"model has {model.channels} price channels")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def fair(cols: pd.DataFrame) -> pd.Series:
        m = shared.value
        a = cols.to_numpy(dtype=float)
        n = m.channels
        with np.errstate(over="ignore", invalid="ignore"):
            lo = logits(m, a[:, :n], a[:, n], a[:, n + 1], a[:, n + 2], a[:, n + 3], a[:, n + 4:])
            p = sigmoid(lo)
        return pd.Series(np.where(np.isnan(a).any(axis=1), np.nan, p)).astype("Float64")

    args = [*px, tte, strike, d_b, d_rho, *names]
    packed = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(args)])
    return df.withColumn(out, fair(packed))


def logit_column(model: Model, *, px: Sequence[Column], tte: Column, strike: Column, d_b: Column,
                 d_rho: Column, extras: Sequence[Column] = ()) -> Column:
    """The same surface as one column expression over arrays, without Python workers."""
    b = strike + F.lit(model.b_scale) * d_b
    root = F.sqrt(P.tau(tte))
    cols = [((p - b) / F.exp(F.lit(r) + d_rho)) / root for p, r in zip(px, model.rhos)]
    cols.append(F.log(P.tau(tte)))
    for x, m, s in zip(extras, model.mu, model.sd):
        z = (x - F.lit(m)) / F.lit(s)
        cols.append(F.least(F.greatest(z, F.lit(-5.0)), F.lit(5.0)))
    first, h = cols[0], F.array(*cols)
    for i, (w, bias) in enumerate(model.layers):
        units = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in row]).alias("w"),
                                   F.lit(float(c)).alias("b")) for row, c in zip(w, bias)])
        last = i == len(model.layers) - 1
        h = F.transform(units, _unit(h, last))
    raw = F.get(h, F.lit(0))
    if model.mode == "structured":
        return first * F.exp(F.lit(model.clamp) * F.tanh(raw / model.clamp))
    return raw


def _unit(x: Column, linear: bool):
    """One layer's unit: weights and bias in, activation out."""
    def value(u):
        dot = F.aggregate(F.zip_with(u["w"], x, lambda a, b: a * b), u["b"], lambda s, v: s + v)
        return dot if linear else F.tanh(dot)
    return value


# ── per-event fit ────────────────────────────────────────────────────────────

def fit_loss(model: Model, px, tte, mid, strike, d_b, d_rho, extras=None) -> float:
    lo = logits(model, px, tte, strike, d_b, d_rho, extras)
    y = np.clip(mid, MID_CLIP, 1 - MID_CLIP)
    return float(np.mean(np.maximum(lo, 0) - lo * y + np.log1p(np.exp(-np.abs(lo)))))


def fit(model: Model, px, tte, mid, strike, start=(0.0, 0.0), steps: int = FIRST_STEPS,
        extras=None) -> tuple[float, float]:
    """Full-batch Adam on the two event parameters, gradients by central difference."""
    at, m, v = np.array(start, dtype=float), np.zeros(2), np.zeros(2)
    unit = np.eye(2) * FD_STEP
    for t in range(1, steps + 1):
        g = np.array([(fit_loss(model, px, tte, mid, strike, *(at + e), extras)
                       - fit_loss(model, px, tte, mid, strike, *(at - e), extras))
                      / (2 * FD_STEP) for e in unit])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        at = at - LEARNING_RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return float(at[0]), float(at[1])


CALIB = "boundary DOUBLE, rows INT, d_b DOUBLE, d_rho DOUBLE, bce DOUBLE"


def fit_samples(rows: DataFrame, *, second: int, ts: str = "ts") -> DataFrame:
    """First row of each event second: a fit sees at most one row per second of the window.

    Of rows at one instant the smallest stays, by its columns in order.
    """
    packed = F.struct(*[F.col(c) for c in rows.columns])
    sec = F.floor(F.col(ts) / second)
    first = F.min(F.struct(F.col(ts).alias("_at"), packed.alias("_r")))
    return rows.groupBy("ticker", sec.alias("_s")).agg(first.alias("_f")).select("_f._r.*")


def calibrate(samples: DataFrame, model: Model, *, px: Sequence[str], tte_max: int = 300,
              step: int = 60, window: float = 120.0, min_rows: int | None = None,
              on_short: str = "skip", ts: str = "ts", first_steps: int = FIRST_STEPS,
              refit_steps: int = REFIT_STEPS) -> DataFrame:
    """(d_b, d_rho) per event at each boundary, warm-started from the one before.

    Boundary B fits rows with time to expiry in (B, B + window], or all above B when
    ``window`` is 0. Below the minimum (30 rolling, 60 expanding) it is skipped, or with
    ``on_short='wait'`` the event's later boundaries wait for it and are not fitted.
    ``samples`` come from ``fit_samples``, so an event is at most 900 rows.
    """
    need = min_rows if min_rows is not None else (30 if window > 0 else 60)
    names = list(model.extras)
    cols = samples.select("ticker", ts, F.col("tte_s").cast("double").alias("tte_s"),
                          F.col("mid").cast("double").alias("mid"),
                          F.col("strike").cast("double").alias("strike"),
                          *[F.col(c).cast("double").alias(f"px{i}") for i, c in enumerate(px)],
                          *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    shared = samples.sparkSession.sparkContext.broadcast(model)

    def run(key, d):
        m = shared.value
        price = np.stack([d[f"px{i}"] for i in range(len(px))], axis=1)
        x = np.stack([d[f"x{i}"] for i in range(len(names))], axis=1) if names else None
        out, at = [], None
        for b in range(int(tte_max), 0, -int(step)):
            use = d["tte_s"] > b
            if window > 0:
                use &= d["tte_s"] <= b + window
            if use.sum() < need:
                if on_short == "wait":
                    break
                continue
            part = (price[use], d["tte_s"][use], d["mid"][use], d["strike"][0])
            ex = x[use] if x is not None else None
            at = fit(m, *part, at or (0.0, 0.0), first_steps if at is None else refit_steps, ex)
            out.append((float(b), int(use.sum()), *at, fit_loss(m, *part, *at, ex)))
        if not out:
            return None
        res = dict(zip(("boundary", "rows", "d_b", "d_rho", "bce"), map(list, zip(*out))))
        res["ticker"] = [key[0]] * len(out)
        return res

    schema = struct_of(CALIB, samples.schema["ticker"])
    return fold_groups(cols, ["ticker"], [ts], run, schema)


def fit_sweep(samples: DataFrame, model: Model, cuts: Sequence[int], *, px: Sequence[str],
              ts: str = "ts", min_rows: int = 60) -> DataFrame:
    """Static fits, one per cut F: parameters from rows with time to expiry above F."""
    out = None
    for cut in cuts:
        part = calibrate(samples, model, px=px, tte_max=cut, step=cut, window=0, ts=ts,
                         min_rows=min_rows)
        out = part if out is None else out.unionByName(part)
    return out


def identity(model: Model) -> str:
    """Name of a model's numbers: the digest of its file, or one of its weights and scales."""
    import hashlib

    if model.digest:
        return model.digest
    parts = [f"{model.mode}|{model.b_scale}|{model.clamp}|{model.rhos}|{model.extras}|{model.mu}|{model.sd}".encode()]
    parts += [np.ascontiguousarray(a, dtype="<f8").tobytes() for layer in model.layers for a in layer]
    return hashlib.sha256(b"".join(parts)).hexdigest()


def own_calibration(calib: DataFrame, model: Model, column: str = "model_hash") -> DataFrame:
    """Calibration fitted with this very model; rows of another model, or of none, are refused."""
    return calib.filter(F.col(column) == identity(model))


def with_params(rows: DataFrame, calib: DataFrame, *, tte_max: float, step: int) -> DataFrame:
    """Rows joined to the fit of their segment (B - step, B]; rows without one are dropped."""
    k = F.floor((F.lit(float(tte_max)) - F.col("tte_s")) / step)
    seg = F.lit(float(tte_max)) - k * step
    keyed = rows.filter(F.col("tte_s") <= tte_max).withColumn("boundary", seg.cast("double"))
    return keyed.join(calib.select("ticker", "boundary", "d_b", "d_rho"), ["ticker", "boundary"])


def fair_series(rows: DataFrame, model: Model, *, px: Sequence[str], second: int,
                tte_max: int = 300, step: int = 60, window: float = 120.0, ts: str = "ts",
                calib: DataFrame | None = None, **fit_args) -> DataFrame:
    """Causal fair value: every row scored with the fit of its segment."""
    if calib is None:
        calib = calibrate(fit_samples(rows, second=second, ts=ts), model, px=px,
                          tte_max=tte_max, step=step, window=window, ts=ts, **fit_args)
    joined = with_params(rows, calib, tte_max=tte_max, step=step)
    return score(joined, model, px=px).withColumn("gap", F.col("fair") - F.col("mid"))


def demean(series: DataFrame, model: Model, *, px: Sequence[str], second: int, window: int,
           step: int, ts: str = "ts", history: DataFrame | None = None,
           min_samples: int = 5) -> DataFrame:
    """Gap minus its trailing mean, the mean recomputed under the row's own calibration.

    For each segment the one-second grid of the look-back is scored again with that
    segment's parameters, so refits do not leave a step in the baseline. ``history`` holds
    all rows of the events (default: the scored ones).
    """
    seg = series.select("ticker", "boundary", "d_b", "d_rho").distinct()
    grid = fit_samples(history if history is not None else series, second=second, ts=ts)
    grid = grid.drop("boundary", "d_b", "d_rho", "fair", "gap")
    slots = int(np.ceil(window / step)) + 1
    base = F.ceil(F.col("tte_s") / step) * step
    spread = grid.withColumn("boundary", F.explode(F.array(
        *[(base - i * step).cast("double") for i in range(slots)])))
    spread = spread.join(seg, ["ticker", "boundary"])
    spread = spread.filter((F.col("tte_s") > F.col("boundary") - step)
                           & (F.col("tte_s") <= F.col("boundary") + window))
    again = score(spread, model, px=px).select(
        "ticker", "boundary", F.col("tte_s").alias("_tte"),
        (F.col("fair") - F.col("mid")).alias("_g"))
    from pyspark.sql import Window
    whole = F.struct(*[F.col(c) for c in series.columns])
    both = series.select("ticker", "boundary", F.col("tte_s").alias("_tte"), whole.alias("_row"))
    both = both.unionByName(again, allowMissingColumns=True)
    # a (ticker, boundary) partition is one refit step of one event
    frame = Window.partitionBy("ticker", "boundary").orderBy("_tte").rangeBetween(0, window)
    both = both.withColumn("_n", F.count("_g").over(frame)).withColumn(
        "gbar", F.when(F.col("_n") >= min_samples, F.avg("_g").over(frame)))
    out = both.filter(F.col("_row").isNotNull()).select("_row.*", "gbar")
    return out.withColumn("sig", F.col("gap") - F.col("gbar"))


def fair_at(pairs: DataFrame, model: Model, *, px: Sequence[str], then: str = "then",
            out: str = "fair_then") -> DataFrame:
    """Fair of the looked-back row under the current row's parameters.

    ``pairs`` holds the past inputs as columns prefixed by ``then_``.
    """
    return score(pairs, replace(model), px=[f"{then}_{p}" for p in px], tte=f"{then}_tte_s",
                 out=out, extras=[f"{then}_{e}" for e in model.extras])


# ── training ─────────────────────────────────────────────────────────────────

def flatten(model: Model) -> np.ndarray:
    return np.concatenate([np.r_[w.ravel(), b] for w, b in model.layers])


def unflatten(model: Model, theta: np.ndarray) -> Model:
    layers, at = [], 0
    for w, b in model.layers:
        nw = theta[at:at + w.size].reshape(w.shape)
        at += w.size
        layers.append((nw, theta[at:at + b.size]))
        at += b.size
    return replace(model, layers=tuple(layers))


def backprop(model: Model, x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Weighted loss sum and its gradient over the flattened weights (direct mode)."""
    acts, h = [x], x
    for i, (wt, b) in enumerate(model.layers):
        h = h @ wt.T + b
        if i < len(model.layers) - 1:
            h = np.tanh(h)
        acts.append(h)
    lo = h[:, 0]
    loss = float(np.sum(w * (np.maximum(lo, 0) - lo * y + np.log1p(np.exp(-np.abs(lo))))))
    delta = (w * (sigmoid(lo) - y))[:, None]
    grads = []
    for i in range(len(model.layers) - 1, -1, -1):
        wt = model.layers[i][0]
        grads.append(np.r_[(delta.T @ acts[i]).ravel(), delta.sum(axis=0)])
        if i:
            delta = (delta @ wt) * (1 - acts[i] ** 2)
    return loss, np.concatenate(grads[::-1])


def gradient(df: DataFrame, model: Model, *, px: Sequence[str], target: str = "mid",
             weight: str = "weight") -> tuple[float, np.ndarray]:
    """Loss and gradient over the whole table: partial sums per partition, added in Spark.

    Only the gradient itself (one number per weight) reaches the driver.
    """
    loss, _, g = weighted_gradient(df, model, px=px, target=target, weight=weight)
    return loss, g


def weighted_gradient(df: DataFrame, model: Model, *, px: Sequence[str], target: str = "mid",
                      weight: str = "weight") -> tuple[float, float, np.ndarray]:
    """As ``gradient``, with the sum of weights in the middle; without rows all are zero."""
    names = list(model.extras)
    cols = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(
        [*px, "tte_s", "strike", "d_b", "d_rho", target, weight, *names])])
    shared = df.sparkSession.sparkContext.broadcast(model)
    k = len(px)

    def partial(batches):
        m, total = shared.value, None
        for pdf in batches:
            a = pdf.dropna().to_numpy(dtype=float)
            if not len(a):
                continue
            x = inputs(m, a[:, :k], a[:, k], a[:, k + 1] + m.b_scale * a[:, k + 2], a[:, k + 3],
                       a[:, k + 6:])
            y = np.clip(a[:, k + 4], MID_CLIP, 1 - MID_CLIP)
            loss, g = backprop(m, x, y, a[:, k + 5])
            part = np.r_[loss, a[:, k + 5].sum(), g]
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

    sums = cols.mapInPandas(partial, "i INT, g DOUBLE").groupBy("i").agg(F.sum("g").alias("g"))
    vec = sums.toPandas().sort_values("i")["g"].to_numpy()  # one value per weight
    shared.destroy()
    if not len(vec):
        return 0.0, 0.0, np.zeros_like(flatten(model))
    return vec[0] / vec[1], vec[1], vec[2:] / vec[1]


def in_batches(df: DataFrame, rows: int, label: str) -> list[DataFrame]:
    """The table dealt into batches of about ``rows`` rows by a hash of all columns, written once."""
    from tickloom.session import materialize

    table = materialize(df, label)
    n = -(-table.count() // rows)
    if n <= 1:
        return [table]
    own = F.pmod(F.xxhash64(*table.columns), F.lit(n)).cast("int")
    dealt = materialize(table.withColumn("_batch", own).repartition("_batch").sortWithinPartitions("_batch"), label)
    return [dealt.filter(F.col("_batch") == i).drop("_batch") for i in range(n)]


def adam(theta: np.ndarray, batches: Sequence, slope, steps: int, lr: float) -> tuple[np.ndarray, list[float]]:
    """``steps`` passes, one Adam step per batch; ``slope(batch, theta)`` gives loss, weight and gradient.

    Returns the weights and the mean loss of each pass, taken as the pass goes.
    """
    m, v, losses, t = np.zeros_like(theta), np.zeros_like(theta), [], 0
    for _ in range(steps):
        total = weights = 0.0
        for batch in batches:
            loss, weight, g = slope(batch, theta)
            if not weight:
                continue
            t, total, weights = t + 1, total + loss * weight, weights + weight
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        losses.append(total / weights if weights else float("nan"))
    return theta, losses


SHARD_BATCHES = 64  # batches that one task takes in turn


def packed_shards(df: DataFrame, rows: int, label: str) -> DataFrame:
    """The table, numbers only, dealt into batches as ``in_batches`` does, ``SHARD_BATCHES`` to a shard.

    One row per shard: its share of all rows, the sizes of its batches and the numbers, batch after
    batch, as bytes. A pass over such a table moves nothing between tasks.
    """
    from tickloom.session import materialize

    table = materialize(df, label)
    total = table.count()
    n = max(-(-total // rows), 1)
    shards = -(-n // SHARD_BATCHES)
    own = F.pmod(F.xxhash64(*table.columns), F.lit(n)).cast("int")
    names = table.columns

    def pack(key, pdf):
        pdf = pdf.sort_values("_batch", kind="stable")
        sizes = np.bincount(pdf["_batch"]).tolist()
        return pd.DataFrame({"share": [len(pdf) / total], "sizes": [[s for s in sizes if s]],
                             "data": [pdf[names].to_numpy(dtype=float).tobytes()]})

    dealt = table.withColumn("_batch", own).withColumn("_shard", F.col("_batch") % shards)
    return materialize(dealt.groupBy("_shard").applyInPandas(pack, "share DOUBLE, sizes ARRAY<INT>, data BINARY"), label)


def descend(shards: DataFrame, theta: np.ndarray, slope, width: int, steps: int, lr: float) -> tuple[np.ndarray, list[float]]:
    """``steps`` passes of Adam over packed shards of ``width`` numbers a row, a pass being one job.

    ``slope(theta, rows)`` gives the loss sum and its gradient over one batch; every shard takes a step
    per batch on its own, then weights and moments are averaged by the shards' rows. One shard is the
    sequence of steps that ``adam`` takes. Returns the weights and the mean loss of each pass.
    """
    size, losses, t = len(theta), [], 0
    state = np.concatenate([theta, np.zeros(2 * size)])
    for _ in range(steps):
        shared = shards.sparkSession.sparkContext.broadcast((state, t))

        def one_pass(batches):
            for pdf in batches:
                for share, sizes, data in zip(pdf["share"], pdf["sizes"], pdf["data"]):
                    state, t = shared.value
                    x, m, v = np.split(state, 3)
                    rows, at, total = np.frombuffer(data).reshape(-1, width), 0, 0.0
                    for n in sizes:
                        loss, g = slope(x, rows[at:at + n])
                        at, t, total, g = at + n, t + 1, total + loss, g / n
                        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                        x = x - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                    part = share * np.r_[total / len(rows), x, m, v]
                    yield pd.DataFrame({"i": np.arange(len(part)), "g": part, "t": t})

        sums = shards.mapInPandas(one_pass, "i INT, g DOUBLE, t INT").groupBy("i").agg(
            F.sum("g").alias("g"), F.max("t").alias("t")).toPandas().sort_values("i")  # one value per weight and moment
        shared.destroy()
        if sums.empty:  # no rows at all
            return theta, [float("nan")] * steps
        values, t = sums["g"].to_numpy(), int(sums["t"].iloc[0])
        losses.append(float(values[0]))
        state = values[1:]
    return state[:size], losses


def train_net(batches: Sequence[DataFrame], model: Model, *, px: Sequence[str], steps: int, lr: float = 0.01,
              target: str = "mid", weight: str = "weight") -> tuple[Model, list[float]]:
    """Adam on the network, event parameters given as columns of the batches."""
    def slope(batch, theta):
        return weighted_gradient(batch, unflatten(model, theta), px=px, target=target, weight=weight)

    theta, losses = adam(flatten(model), batches, slope, steps, lr)
    return unflatten(model, theta), losses


def train(rows: DataFrame, model: Model, *, px: Sequence[str], rounds: int = 2, steps: int = EPOCHS,
          lr: float = 0.01, second: int = 1_000_000, target: str = "mid",
          event_steps: int = FIRST_STEPS) -> tuple[Model, DataFrame, list[float]]:
    """Surface with per-event parameters, each event weighing the same.

    Alternates: events are fitted in parallel with the network fixed, then the network makes
    ``steps`` passes over the rows with the events fixed, a step on the gradient sums of each
    ``BATCH`` rows. The training table is written once per round, so no plan grows with the
    number of steps. Losses are one per pass.
    """
    from tickloom.operators.stats import event_weight
    from tickloom.session import materialize

    samples = materialize(fit_samples(rows, second=second), "samples")
    losses: list[float] = []
    params = None
    for _ in range(rounds):
        params = materialize(calibrate(samples, model, px=px, tte_max=1, step=1, window=0, min_rows=1,
                                       first_steps=event_steps).select("ticker", "d_b", "d_rho"), "params")
        batches = in_batches(event_weight(samples.join(params, "ticker"), "ticker"), BATCH, "train")
        model, part = train_net(batches, model, px=px, steps=steps, lr=lr, target=target)
        losses += part
    return model, params, losses


def split_events(meta: DataFrame, frac: float = 0.1, *, open_ts: str = "open_ts", up: bool = False) -> DataFrame:
    """Marks the last ``max(1, int(frac n))`` events by open time as validation; ``up`` rounds up.

    The cut is an exact order statistic of open time, ties resolved by ticker.
    """
    from tickloom.operators import chunks as C

    n = meta.agg(F.count(F.lit(1)).alias("_n"))
    width = 86_400_000_000
    ranked = C.running_sum(meta, F.lit(1), "_i", by=[], ts=open_ts, order=["ticker"], chunk=width)
    hold = F.greatest(F.lit(1), (F.ceil if up else F.floor)(F.col("_n") * frac))
    return C.attach_row(ranked, n).withColumn(
        "split", F.when(F.col("_i") > F.col("_n") - hold, "val").otherwise("train")).drop("_i", "_n")


def residual_momentum(rows: DataFrame, *, logit: str = "logit", momentum: str = "mom",
                      outcome: str = "outc", weight: str | None = None) -> DataFrame:
    """Logistic regression of the outcome on momentum, the surface's logit as offset."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    given = F.col(weight) if weight else F.lit(1.0)
    data = VectorAssembler(inputCols=[momentum], outputCol="features").transform(
        rows.select(momentum, logit, F.col(outcome).cast("double").alias("label"), given.cast("double").alias("_w")).dropna())
    glm = GeneralizedLinearRegression(family="binomial", link="logit", offsetCol=logit, weightCol="_w",
                                      maxIter=50, tol=1e-9, regParam=0.0)
    fitted = glm.fit(data)
    return rows.sparkSession.createDataFrame(
        [(float(fitted.intercept), float(fitted.coefficients[0]))], "alpha DOUBLE, beta DOUBLE")


def residual_fit(rows: DataFrame, *, logit: str = "logit", momentum: str = "mom", outcome: str = "outc",
                 frac: float = 0.1) -> DataFrame:
    """Momentum residual of the training events: one row (alpha, beta, mom_mu, mom_sd).

    Momentum is scaled by the moments of the training rows and held within five deviations; each event weighs
    the same. The last ``frac`` of the events take no part.
    """
    from tickloom.operators import stats as S
    from tickloom.operators.chunks import attach_row
    from tickloom.session import materialize

    split = split_events(rows.groupBy("ticker").agg(F.min("ts").alias("open_ts")), frac)
    kept = rows.select("ticker", logit, F.col(momentum).alias("mom"), outcome).dropna().join(
        split.filter("split = 'train'").select("ticker"), "ticker", "left_semi")
    kept = materialize(S.event_weight(kept, "ticker"), "residual")
    scaler = S.fit_scaler(kept, ["mom"])
    scaled = attach_row(kept, scaler).withColumn("mom", scaled_momentum(F.col("mom")))
    fit = residual_momentum(scaled, logit=logit, outcome=outcome, weight="weight")
    return attach_row(fit, scaler)


def scaled_momentum(mom: Column) -> Column:
    return F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (mom - F.col("mom_mu")) / F.col("mom_sd")))


def residual_adjusted(rows: DataFrame, fit: DataFrame, *, fair: str = "fair", momentum: str = "mom") -> DataFrame:
    """Rows with ``fair_adj``: fair value moved by the fitted momentum residual; without momentum it is null."""
    from tickloom.operators.chunks import attach_row

    bound = lambda c: F.greatest(F.lit(MID_CLIP), F.least(F.lit(1 - MID_CLIP), c))
    lo = P.logit(bound(F.col(fair))) + F.col("alpha") + F.col("beta") * scaled_momentum(F.col(momentum))
    adj = F.when(F.col(momentum).isNotNull() & F.col(fair).isNotNull(), bound(1 / (1 + F.exp(-lo))))
    return attach_row(rows, fit).withColumn("fair_adj", adj).drop("alpha", "beta", "mom_mu", "mom_sd")


LEAD_CLAMP = 1.5  # fixed value: largest correction of the lead model, in logits


def lead_rows(series: DataFrame, horizon: int, *, slack: int, chunk: int, ts: str = "ts",
              by: str = "ticker") -> DataFrame:
    """Rows with the quote ``horizon`` ahead: first one at or after it, less ``slack``."""
    from tickloom.operators.asof import asof_join

    ahead = asof_join(series, series.select(by, ts, "mid"), by=[by], ts=ts,
                      at=F.col(ts) + horizon - slack, direction="forward", take={"mid": "mid_next"},
                      chunk=chunk)
    return ahead.filter(F.col("mid_next").isNotNull()).withColumn(
        "base", P.logit(F.least(F.greatest("mid", F.lit(0.01)), F.lit(0.99))))
