"""Order-dependent rules (refractory, throttle, hysteresis) without one task per key.

A rule that remembers its last accepted row looks sequential, but over one time
chunk it is a small function from the state coming in to the state going out. Each
chunk is summarised on its own, the summaries of a key are chained (a few values per
chunk), and every chunk is then finished with the state it starts from.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.chunks import CHUNK, chunk_carry, chunk_start, chunk_window, with_chunk
from tickloom.session import materialize

NEVER = -(1 << 62)
#: readings of open chunks all at once before a key is walked instead
ROUNDS = 6


def rising_edges(df: DataFrame, on: Column, *, by: Sequence[str], ts: str,
                 order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Rows where ``on`` turns true; a null condition counts as false."""
    base = with_chunk(df.withColumn("_on", F.coalesce(on, F.lit(False))), ts, chunk)
    base = chunk_carry(base, by, {"_tail": F.max_by("_on", F.struct(ts, *order))},
                       {"_before": ("_tail", "last")})
    was = F.coalesce(F.lag("_on").over(chunk_window(by, ts, *order)), F.col("_before"),
                     F.lit(False))
    return (base.withColumn("_was", was).filter(F.col("_on") & ~F.col("_was"))
            .drop("_on", "_was", "_before", CHUNK))


def together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a group in one partition, by a hash of the keys.

    A repartition by the keys themselves is dropped below a join on them, and adaptive
    execution may then turn that join into one that scatters the groups again.
    """
    return df.repartition(F.xxhash64(*keys))


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn,
                schema: T.StructType) -> DataFrame:
    """Run ``fn(key, columns)`` on each group, rows in ``order``, ``columns`` as numpy arrays.

    ``fn`` returns a dict of equally long arrays (or None). Groups are read off sorted
    partitions, so many small groups cost no more than their rows.
    """
    keys, names = list(keys), schema.names

    def run(batches):
        pending, current = [], None

        def close():
            if len(pending) == 1:
                return fn(current, pending[0])
            return fn(current, {c: np.concatenate([p[c] for p in pending]) for c in pending[0]})

        def table(results):
            results = [r for r in results if r is not None]
            if results:
                cols = {n: [r[n] for r in results] for n in names}
                yield pd.DataFrame({n: v[0] if len(v) == 1 else np.concatenate(
                    [np.asarray(x) for x in v]) for n, v in cols.items()})

        for pdf in batches:
            if pdf.empty:
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            moved = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                moved[1:] |= cols[k][1:] != cols[k][:-1]
            starts = np.r_[0, np.flatnonzero(moved), len(pdf)]
            done = []
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(cols[k][a] for k in keys)
                if pending and key != current:
                    done.append(close())
                    pending.clear()
                current = key
                pending.append({c: v[a:b] for c, v in cols.items()})
            yield from table(done)
        if pending:
            yield from table([close()])

    parts = together(df, keys).sortWithinPartitions(*keys, *order)
    return parts.mapInPandas(run, schema)


def fold_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], start,
                schema: T.StructType) -> DataFrame:
    """Sequential rule over sorted rows with bounded memory, however long a group is.

    ``start(key)`` gives the rule of one group: ``step(columns)`` takes the next stretch of
    its rows, ``end()`` closes it; both return a dict of equally long arrays or None.
    """
    keys, names = list(keys), schema.names

    def run(batches):
        rule, current = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            moved = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                moved[1:] |= cols[k][1:] != cols[k][:-1]
            starts = np.r_[0, np.flatnonzero(moved), len(pdf)]
            done = []
            for a, b in zip(starts[:-1], starts[1:]):
                key = tuple(cols[k][a] for k in keys)
                if rule is None or key != current:
                    if rule is not None:
                        done.append(rule.end())
                    rule, current = start(key), key
                done.append(rule.step({c: v[a:b] for c, v in cols.items()}))
            done = [pd.DataFrame(d) for d in done if d is not None]
            if done:
                yield pd.concat(done, ignore_index=True)[names]
        if rule is not None:
            last = rule.end()
            if last is not None:
                yield pd.DataFrame(last)[names]

    parts = together(df, keys).sortWithinPartitions(*keys, *order)
    return parts.mapInPandas(run, schema)


def converge(rows: DataFrame, *, by: Sequence[str], order: Sequence[str], start: str, run,
             schema: T.StructType) -> DataFrame:
    """Results of a rule that forgets: every chunk read from the state ``openings`` finds for it."""
    def finish(key, d):
        return run(key, d, d["_open"][0], None, bool(d["_last"][0]))[1]

    place = [*by, CHUNK]
    states = openings(rows, by=by, order=order, start=start, run=run)
    return fold_groups(rows.join(states, place), place, order, finish, schema)


def openings(rows: DataFrame, *, by: Sequence[str], order: Sequence[str], start: str, run, link=None,
             hand=lambda closing: closing) -> DataFrame:
    """What every chunk of a key opens with: ``(key, chunk)``, ``_open`` and ``_last``, for rules that forget.

    ``run(key, columns, opening, before, last)`` reads one chunk from the text ``opening`` and
    returns (closing text, columns of its result). ``before`` is the pair (opening, closing) of
    its last run, so that a run may stop where both states have become equal. ``last`` is None
    while only states are wanted; in the final pass it says whether the key ends here.

    All chunks are first read from ``start``. A chunk whose predecessor closed with something
    else is read again from that, all of them at once, until nothing changes. After round n the
    first n chunks of every key are right, so it ends; a rule that forgets its past within a
    chunk takes two or three rounds, however many chunks a key has. A key that has not settled
    after ``ROUNDS`` (a rule kept in step by a regular flow) is walked from its first open chunk
    on, one chunk in memory at a time, so the work stays linear. States of a key are one row per
    chunk. ``rows`` is read in every round, only the chunks concerned: give a written table.

    ``link(openings, closings)`` may chain the readings of a key in another way: it returns, per
    chunk, what it should open with and whether it has to be read again for that. ``hand`` makes
    the next opening from a closing.
    """
    place = [*by, CHUNK]
    text = T.StringType()
    key_fields = [rows.schema[k] for k in place]
    states_schema = T.StructType([*key_fields, T.StructField("_from", text), T.StructField("_to", text)])

    def named(key):
        return {n: [v] for n, v in zip(place, key)}

    def first(key, d):
        return {**named(key), "_from": [start], "_to": [run(key, d, start, None, None)[0]]}

    def again(key, d):
        due, before = d["_due"][0], (d["_from"][0], d["_to"][0])
        return {**named(key), "_from": [due], "_to": [run(key, d, due, before, None)[0]]}

    states = materialize(fold_groups(rows, place, order, first, states_schema), "states")
    chain = Window.partitionBy(*by).orderBy(CHUNK)

    class Walk:
        """The open chunks of one key in order, each from what the one before it left."""

        def __init__(self, key):
            self.key, self.chunk, self.held, self.state = key, None, [], None

        def close(self):
            if not self.held:
                return []
            d = {c: np.concatenate([h[c] for h in self.held]) for c in self.held[0]}
            opening = self.state if self.state is not None else d["_due"][0]
            closing = run((*self.key, self.chunk), d, opening, None, None)[0]
            self.state, self.held = hand(closing), []
            return [(self.chunk, opening, closing)]

        def table(self, done):
            if not done:
                return None
            at, opened, closed = zip(*done)
            return {**{k: [v] * len(at) for k, v in zip(by, self.key)}, CHUNK: list(at), "_from": opened, "_to": closed}

        def step(self, d):
            done, cuts = [], np.flatnonzero(np.diff(d[CHUNK])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(d[CHUNK])]):
                if d[CHUNK][a] != self.chunk:
                    done += self.close()
                    self.chunk = int(d[CHUNK][a])
                self.held.append({c: v[a:b] for c, v in d.items()})
            return self.table(done)

        def end(self):
            return self.table(self.close())

    def chained(key, d):
        due, again = zip(*link(d["_from"].tolist(), d["_to"].tolist()))
        n = len(due)
        return {**{k: [v] * n for k, v in zip(by, key)}, CHUNK: d[CHUNK], "_from": d["_from"], "_to": d["_to"],
                "_due": list(due), "_again": list(again)}

    def linked(states):
        if link is None:
            due = states.withColumn("_due", F.coalesce(F.lag("_to").over(chain), F.lit(start)))
            return due.withColumn("_again", F.col("_due") != F.col("_from"))
        return materialize(fold_groups(states, by, [CHUNK], chained, T.StructType([
            *states_schema, T.StructField("_due", text), T.StructField("_again", T.BooleanType())])), "linked")

    for attempt in count():
        due = linked(states)
        stale = materialize(due.filter("_again").drop("_again"), "stale")
        if stale.isEmpty():
            return due.select(*place, F.col("_due").alias("_open"), F.lead(CHUNK).over(chain).isNull().alias("_last"))
        if attempt < ROUNDS:
            redone = fold_groups(rows.join(stale, place), place, order, again, states_schema)
        else:
            opened = stale.groupBy(*by).agg(F.min(CHUNK).alias("_open"), F.min_by("_due", CHUNK).alias("_due"))
            stale = states.join(opened, [*by]).filter(F.col(CHUNK) >= F.col("_open")).select(*place)
            redone = fold_stream(rows.join(opened, [*by]).filter(F.col(CHUNK) >= F.col("_open")), by, [CHUNK, *order],
                                 Walk, states_schema)
        states = materialize(states.join(stale.select(*place), place, "left_anti").unionByName(redone), "states")


def _chain_end(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the next acceptable time after each, and of the last one it leads to."""
    nxt = np.searchsorted(times, times + gap, side="left")
    here = np.arange(len(times))
    end = np.where(nxt < len(times), nxt, here)
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return nxt, end
        end = further


def refractory(df: DataFrame, *, by: Sequence[str], ts: str, gap: int,
               order: Sequence[str] = (), chunk: int, sparse: bool = True) -> DataFrame:
    """Rows kept when each must come at least ``gap`` after the last one kept.

    The first row of a key is always kept. Serves as cooldown over candidate rows and
    as throttle over all rows. ``chunk`` should be well above ``gap``. With ``sparse``
    the candidates are written out once instead of being derived again for each pass.
    """
    if gap <= 0:
        return df
    if not by:
        return refractory(df.withColumn("_all", F.lit(0)), by=["_all"], ts=ts, gap=gap,
                          order=order, chunk=chunk, sparse=sparse).drop("_all")
    if sparse:
        df = materialize(df, "candidates")
    keys = list(by)
    key_fields = [df.schema[k] for k in keys]
    cand = df.select(*keys, F.col(ts).cast("long").alias("_t")).distinct()
    cand = cand.withColumn(CHUNK, chunk_start(F.col("_t"), chunk))

    by_chunk = [*keys, CHUNK]

    def keyed(key, names, cols):
        size = len(next(iter(cols.values())))
        return {**{n: np.full(size, v) for n, v in zip(names, key)}, **cols}

    def summarise(key, cols):
        times = cols["_t"]
        _, end = _chain_end(times, gap)
        entries = min(int(np.searchsorted(times, key[-1] + gap, side="left")) + 1, len(times))
        enter, leave = times[:entries], times[end[:entries]]
        # entries that end alike are one case: keep the last of each
        keep = np.r_[leave[1:] != leave[:-1], True]
        return keyed(key, by_chunk, {"_enter": enter[keep], "_exit": leave[keep]})

    def chain(key, cols):
        starts, enter, leave = cols[CHUNK], cols["_enter"], cols["_exit"]
        bounds = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1], True])
        last, opening = NEVER, []
        for a, b in zip(bounds[:-1], bounds[1:]):
            opening.append(last)
            at = a + int(np.searchsorted(enter[a:b], last + gap, side="left"))
            if at < b:
                last = int(leave[at])
        return keyed(key, keys, {CHUNK: starts[bounds[:-1]],
                                 "_last": np.asarray(opening, dtype="int64")})

    def finish(key, cols):
        times = cols["_t"]
        nxt = np.searchsorted(times, times + gap, side="left")
        at = int(np.searchsorted(times, int(cols["_last"][0]) + gap, side="left"))
        kept = []
        while at < len(times):
            kept.append(times[at])
            at = nxt[at]
        return keyed(key, by_chunk, {ts: np.asarray(kept, dtype="int64")})

    long = T.LongType()

    def fields(*names):
        return T.StructType([*key_fields, *[T.StructField(n, long) for n in names]])

    parts = fold_groups(cand, by_chunk, ["_t"], summarise, fields(CHUNK, "_enter", "_exit"))
    opening = fold_groups(parts, keys, [CHUNK, "_enter"], chain, fields(CHUNK, "_last"))
    kept = fold_groups(cand.join(opening, by_chunk), by_chunk, ["_t"], finish,
                       fields(CHUNK, ts)).drop(CHUNK)
    rows = df.join(kept, [*keys, ts], "left_semi")
    if order:
        first = Window.partitionBy(*keys, ts).orderBy(*order)
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return materialize(rows, "kept") if sparse else rows


def first_per_island(df: DataFrame, reset: Column, hit: Column, *, by: Sequence[str], ts: str,
                     order: Sequence[str] = (), chunk: int) -> DataFrame:
    """First ``hit`` row after each ``reset`` row (and before the next); resets never hit."""
    at = F.struct(ts, *order)
    base = df.withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("long"))
    base = with_chunk(base.withColumn("_hit", F.coalesce(hit, F.lit(False))), ts, chunk)
    base = chunk_carry(base, by, {"_n": F.sum("_reset")}, {"_before": ("_n", "sum")})
    frame = chunk_window(by, ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_island", F.col("_before") + F.sum("_reset").over(frame))
    hits = base.filter(F.col("_hit") & (F.col("_reset") == 0))
    packed = F.struct(*[F.col(c) for c in df.columns])
    return (hits.groupBy(*by, "_island").agg(F.min_by(packed, at).alias("_row"))
            .select("_row.*"))


def hysteresis(df: DataFrame, sig: str, *, enter: float, leave: float, by: Sequence[str],
               ts: str, order: Sequence[str] = (), chunk: int) -> DataFrame:
    """Rows where an armed key sees ``|sig| >= enter``, one per episode.

    A crossing disarms. A disarmed key re-arms on a row with ``sig * direction <= leave``
    (direction = sign of the disarming row), and that row itself never crosses.

    Rows are first reduced to runs of one sign, with rows of ``|sig| <= leave`` as runs of
    sign 0. What a run does depends only on the state it is entered with (armed, or
    disarmed up or down), so each chunk is a map of three states, and the maps of a key
    are chained.
    """
    if not 0 <= leave < enter:
        raise ValueError("need 0 <= leave < enter")
    keys = list(by)
    at = F.struct(ts, *order)
    packed = F.struct(*[F.col(c) for c in df.columns])
    value = F.col(sig)
    base = df.filter(value.isNotNull()).withColumn(
        "_s", F.when(F.abs(value) <= leave, 0).otherwise(F.signum(value).cast("int")))
    base = with_chunk(base, ts, chunk)
    win = chunk_window(keys, ts, *order)
    before = F.lag("_s").over(win)
    base = base.withColumn("_start", before.isNull() | (before != F.col("_s")))
    frame = win.rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_run", F.sum(F.col("_start").cast("long")).over(frame))
    over = F.abs(value) >= enter
    runs = base.groupBy(*keys, CHUNK, "_run").agg(
        F.max("_s").alias("_s"),
        F.min_by(packed, F.when(F.col("_start") & over, at)).alias("_head"),
        F.min_by(packed, F.when(~F.col("_start") & over, at)).alias("_later"))
    runs = materialize(runs, "runs")
    slim = runs.select(*keys, CHUNK, "_run", "_s", F.col("_head").isNotNull().alias("_h"),
                       F.col("_later").isNotNull().alias("_l"))

    def step(state, s, head, later):
        """State after the run and which of its rows fires: 0 first, 1 later, -1 none."""
        if s == 0 or state == s:
            return (0 if s == 0 else state), -1
        if state == 0 and head:
            return s, 0
        return (s, 1) if later else (0, -1)

    def walk(state, cols):
        fired = []
        for s, head, later in zip(cols["_s"].tolist(), cols["_h"].tolist(), cols["_l"].tolist()):
            state, which = step(state, s, head, later)
            fired.append(which)
        return state, fired

    def summarise(key, cols):
        out = {f"_f{i}": [walk(q, cols)[0]] for i, q in enumerate((0, 1, -1))}
        return {**{n: [v] for n, v in zip([*keys, CHUNK], key)}, **out}

    def chain(key, cols):
        state, opening = 0, []
        for maps in zip(*[cols[f"_f{i}"].tolist() for i in range(3)]):
            opening.append(state)
            state = maps[(0, 1, -1).index(state)]
        size = len(opening)
        return {**{n: np.full(size, v) for n, v in zip(keys, key)}, CHUNK: cols[CHUNK],
                "_open": opening}

    def finish(key, cols):
        _, fired = walk(int(cols["_open"][0]), cols)
        fired = np.asarray(fired)
        hit = fired >= 0
        if not hit.any():
            return None
        size = int(hit.sum())
        return {**{n: np.full(size, v) for n, v in zip([*keys, CHUNK], key)},
                "_run": cols["_run"][hit], "_which": fired[hit]}

    key_fields = [df.schema[k] for k in keys]
    chunk_field = T.StructField(CHUNK, T.LongType())

    def fields(*names):
        return T.StructType([*key_fields, chunk_field, *[
            T.StructField(n, T.LongType()) for n in names]])

    place = [*keys, CHUNK]
    maps = fold_groups(slim, place, ["_run"], summarise, fields("_f0", "_f1", "_f2"))
    opening = fold_groups(maps, keys, [CHUNK], chain, fields("_open"))
    hits = fold_groups(slim.join(opening, place), place, ["_run"], finish,
                       fields("_run", "_which"))
    row = F.when(F.col("_which") == 0, F.col("_head")).otherwise(F.col("_later"))
    return runs.join(hits, [*place, "_run"]).select(row.alias("_row")).select("_row.*")
