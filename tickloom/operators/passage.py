"""First passage: when a series first reaches a level after a given time, without series-query pairs.

The series is cut into time chunks; above them stands a tree of maxima (a node has the maxima of
``fan`` nodes below it, one row each). A query looks through the rest of its own chunk; if the level
is not reached there, through the later siblings of its chunk, then of the parent, and so on. Where a
node's maximum reaches the level, it goes down again, each time to the first child that does. So a
query is moved a logarithmic number of times, however far away its answer lies, and a chunk is read
once on the way up and once on the way down.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.chunks import chunk_start
from tickloom.operators.folds import NEVER, fold_groups
from tickloom.session import materialize


def _first_reached(key, d):
    """Per query the time of the first later item with a value at or above its level.

    Going back in time, items that a nearer one tops are forgotten, so values grow with distance
    and a query is one binary search.
    """
    at, far = [], []  # times, and values negated; the nearest item stands last
    asks, hits = [], []
    # newest first; a query comes before the items of its own time, which it does not see
    for i in np.lexsort((~d["_asks"].astype(bool), -d["_t"])):
        if d["_asks"][i]:
            found = bisect_right(far, -d["_v"][i]) - 1
            asks.append(i)
            hits.append(at[found] if found >= 0 else None)
        else:
            low = -d["_v"][i]
            while far and far[-1] >= low:
                far.pop()
                at.pop()
            far.append(low)
            at.append(int(d["_t"][i]))
    if not asks:
        return None
    return {**{n: v[asks] for n, v in d.items() if n not in ("_asks", "_t")}, "_hit": np.array(hits, dtype=object)}


def first_passage(queries: DataFrame, series: DataFrame, *, value: Column, level: Column, by: Sequence[str],
                  ident: Sequence[str], chunk: int, ts: str = "ts", rest: int | None = None, fan: int = 64,
                  out: str = "hit_ts") -> DataFrame:
    """``queries`` with the first time after ``ts`` (within ``rest``) at which ``value`` is at least ``level``.

    ``ident`` names columns that tell the queries of a ``by`` key apart. Rows of ``series`` without a
    value are passed over; a query without a level has no answer.
    """
    keys, named = list(by), list(ident)
    items = series.select(*keys, F.col(ts).alias("_t"), value.cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    items = [materialize(items.withColumn("_node", chunk_start(F.col("_t"), chunk)), "series")]
    span = items[0].agg(F.min("_node").alias("a"), F.max("_node").alias("b")).first()
    lengths = [chunk]
    while span.a is not None and (span.b - span.a) // lengths[-1] > 1 or len(lengths) < 2:
        lengths.append(lengths[-1] * fan)
        below = items[-1].groupBy(*keys, F.col("_node").alias("_t")).agg(F.max("_v").alias("_v"))
        items.append(materialize(below.withColumn("_node", chunk_start(F.col("_t"), lengths[-1])), "maxima"))
    # one node on top of all
    items[-1] = items[-1].withColumn("_node", F.lit(0).cast("long"))
    top = len(items) - 1

    asked = materialize(queries.select(*keys, *named, F.col(ts).alias("_at"), level.cast("double").alias("_v")), "queries")
    schema = T.StructType([*[asked.schema[c] for c in [*keys, *named, "_at", "_v"]],
                           T.StructField("_node", T.LongType()), T.StructField("_hit", T.LongType())])

    def find(depth, rows):
        both = rows.withColumn("_asks", F.lit(True)).unionByName(
            items[depth].withColumn("_asks", F.lit(False)), allowMissingColumns=True)
        return materialize(fold_groups(both, [*keys, "_node"], ["_t"], _first_reached, schema), "passage")

    def node(depth):
        return F.lit(0).cast("long") if depth == top else chunk_start(F.col("_at"), lengths[depth])

    plain = [*keys, *named, "_at", "_v"]
    waiting, down = asked.filter(F.col("_v").isNotNull()), {}
    for depth in range(top + 1):
        start = F.col("_at") if depth == 0 else chunk_start(F.col("_at"), lengths[depth - 1])
        seen = find(depth, waiting.withColumn("_node", node(depth)).withColumn("_t", start))
        down[depth] = seen.filter(F.col("_hit").isNotNull())
        waiting = seen.filter(F.col("_hit").isNull()).select(*plain)
        if rest is not None and depth < top:  # the node reaches beyond the time allowed
            waiting = waiting.filter(F.col("_at") + rest >= node(depth) + lengths[depth])
    found = down[top]
    for depth in range(top - 1, -1, -1):
        found = find(depth, found.select(*plain, F.col("_hit").alias("_node"), F.lit(NEVER).alias("_t"))).unionByName(down[depth])
    hits = found.select(*keys, *named, F.col("_hit").alias(out))
    if rest is not None:
        hits = found.filter(F.col("_hit") <= F.col("_at") + rest).select(*keys, *named, F.col("_hit").alias(out))
    return queries.join(hits, [*keys, *named], "left")
