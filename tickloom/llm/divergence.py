"""How far sources differ in their words: exact scaled divergences over a quadtree of the count matrix.

Every language has a matrix of its sources (rows) and kept terms (columns); most cells are zero. A
term's price in a group is ``1 + floor(SCALE * (count + 2) / (N + 2 V))``, so all zero cells of a
group have one price, and a pair's value over any stretch of columns that both leave empty is the
number of columns times one number. Only columns that one of them fills are visited.

The matrix is cut into tiles: blocks of 256 sources by a hash class of terms of about 4096 columns.
Each pair of source blocks and class is one group of a grouped map. There the nonzero cells of both
blocks are two K-squared trees (K = 4: a node is the 16 bits of its quadrants, level by level,
children found by rank). All pairs of rows descend both trees at once; a quadrant that is empty in
both ends the descent, and its columns are priced at once from the count of those not visited.

Counting: words are counted per block of texts, then by language, source and term. No row count,
vocabulary or pair list passes through the driver. Pairs of sources are the result itself; they are
formed per pair of source blocks.

Defined results: a null text, language or source is the empty string; a group without words is a
group with price ``1 + floor(2 SCALE / (2 V))`` for every term; a language without kept terms has
value 0 for all pairs and no terms; repeated rows count each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.bytetext import LOWER, blocks, word_spans
from tickloom.llm.registry import documents, query
from tickloom.llm.words import strings, word_ids
from tickloom.session import materialize

SCALE = 1_000_000_000
#: letters and everything beyond ASCII
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
BLOCK = 1 << 22
#: sources of a row block and columns of a tile (about)
SIDE, WIDE = 256, 4096
#: row pairs by column nodes expanded at once
FRONT = 1 << 15


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of every (lang, source, term), counted once per block of texts."""

    def count(batches):
        for batch in batches:
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(
                batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            for low, high, data, offsets in blocks(batch, limit=BLOCK):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, LETTERS)
                if not len(starts):
                    continue
                ids, lead = word_ids(data, starts, ends)
                size = int(ids.max()) + 1
                row = np.repeat(np.arange(high - low), np.diff(first))
                both, times = np.unique(row * size + ids, return_counts=True)
                cell, back = np.unique(group[low:high][both // size] * size + both % size, return_inverse=True)
                words = lead[np.arange(size)]
                terms = strings(data, starts[words], (ends - starts)[words])
                of = pa.array(cell // size)
                yield pa.RecordBatch.from_arrays([
                    langs.take(of), sources.take(of), terms.take(pa.array(cell % size)),
                    pa.array(np.bincount(back, times).astype(np.int64)), pa.array(np.bincount(back).astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"])

    def named(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_cells(counts: DataFrame, least: int) -> DataFrame:
    """Counts of terms that enough documents of the language hold; ``n_lang`` is the language's count.

    ``lead`` is 1 on one row of each (lang, term).
    """
    same = Window.partitionBy("lang", "term")
    return counts.select("*", F.sum("n").over(same).alias("n_lang"), F.sum("docs").over(same).alias("docs_lang"),
                         (F.row_number().over(same.orderBy("source")) == 1).cast("long").alias("lead")) \
        .filter(F.col("docs_lang") >= least).select("lang", "source", "term", "n", "n_lang", "lead")


def price(count: str, total: str) -> F.Column:
    """Price of a term from its count and ``N + 2 V``; decimals, since the product can pass 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(19, 0))) div cast({total} as decimal(20, 0))")


def price_gap(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def group_sizes(docs: DataFrame, cells: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring group: its number within the language, ``total`` (N + 2 V), price of a zero cell, ``terms`` (V)."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                           for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("leads"))
    langs = own.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("leads").alias("terms"))
    numbered = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) \
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    sized = numbered.join(own.drop("leads"), ["lang", "source"], "left").join(langs, "lang", "left") \
        .na.fill(0, ["n", "n_lang", "terms"])
    return sized.select(
        "lang", "source", "number", "sources", "terms", (F.col("n") + 2 * F.col("terms")).alias("total"),
        (F.col("n_lang") + 2 * F.col("terms")).alias("total_lang")).withColumn(
        "zero", F.when(F.col("terms") > 0, price("0L", "total")))


class Tree:
    """K-squared tree (K = 4) of cells: per level the children of every node, -1 where a quadrant is empty."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int):
        path = np.zeros(len(row), np.int64)
        for level in range(height):
            path |= ((row >> 2 * level & 3) << 2 | column >> 2 * level & 3) << 4 * level
        order = np.argsort(path)
        self.value, self.levels = value[order], []
        below = path[order]
        for _ in range(height):
            nodes = np.unique(below >> 4)
            bits = np.zeros((len(nodes), 16), bool)
            bits[np.searchsorted(nodes, below >> 4), below & 15] = True
            # rank: children stand in the order of the set bits
            self.levels.append(np.where(bits, np.cumsum(bits).reshape(bits.shape) - 1, -1))
            below = nodes
        self.levels.reverse()
        self.root = 0 if len(path) else -1

    def children(self, depth: int, node: np.ndarray) -> np.ndarray:
        """(node, row quadrant, column quadrant) -> child or -1."""
        if self.root < 0:
            return np.full((len(node), 4, 4), -1)
        out = self.levels[depth][np.maximum(node, 0)]
        return np.where(node[:, None] < 0, -1, out).reshape(-1, 4, 4)


def joint_sums(a: Tree, b: Tree, zero_a: np.ndarray, zero_b: np.ndarray, height: int, same: bool
               ) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of rows: the sum over columns that one of them fills, and the number of these.

    With ``same`` both trees are one block and only pairs of a smaller with a larger row are formed.
    """
    shape = (len(zero_a), len(zero_b))
    total, visited = np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape[0] * shape[1], np.int64)
    todo = [(0, *(np.array([x]) for x in (a.root, b.root, 0, 0)))] if a.root >= 0 or b.root >= 0 else []
    while todo:
        depth, na, nb, ra, rb = todo.pop()
        if len(na) > FRONT:
            todo.append((depth, na[FRONT:], nb[FRONT:], ra[FRONT:], rb[FRONT:]))
            na, nb, ra, rb = na[:FRONT], nb[:FRONT], ra[:FRONT], rb[:FRONT]
        ca, cb = a.children(depth, na)[:, :, None, :], b.children(depth, nb)[:, None, :, :]
        step = 2 * (height - 1 - depth)
        four = np.arange(4)
        row_a, row_b = (ra[:, None] * 4 + four)[:, :, None], (rb[:, None] * 4 + four)[:, None, :]
        rows = (row_a << step < shape[0]) & (row_b << step < shape[1])
        if same:
            rows = rows & (row_a <= row_b if step else row_a < row_b)
        n, i, j, c = np.nonzero(rows[..., None] & ((ca >= 0) | (cb >= 0)))
        na, nb = ca[n, i, 0, c], cb[n, 0, j, c]
        ra, rb = ra[n] * 4 + i, rb[n] * 4 + j
        if step:
            todo.append((depth + 1, na, nb, ra, rb))
            continue
        p = np.where(na >= 0, a.value[na], zero_a[ra]) if len(a.value) else zero_a[ra]
        q = np.where(nb >= 0, b.value[nb], zero_b[rb]) if len(b.value) else zero_b[rb]
        at = ra * shape[1] + rb
        # sums of one slab stay below 2**53, where floating point adds integers exactly
        total += np.bincount(at, (p - q) ** 2 // (p + q), len(total)).astype(np.int64)
        visited += np.bincount(at, minlength=len(visited))
    return total.reshape(shape), visited.reshape(shape)


def tile_sums(table: pa.Table, side: int) -> pa.Table:
    """One tile: rows with a null term give each group's zero price, the others its filled cells."""
    term = table.column("term").combine_chunks().dictionary_encode()
    if isinstance(term, pa.ChunkedArray):
        term = term.combine_chunks()
    marks = np.asarray(term.is_null())
    column = np.asarray(term.indices.fill_null(0)).astype(np.int64)
    number, p = (np.asarray(table.column(c)).astype(np.int64) for c in ("number", "p"))
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    height = 1
    while 4 ** height < max(side, len(term.dictionary)):
        height += 1
    trees, zeros = [], []
    for block in dict.fromkeys((low, high)):
        here = number // side == block
        zero = np.zeros(int(number[here & marks].max()) - block * side + 1, np.int64)
        zero[number[here & marks] - block * side] = p[here & marks]
        cells = here & ~marks
        trees.append(Tree(number[cells] - block * side, column[cells], p[cells], height))
        zeros.append(zero)
    total, visited = joint_sums(trees[0], trees[-1], zeros[0], zeros[-1], height, low == high)
    i, j = np.nonzero(visited)
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(i + low * side, pa.int32()),
                     "b": pa.array(j + high * side, pa.int32()), "total": total[i, j], "visited": visited[i, j]})


def pair_values(cells: DataFrame, sizes: DataFrame, side: int = SIDE, wide: int = WIDE) -> DataFrame:
    """Value of every pair of sources of a language, in both directions: lang, source, item, value."""
    spread = sizes.filter("terms > 0")
    columns = ["lang", "number", "sources", "terms"]
    filled = cells.join(spread, ["lang", "source"]).select(
        *columns, "term", price("n", "total").alias("p"),
        F.expr(f"pmod(xxhash64(term), terms div {wide} + 1)").alias("tile"))
    marks = spread.select(*columns, F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"),
                          F.explode(F.expr(f"sequence(0L, terms div {wide})")).alias("tile"))

    def paired(rows):
        """Each row once for every block that its own is paired with."""
        return rows.select("*", F.expr(f"number div {side}").alias("own"),
                           F.explode(F.expr(f"sequence(0L, (sources - 1) div {side})")).alias("other")).select(
            "*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    sums = paired(filled.unionByName(marks)).select("lang", "low", "high", "tile", "number", "term", "p") \
        .groupBy("lang", "low", "high", "tile").applyInArrow(
            lambda table: tile_sums(table, side), "lang string, a int, b int, total long, visited long") \
        .groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("visited").alias("visited"))
    sides = paired(sizes).select("lang", "low", "high", "own", "number", "source", "terms", "zero")
    one = sides.filter("own = low").select("lang", "low", "high", "terms", F.col("number").alias("a"),
                                           F.col("source").alias("source_a"), F.col("zero").alias("zero_a"))
    two = sides.filter("own = high").select("lang", "low", "high", F.col("number").alias("b"),
                                            F.col("source").alias("source_b"), F.col("zero").alias("zero_b"))
    pairs = one.join(two, ["lang", "low", "high"]).filter("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.when(F.col("terms") > 0, F.coalesce("total", F.lit(0)) + (
        F.col("terms") - F.coalesce("visited", F.lit(0))) * price_gap("zero_a", "zero_b")).otherwise(0)
    return pairs.select("lang", value.alias("value"), F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x")
    ).select("lang", "x.source", "x.item", "value")


def marked_terms(cells: DataFrame, sizes: DataFrame, most: int | None) -> DataFrame:
    """Terms that a group has more of than its language, ranked; only ranks up to ``most`` (None: all)."""
    priced = cells.join(sizes, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), price("n", "total").alias("p"), price("n_lang", "total_lang").alias("q"))
    found = ranked(priced.filter("p > q").select("lang", "source", "item", price_gap("p", "q").alias("value")))
    return found if most is None else found.filter(F.col("rank") <= most)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                      least: int = 10, most: int | None = 10, side: int = SIDE, wide: int = WIDE) -> DataFrame:
    """Ranked pairs of sources and marked terms: lang, source, part, item, value, rank.

    ``side`` and ``wide`` are the rows and columns of a tile; they change the work only.
    """
    cells = materialize(kept_cells(term_counts(docs, lang, source, text), least), "cells")
    sizes = materialize(group_sizes(docs, cells, lang, source), "sizes")
    return ranked(pair_values(cells, sizes, side, wide)).withColumn("part", F.lit("pair")).unionByName(
        marked_terms(cells, sizes, most).withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")


OP12_SQL = f"""
WITH words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
               coalesce(source, '') AS source FROM documents)),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(l.v, 0) AS v, coalesce(c.n, 0) + 2 * coalesce(l.v, 0) AS total, l.n + 2 * l.v AS total_lang
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
  LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) c USING (lang, source)),
prices AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // g.total AS BIGINT) AS p,
         CAST(1 + {SCALE}::HUGEINT * (k.n + 2) // g.total_lang AS BIGINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b
    ON a.lang = b.lang AND a.source <> b.source AND a.v = 0
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM prices WHERE n > 0 AND p > q),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 10
"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of each language, and the ten terms that mark each source."""
    return source_divergence(documents(spark, sf_dir))
