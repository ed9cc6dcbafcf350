"""N-gram Jaccard join: links between shingle sets, by set-relation skipping.

Documents link when ``100 * intersection >= percent * union`` of their word shingles (90 % of three
words by default). Equal sets are
one class. Shingles are ordered rare first by a sketch of counts over the whole corpus, and only the
first shingles of a set, its prefix, are indexed: two sets that link share one of them.

*Index skipping.* A list holds, per set, its size and the shingle's position. An entry whose position
leaves too few shingles for any partner of its size, and pairs whose positions leave too few for
each other, are skipped by join conditions before any text is read.

*Answer skipping.* In a list every set is first compared with one pivot only, the set with the
fewest rarer shingles. The exact differences to the pivot give most other answers: sets within reach
of the pivot together are in one component, and sets whose distances to the pivot differ by more
than a link allows cannot link. Only pairs of one list that are still in different components and
that the pivot cannot decide are compared themselves. So a group of copies costs one comparison
per set, not one per pair.

Before texts are read for a comparison, the parities of both sets' shingles in a small bit field bound
their difference from below; pairs beyond what a link allows need no text.

Defined results: a text of one or two words has its whole sequence as its only shingle; without words
(or null) a set is empty and links with nothing; equal sets link; rows of one id are compared each by its
own text and all get the smallest id that any of them reaches; rows without an id link like others, and
a component without any id has none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.bytetext import LOWER, SPACES, blocks, shingle_hashes, word_hashes, word_spans
from tickloom.llm.registry import documents, query
from tickloom.session import materialize

WORDS = 3
PERCENT = 90
SKETCH = 1 << 18
SKETCH_PARTS = 64


def row_sets(batch: pa.RecordBatch, text: str, k: int):
    """Distinct shingle hashes of every row, sorted."""
    for _, _, data, offsets in blocks(batch, text):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ~SPACES)
        hashes, begin = shingle_hashes(word_hashes(data, starts, ends), first, k)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            own = np.sort(hashes[a:b])
            yield own[np.append(True, own[1:] != own[:-1])] if b > a else own


def shingle_sketch(docs: DataFrame, text: str = "text", k: int = WORDS) -> np.ndarray:
    """Rarity of every shingle hash class: a fine logarithm of the number of texts that hold one."""

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            held, size = [], 0
            for own in row_sets(batch, "text", k):
                held.append(own)
                size += len(own)
                if size > SKETCH:
                    total += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                    held, size = [], 0
            if held:
                total += np.bincount((np.concatenate(held) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        parts = total.reshape(SKETCH_PARTS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["part", "counts"])

    def merge(pdf):
        total = sum(np.frombuffer(raw, np.int64) for raw in pdf["counts"])
        pdf = pdf.iloc[:1].copy()
        pdf["counts"] = [total.tobytes()]
        return pdf

    schema = "part int, counts binary"
    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    merged = rows.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(64)).alias("near")).applyInPandas(
        lambda pdf: merge(pdf)[["part", "counts"]], schema).groupBy("part").applyInPandas(
        lambda pdf: merge(pdf)[["part", "counts"]], schema)
    parts = {r.part: np.frombuffer(r.counts, np.int64) for r in merged.collect()}  # SKETCH numbers at any size
    counts = np.concatenate([parts[p] for p in range(SKETCH_PARTS)]) if parts else np.zeros(SKETCH, np.int64)
    return np.minimum(255, np.floor(6 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def ordered(own: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose order is rare first: eight bits of rarity, 56 of hash."""
    level = rarity[(own % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (own >> np.uint64(8)))


def prefix_length(n: int, percent: int) -> int:
    """Shingles to index: any partner of a link shares one of the first so many."""
    least = -(-percent * n // 100)  # smallest overlap of a link of a set of n
    return n - least + 1 if n else 0


def parities(own: np.ndarray) -> bytes:
    """For each of at least ``2 n`` places, whether an odd number of shingles falls there."""
    size = 64
    while size < 2 * len(own):
        size *= 2
    return np.packbits(np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """No two sets with these parities differ in fewer shingles; a longer field is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def bounded(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """``pairs`` with ``low``, a lower bound of their difference, from ``fields`` (id, bits)."""
    both = pairs.join(fields.toDF("a", "__x"), "a").join(fields.toDF("b", "__y"), "b")
    names = pairs.columns

    def bound(batches):
        for batch in batches:
            low = [least_difference(x, y) for x, y in
                   zip(batch.column("__x").to_pylist(), batch.column("__y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(low, pa.int64())],
                                             names=[*names, "low"])

    return both.select(*names, "__x", "__y").mapInArrow(bound, ", ".join(f"{c} long" for c in [*names, "low"]))


def row_marks(key: str, text: str) -> list[F.Column]:
    """128 bits that tell rows of different ids or texts apart, so that a chosen row's text can be found again."""
    own = F.col(key).cast("long")
    return [F.xxhash64(own, F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text), own).alias("t2")]


def set_rows(docs: DataFrame, rarity, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Size, two fingerprints and the prefix of every document's set."""

    def rows(batches):
        for batch in batches:
            sizes, fp1, fp2, prefix, bits = [], [], [], [], []
            for own in row_sets(batch, "text", k):
                tokens = ordered(own, rarity.value)
                sizes.append(len(own))
                fp1.append(int(np.sum(own, dtype=np.uint64)))
                fp2.append(int(np.bitwise_xor.reduce(own * np.uint64(0x9E3779B97F4A7C15) ^ (own >> np.uint64(29)),
                                                     initial=np.uint64(0))))
                prefix.append(tokens[:prefix_length(len(own), percent)].view(np.int64))
                bits.append(parities(own))
            lengths = np.cumsum([0, *map(len, prefix)])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("doc_id", "t1", "t2")], pa.array(sizes, pa.int64()),
                pa.array(np.array(fp1, np.uint64).view(np.int64)), pa.array(np.array(fp2, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(bits, pa.binary())],
                names=["doc_id", "t1", "t2", "n", "fp1", "fp2", "prefix", "bits"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *row_marks(key, text)).mapInArrow(
        rows, "doc_id long, t1 long, t2 long, n long, fp1 long, fp2 long, prefix array<long>, bits binary")


def allowed(n: str, m: str, percent: int) -> str:
    """Largest symmetric difference with which sets of these sizes link."""
    return f"(({n}) + ({m})) * {100 - percent} div {100 + percent}"


def compared(pairs: DataFrame, marks: DataFrame, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``a, b`` with ``distance``, the exact symmetric difference of their sets; ``marks`` names each class's row."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    ids = materialize(ids.join(marks, "id"), "ids")
    # the ids alone are few bytes, so the texts of all other rows are often dropped without being moved
    own = materialize(ids.select(F.coalesce("doc_id", F.lit(-1)).alias("own")).distinct(), "own")
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("own"), *row_marks(key, text),
                        F.col(text).alias("text")).join(own, "own", "left_semi")
    wanted = materialize(texts.join(ids, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("id", "text"), "wanted")
    both = pairs.join(wanted.toDF("a", "ta"), "a").join(wanted.toDF("b", "tb"), "b")

    def measure(batches):
        for batch in batches:
            left = list(row_sets(batch, "ta", k))
            apart = [len(np.setxor1d(x, y, assume_unique=True)) for x, y in
                     zip(left, row_sets(batch, "tb", k), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(apart, pa.int64())], names=["a", "b", "distance"])

    return both.select("a", "b", "ta", "tb").mapInArrow(measure, "a long, b long, distance long")


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that has a link.

    Every round each id takes the smallest label among itself, its neighbours and its label's label,
    so chains halve; a round is written to the shared folder before the next.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(
        F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        better = materialize(
            labels.join(near, "id").join(jump, "component", "left").select(
                "id", F.least("component", "near", "jump").alias("component"),
                (F.least("component", "near", "jump") < F.col("component")).alias("changed")), "labels")
        if better.filter("changed").isEmpty():
            return better.select("id", "component")
        labels = better.select("id", "component")


def shared_ids(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: classes that hold rows of one id, so that an id reaches what any of its rows reaches."""
    kind = F.struct("n", "fp1", "fp2")
    several = sets.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min(kind).alias("low"), F.max(kind).alias("high")).filter("low <> high").select("doc_id")
    held = materialize(sets.filter("n > 0").join(several, "doc_id").join(classes, ["n", "fp1", "fp2"]).select(
        "doc_id", "id").distinct(), "held")
    lead = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return held.join(lead, "doc_id").filter("id <> a").select("a", F.col("id").alias("b"))


def class_rows(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The chosen row of every class that can link with another one.

    Copies go by all keys of the join, which tell classes apart as ``id`` does, so the rows with their prefixes
    are moved once.
    """
    # of smaller sets only equal ones link
    return sets.filter(f"n * {100 - percent} >= {percent}").join(classes, ["n", "fp1", "fp2"]).filter(
        "t1 = chosen.t1 and t2 = chosen.t2").dropDuplicates(["n", "fp1", "fp2", "t1", "t2"]).select(
        "id", "n", "prefix", "bits", "t1", "t2", "chosen.doc_id")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(shingle_sketch(docs, text, k))
    sets = materialize(set_rows(docs, rarity, key, text, k, percent), "sets")
    classes = materialize(sets.filter("n > 0").groupBy("n", "fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("t1", "t2", "doc_id")).alias("chosen")).withColumn(
        "id", F.monotonically_increasing_id()), "classes")
    unique = materialize(class_rows(sets, classes, percent), "unique")
    fields, marks = unique.select("id", "bits"), unique.select("id", "t1", "t2", "doc_id")
    token = Window.partitionBy("token")
    entries = unique.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = materialize(entries.withColumn("size", F.count("*").over(token)).filter("size > 1").withColumn(
        "pivot", F.min(F.struct("pos", "id", "n")).over(token)).drop("size"), "lists")
    # the first shared shingle bounds the overlap best
    room = F.expr("least(n - pos, pivot.n - pivot.pos)")
    near = f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na and {100 + percent} * room >= {percent} * (na + nb)"
    stars = lists.filter("id <> pivot.id").groupBy(
        F.col("pivot.id").alias("a"), F.col("id").alias("b"), F.col("pivot.n").alias("na"), F.col("n").alias("nb")
    ).agg(F.max(room).cast("long").alias("room"))
    close = materialize(bounded(stars.filter(near), fields), "close")
    todo = close.filter(f"low <= {allowed('na', 'nb', percent)}")
    measured = materialize(todo.join(compared(todo.select("a", "b"), marks, docs, key, text, k), ["a", "b"]), "measured")
    links = materialize(measured.filter(f"distance <= {allowed('na', 'nb', percent)}").select("a", "b"), "links")
    first = components(links)
    # pairs of a list that are still apart and that their distances to the pivot leave open
    answers = close.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "low").join(
        measured.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "distance"), ["pivot", "id"], "left")
    known = lists.select("token", "id", "n", "pos", F.col("pivot.id").alias("pivot")).filter("id <> pivot").join(
        answers, ["pivot", "id"], "left").join(first, "id", "left").select(
        "token", "id", "n", "pos", F.coalesce("distance", "low", F.lit(0)).alias("low"), F.col("distance").alias("high"),
        F.coalesce("component", "id").alias("component"))
    split = materialize(known.withColumn("lowest", F.min("component").over(token)).withColumn(
        "highest", F.max("component").over(token)).filter("lowest <> highest").drop("lowest", "highest"), "open")
    x, y = split.alias("x"), split.alias("y")
    reach = allowed("x.n", "y.n", percent)
    open_pairs = materialize(x.join(y, F.expr(
        "x.token = y.token and x.id < y.id and x.component <> y.component"
        f" and 100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
        f" and {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"
        f" and coalesce(x.low - y.high <= {reach}, true) and coalesce(y.low - x.high <= {reach}, true)")).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct(),
        "pairs")
    done = close.select("a", "b").union(close.select("b", "a"))
    rest = materialize(bounded(open_pairs.join(done, ["a", "b"], "left_anti"), fields).filter(
        f"low <= {allowed('na', 'nb', percent)}"), "rest")
    more = rest.join(compared(rest.select("a", "b"), marks, docs, key, text, k), ["a", "b"]).filter(
        f"distance <= {allowed('na', 'nb', percent)}").select("a", "b")
    final = components(materialize(links.union(more).union(shared_ids(sets, classes)), "links"))
    grouped = classes.join(final, "id", "left").select("n", "fp1", "fp2", "rep", F.coalesce("component", "id").alias("component"))
    named = grouped.join(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(
        "n", "fp1", "fp2", "component_id")
    return sets.join(named, ["n", "fp1", "fp2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS,
                  percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of every group, with its own columns.

    Decided by id: all rows of a kept id stay, whatever their text, and rows without an id stay together
    where one of them has a group without ids.
    """
    groups = jaccard_components(docs, key, text, k, percent)
    keep = groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(keep.withColumnRenamed("doc_id", "__keep"),
                     docs[key].cast("long").eqNullSafe(F.col("__keep")), "left_semi")


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)),
    lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(x.n) + max(y.n) - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes z USING (doc_id) GROUP BY d.doc_id
"""


@query("op7_ngram_join", OP7_SQL)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link components of all documents."""
    return jaccard_components(documents(spark, sf_dir))
