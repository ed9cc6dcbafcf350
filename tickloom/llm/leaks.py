"""Benchmark decontamination: size-partitioned MinHash containment search with exact checks.

Items and documents are sets of five-word shingles (lower-cased ASCII, words of letters, digits
and anything beyond ASCII). A short item inside a long document has a tiny Jaccard similarity, so
documents are searched as half-overlapping windows, one window size per size class of items
(powers of two): an item then fills at least a quarter of some window, however long the document is.
One hash per shingle fills 64 bins with their least value; a window and an item that agree in one
bin are a candidate, and candidates are checked with the shingles themselves, over the whole document.
A neighbour in the same bin can hide the few shingles of a small item, so items of fewer than ``FEW``
different shingles are candidates of every document that has one of them, without bins.

Items are sent to the tasks in blocks of at most ``ITEM_BYTES``; each block is one pass over the
documents, so neither the driver nor a task ever holds more of them, and documents are not shuffled.

Defined results: an item or document of one to four words has its whole sequence as its only
shingle; without words it matches nothing; null texts are empty; repeated documents are judged each,
repeated items reported each; an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytetext import (
    ALNUM, LOWER, blocks, shingle_hashes, text_view, word_hashes, word_spans)
from tickloom.llm.registry import documents, query

WORDS = 5
#: an item is found when at least this many fifths of its shingles occur
FIFTHS = 4
BINS = 64
LEAST_WINDOW = 8
FEW = 8
ITEM_BYTES = 4 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(shingles: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Least hash per bin of every cell; the bin is the hash's top six bits."""
    least = np.full(cells * BINS, NONE)
    np.minimum.at(least, cell * BINS + (shingles >> np.uint64(58)).astype(np.int64), shingles)
    return least.reshape(cells, BINS)


def row_shingles(text: bytes, starts, ends) -> list[bytes]:
    words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    if len(words) < WORDS:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)]


class Items:
    """A block of items: per window size the sorted bin minima and the item each belongs to.

    Of small items all shingle hashes are kept instead, sorted, with their items.
    """

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, offsets = text_view(pa.array(texts, pa.string()))
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        hashes, begin = shingle_hashes(word_hashes(data, starts, ends), first, WORDS)
        raw = data.tobytes()
        self.ids = ids
        self.shingles = [list(dict.fromkeys(row_shingles(raw, starts[a:b], ends[a:b])))
                         for a, b in zip(first[:-1], first[1:], strict=True)]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.diff(begin)
        least = bin_minima(hashes, np.repeat(np.arange(len(ids)), sizes), len(ids))
        window = np.maximum(LEAST_WINDOW, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        small = np.array([0 < len(s) < FEW for s in self.shingles], bool)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.flatnonzero(small[owner])
        order = order[np.argsort(hashes[order], kind="stable")]
        self.few = hashes[order], owner[order]
        for size in np.unique(window[(sizes > 0) & ~small]):
            own = np.flatnonzero((window == size) & (sizes > 0) & ~small)
            keys, item = least[own].ravel(), np.repeat(own, BINS)
            order = np.argsort(keys[keys != NONE], kind="stable")
            self.classes[int(size)] = keys[keys != NONE][order], item[keys != NONE][order]

    def candidates(self, hashes: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that agree in a bin of some window, or in a shingle of a small item."""
        sizes = np.diff(begin)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(hashes)) - begin[row]
        found: set[tuple[int, int]] = set()
        keys, item = self.few
        if len(keys):
            low = np.searchsorted(keys, hashes)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes)
            for r, at in np.unique(np.stack([row[hit], low[hit]], axis=1), axis=0):
                for i in item[at:np.searchsorted(keys, keys[at], side="right")]:
                    found.add((int(r), int(i)))
        for size, (keys, item) in self.classes.items():
            parts = -(-sizes // size)
            base = np.concatenate(([0], np.cumsum(parts)))
            least = bin_minima(hashes, base[row] + place // size, int(base[-1]))
            owner = np.repeat(np.arange(len(sizes)), parts)
            beside = np.flatnonzero(owner[1:] == owner[:-1])
            least[beside] = np.minimum(least[beside], least[beside + 1])
            low = np.searchsorted(keys, least)
            hit = np.argwhere(keys[np.minimum(low, len(keys) - 1)] == least)
            for part, column in hit:
                key = least[part, column]
                for at in range(low[part, column], np.searchsorted(keys, key, side="right")):
                    found.add((int(owner[part]), int(item[at])))
        return found

    def matches(self, batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, int]]:
        """(row of the batch, item, shared shingles) of every item that is contained."""
        for low, _, data, offsets in blocks(batch, text):
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, ALNUM)
            hashes, begin = shingle_hashes(word_hashes(data, starts, ends), first, WORDS)
            row, have, raw = -1, set(), data.tobytes()
            for r, item in sorted(self.candidates(hashes, begin)):
                if r != row:
                    a, b = first[r], first[r + 1]
                    row, have = r, set(row_shingles(raw, starts[a:b], ends[a:b]))
                shared = sum(s in have for s in self.shingles[item])
                if 5 * shared >= FIFTHS * len(self.shingles[item]):
                    yield low + r, item, shared


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = ITEM_BYTES
                ) -> Iterator[Items]:
    """The items in blocks of bounded bytes; at most two blocks are on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(key).cast("long"), F.col(text)).toLocalIterator():
        if texts and size + len(r[1] or "") > limit:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
    if texts:
        yield Items(ids, texts)


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and contained item: ``doc_id, item_id, n_shingles, n_shared``."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"
    kind = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_shingles", "n_shared")])
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            for batch in batches:
                hits = list(shared.value.matches(batch, "text"))
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([r for r, _, _ in hits], pa.int64())),
                    pa.array([shared.value.ids[i] for _, i, _ in hits], pa.int64()),
                    pa.array([len(shared.value.shingles[i]) for _, i, _ in hits], pa.int64()),
                    pa.array([n for _, _, n in hits], pa.int64())], schema=kind)

        found = found.unionByName(slim.mapInArrow(search, schema))
    return found


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no item, with their own columns."""
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[r for r, _, _ in shared.value.matches(batch, text)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


OP1_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, row_number() OVER (), regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, r, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM shingles WHERE kind = 1 GROUP BY r)
SELECT d.id AS doc_id, b.id AS item_id, max(z.n) AS n_shingles, count(*) AS n_shared,
  count(*) / max(z.n) AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN sizes z ON z.r = b.r
GROUP BY d.id, d.r, b.id, b.r HAVING 5 * count(*) >= 4 * max(z.n)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    found = contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
