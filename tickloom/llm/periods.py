"""Periodic stretches of words by recursive frequency splitting, and texts with them folded.

A run is a stretch of consecutive words with smallest period q, at least ``times`` periods and
``least`` words long, that no neighbouring word extends. Every word of a run stands in it at least
``times`` times. So a word that stands less often in a segment cannot join a run inside it: it splits
the segment, the parts are counted again, and so on until nothing splits. Surviving segments are
scanned lag by lag: a run of period q holds three equal neighbouring blocks among the blocks that
start at multiples of q, which makes about m ln m comparisons for a segment of m words. Blocks are
compared by their first words and then by hashes; the run around a hit is found by binary search on
prefix hashes and confirmed word by word. Words themselves are compared by their bytes.

Documents are independent: nothing is shuffled. A block of texts takes memory in proportion to its
bytes, a longer text is a block of its own. Splitting takes a pass over a segment only as long as it
changes.

Defined results: a null, empty or blank text has no words, no runs and the empty text; repeated rows
and rows of one id are each treated by themselves; a null key stays null; an empty table gives no
rows; columns other than key and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytetext import SPACES, blocks, mixed, powers, word_spans
from tickloom.llm.registry import documents, query
from tickloom.llm.words import gathered, ranges, strings, word_ids

#: (lag, block) comparisons made at once
SLAB = 1 << 20


def split_segments(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: int, least: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Segments left when every word that is too rare within its own has split it, to stability."""
    stable = []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        at, owner = ranges(starts, ends - starts)
        _, inverse, counts = np.unique(owner * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= times
        whole = np.bincount(owner, ~often, minlength=len(starts)) == 0
        stable.append((starts[whole], ends[whole]))
        often &= ~whole[owner]
        edge = np.concatenate(([True], owner[1:] != owner[:-1]))
        begins = often & (edge | ~np.concatenate(([False], often[:-1])))
        closes = often & np.concatenate((edge[1:] | ~often[1:], [True]))
        starts, ends = at[begins], at[closes] + 1
    if not stable:
        return starts, ends
    starts, ends = (np.concatenate(x) for x in zip(*stable, strict=True))
    order = np.argsort(starts)
    return starts[order], ends[order]


class Hashes:
    """Hashes of stretches of words, the same wherever they stand."""

    def __init__(self, ids: np.ndarray):
        up, self.down = powers(len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        one = (self.total[a + size] - self.total[a]) * self.down[a]
        return one == (self.total[b + size] - self.total[b]) * self.down[b]


def longest(fits, most: np.ndarray) -> np.ndarray:
    """Greatest size up to ``most`` that fits, where all smaller ones fit too."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        ok = fits(middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    return low


def scanned_lags(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows (start, end, period): stretches that look like runs, the smallest period of each."""
    hashes, found = Hashes(ids), []
    lag, segment = ranges(np.ones(len(starts), np.int64), (ends - starts) // times)
    blocks_of = (ends - starts)[segment] // lag - 2
    upto = np.cumsum(blocks_of)
    low = 0
    while low < len(lag):
        high = max(int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SLAB, side="right")), low + 1)
        at, owner = ranges(np.zeros(high - low, np.int64), blocks_of[low:high])
        q, seg = lag[low:high][owner], segment[low:high][owner]
        at = starts[seg] + at * q
        hit = np.flatnonzero((ids[at] == ids[at + q]) & (ids[at + q] == ids[at + 2 * q]))
        at, q, seg = at[hit], q[hit], seg[hit]
        hit = hashes.same(at, at + q, q) & hashes.same(at + q, at + 2 * q, q)
        at, q, seg = at[hit], q[hit], seg[hit]
        # neighbouring hits of one lag stand in one stretch
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] - at[:-1] != q[1:]) | (q[1:] != q[:-1]) | (seg[1:] != seg[:-1])
        at, q, seg = at[new], q[new], seg[new]
        right = longest(lambda n, a=at, p=q: hashes.same(a, a + p, n), ends[seg] - at - q)
        left = longest(lambda n, a=at, p=q: hashes.same(a - n, a - n + p, n), at - starts[seg])
        found.append(np.stack([at - left, at + q + right, q], 1))
        low = high
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    size = found[:, 1] - found[:, 0]
    found = found[size >= np.maximum(least, times * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[first]


def plain_runs(ids: np.ndarray, start: int, end: int, times: int, least: int) -> np.ndarray:
    """Runs of one segment by comparing all words at every lag."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, (end - start) // times + 1):
        differ = np.flatnonzero(ids[start:end - q] != ids[start + q:end])
        cuts = np.concatenate(([-1], differ, [end - start - q]))
        for a, b in zip(cuts[:-1] + 1, cuts[1:], strict=True):
            if b - a + q >= max(least, times * q):
                found.setdefault((start + int(a), start + int(b) + q), q)
    return np.array([(s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, first: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and then period; words never pass their row."""
    starts, ends = split_segments(ids, first[:-1], first[1:], times, least)
    runs = scanned_lags(ids, starts, ends, times, least)
    at, owner = ranges(runs[:, 0], runs[:, 1] - runs[:, 0] - runs[:, 2])
    wrong = owner[ids[at] != ids[at + runs[owner, 2]]]
    if len(wrong):  # equal hashes of unequal stretches: those segments again without hashes
        again = np.unique(np.searchsorted(starts, runs[wrong, 0], side="right") - 1)
        runs = np.concatenate([runs[~np.isin(np.searchsorted(starts, runs[:, 0], side="right") - 1, again)]] + [
            plain_runs(ids, int(starts[s]), int(ends[s]), times, least) for s in again])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretched(key: int | None, n: int) -> np.ndarray:
    """Which of ``n`` words stands at every place: one key in ten repeats a part of its words."""
    at = np.arange(n)
    if key is None or n == 0:
        return at
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % p, at)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 4, least: int = 6,
                  places=None) -> DataFrame:
    """Per row its key, number of words, ``runs`` and the text ``collapsed``.

    ``runs`` has start (word number), length and period, by start and then period. ``collapsed`` has
    the words that no run holds after its first period, with one space between. ``places(key, n)``
    may name the word to be taken at each of the ``n`` places instead of the text's own.
    """
    if not 3 < times <= least:
        raise ValueError("a run has at least four periods, and at least as many words")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches):
        for batch in batches:
            for low, high, data, offsets in blocks(batch):
                starts, ends, first = word_spans(data, offsets, ~SPACES)
                keys = batch.column("doc_id")[low:high]
                taken = np.arange(len(starts))
                if places is not None:
                    for r, k in enumerate(keys.to_pylist()):
                        taken[first[r]:first[r + 1]] = first[r] + places(k, int(first[r + 1] - first[r]))
                ids, _ = word_ids(data, starts, ends)
                runs = find_runs(ids[taken], first, times, least)
                cover = np.zeros(len(taken) + 1, np.int64)
                np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
                np.add.at(cover, runs[:, 1], -1)
                kept = np.cumsum(cover)[:-1] == 0
                taken = taken[kept]
                sizes = ends[taken] - starts[taken]
                # every word with a space after it; each row's last space is left out again
                glued = gathered(data, starts[taken], sizes, b" ")
                upto = np.concatenate(([0], np.cumsum(sizes + 1)))[np.concatenate(([0], np.cumsum(kept)))[first]]
                owner = np.searchsorted(first, runs[:, 0], side="right") - 1
                lists = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=high - low))))
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(c) for c in (runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2])],
                        fields=list(run))),
                    strings(glued, upto[:-1], np.maximum(np.diff(upto) - 1, 0))],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scan, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: str = "runs") -> F.Column:
    """The run with the greatest length in periods (ties: smallest start, then period), or null."""
    return F.expr(f"""aggregate({runs}, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, x) ->
        if(a is null or x.length * a.period > a.length * x.period, x, a))""")


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them stretched, and digests of runs and collapsed texts."""
    found = periodic_runs(documents(spark, sf_dir), places=stretched)
    lines = F.expr("array_join(transform(runs, x -> concat_ws(',', x.start, x.length, x.period) || '\\n'), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), strongest().alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
