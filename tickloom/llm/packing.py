"""Packing token sequences by minimum bin slack.

Documents are cut at multiples of the window; whole windows need no partner. What is left of each
document is one of fewer than ``window`` lengths, so the plan works on a table of counts per length
and costs the same at any size: the longest length left opens a window, a subset-sum over a bit set
finds the multiset of other lengths that comes closest to the capacity, the counts are traced back,
and the window is repeated as often as the counts allow. A window whose sum is a power of two is not
padded, so it wastes nothing either.

Pieces then look up their window by (length, rank); ranks are counted in small groups and shifted by
the counts of the groups before, so no task orders a whole length.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; null ids
stay null; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.registry import documents, query
from tickloom.session import materialize

WINDOW = 1024
END = 0
#: pieces that share a rank counter
GROUP_ROWS = 100_000


def waste(total: int, window: int) -> int:
    """Padding of a sequence of ``total`` tokens."""
    return 0 if total & (total - 1) == 0 else window - total


def best_fill(first: int, lengths: list[int], counts: dict[int, int], window: int) -> dict[int, int]:
    """Counts of the lengths that, beside ``first``, leave the least padding; larger sums win ties."""
    mask = (1 << (window - first + 1)) - 1
    reach, seen = 1, [1]
    for n in lengths:
        left, step = min(counts[n] - (n == first), (window - first) // n), 1
        while left > 0:  # counts in powers of two reach every multiple
            take = min(step, left)
            reach |= reach << (take * n)
            left -= take
            step *= 2
        reach &= mask
        seen.append(reach)
    total = window - first
    while not reach >> total & 1:
        total -= 1
    if waste(first + total, window):
        for power in range(window.bit_length() - 1, -1, -1):
            if (1 << power) >= first and reach >> ((1 << power) - first) & 1:
                total = (1 << power) - first
                break
    used: dict[int, int] = {first: 1}
    for n, before in zip(reversed(lengths), reversed(seen[:-1]), strict=True):
        took = 0
        while not before >> total & 1:
            total -= n
            took += 1
        if took:
            used[n] = used.get(n, 0) + took
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Windows as (count per length, repetitions) that use up ``counts``."""
    counts, out = {n: c for n, c in counts.items() if c > 0}, []
    while counts:
        lengths = sorted(counts, reverse=True)
        used = best_fill(lengths[0], lengths, counts, window)
        times = min(counts[n] // u for n, u in used.items())
        out.append((used, times))
        for n, u in used.items():
            counts[n] -= u * times
            if not counts[n]:
                del counts[n]
    return out


def places(windows: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per window, first sequence, first offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for per, times in windows:
        at = 0
        for n in sorted(per, reverse=True):
            rows.append((n, used.get(n, 0), per[n], sequence, at))
            used[n] = used.get(n, 0) + per[n] * times
            at += per[n] * n
        sequence += times
    return np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)


def byte_bpe(ranks_file: str, pattern: str, special: dict[str, int]) -> Callable[[str], np.ndarray]:
    """Encoder of a byte-level vocabulary; special strings in a text become their ids."""
    import base64

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: code.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], key: str = "doc_id",
           text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Every document's pieces: ids of the text and the end id, cut at multiples of ``window``."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ready: list = []

    def cut(batches):
        if not ready:
            ready.append(encoder())
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(ready[0](body.as_py() or ""), end).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    for column, value in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)),
                                             strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (a written table of pieces) with ``sequence_id`` and ``offset``."""
    total = cut.count()
    groups = max(1, -(-total // GROUP_ROWS))
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    counts = materialize(dealt.groupBy("length", "__group").agg(F.count("*").alias("__n")), "lengths")
    per_length = {n: c for n, c in counts.groupBy("length").agg(F.sum("__n")).collect()}
    per_length.pop(window, None)  # whole windows come after the mixed ones
    windows = plan(per_length, window)
    table = places(windows)
    rest = sum(times for _, times in windows)
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    shifted = counts.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__group").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1).join(
        shifted, ["length", "__group"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    keys = (table[:, 0] << 44) | table[:, 1]
    shared = cut.sparkSession.sparkContext.broadcast((keys, table))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def placed(batches):
        keys, table = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            full = length == window
            at = np.maximum(np.searchsorted(keys, (length << 44) | rank, side="right") - 1, 0)
            if len(table):
                row = table[at]
                step = rank - row[:, 1]
                sequence = np.where(full, rest + rank, row[:, 3] + step // row[:, 2])
                offset = np.where(full, 0, row[:, 4] + step % row[:, 2] * length)
            else:
                sequence, offset = rest + rank, np.zeros_like(rank)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(
        placed, ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"]))


def gpt_style_encoder():
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                    {"<|endoftext|>": 50256})


def pack_documents(docs: DataFrame) -> DataFrame:
    """All documents in windows of 1024 tokens of the 50k byte-level vocabulary."""
    return packed(materialize(pieces(docs, gpt_style_encoder), "pieces"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return pack_documents(documents(spark, sf_dir))
