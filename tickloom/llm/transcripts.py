"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered.

A hidden state is a role and whether the line opens a turn; a line shows its speaker marker (or none),
its length class and whether it asks. So a turn whose marker is missing is found where the roles of the
marked turns around it could not follow each other. Start, transition and emission counts are summed over all labelled transcripts; the
tables have a fixed size. The most likely roles of a transcript's lines are found by the Viterbi
recursion, an opening line and those that go on become a turn, and turns are written in one canonical form.

Conversations are gathered in parts of ``PART_TURNS`` turns; a longer one is decoded part by part.

Defined results: a null text is an empty line; rows without a conversation are transcripts of their own;
rows repeated exactly count once, other rows of one turn follow each other by role and text; a null or
unknown role is not learned from; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.registry import query

ROLES = ["system", "user", "assistant"]
#: fixed values: words that mark a speaker
NAMES = {"system": 0, "instruction": 0, "user": 1, "human": 1, "question": 1, "assistant": 2, "ai": 2,
         "bot": 2, "answer": 2}
MARKER = re.compile(
    r"\s*(?:#+\s*(?P<a>%(n)s)\s*:|\[(?P<b>%(n)s)\]:?|<\|(?P<c>%(n)s)\|>:?|\*\*(?P<d>%(n)s)\*\*:|(?P<e>%(n)s)\s*:)[ \t]*"
    % {"n": "|".join(NAMES)}, re.IGNORECASE)
LENGTHS = [20, 60, 150]
SYMBOLS = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 2
PART_TURNS = 1024
#: state 2 * role opens a turn of the role, the next number goes on with it
STATES = 2 * len(ROLES)


def observed(line: str) -> tuple[int, str]:
    """Symbol of a line and the line without its speaker marker."""
    found = MARKER.match(line)
    speaker = 0
    if found:
        speaker = 1 + NAMES[found[found.lastgroup].lower()]
        line = line[found.end():]
    size = sum(len(line) >= n for n in LENGTHS)
    return (speaker * (len(LENGTHS) + 1) + size) * 2 + line.rstrip().endswith("?"), line


class Model:
    """Log probabilities from counts, with one added to each."""

    def __init__(self, start, move, show):
        log = lambda x: np.log((x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True))
        self.start = log(np.asarray(start, float)).tolist()
        self.move = log(np.asarray(move, float)).tolist()
        self.show = log(np.asarray(show, float)).T.tolist()

    def states(self, symbols: list[int]) -> list[int]:
        """Most likely state of every line (Viterbi); the first state wins ties."""
        if not symbols:
            return []
        states = range(STATES)
        score = [self.start[s] + self.show[symbols[0]][s] for s in states]
        back = []
        for symbol in symbols[1:]:
            show, best, come = self.show[symbol], [], []
            for s in states:
                top, at = -math.inf, 0
                for p in states:
                    value = score[p] + self.move[p][s]
                    if value > top:
                        top, at = value, p
                best.append(top + show[s])
                come.append(at)
            score = best
            back.append(come)
        path = [max(states, key=lambda s: score[s])]
        for come in reversed(back):
            path.append(come[path[-1]])
        return path[::-1]

    def turns(self, text: str) -> list[tuple[str, str]]:
        """Roles and texts of a transcript's turns."""
        seen = [observed(line) for line in text.split("\n")]
        out: list[tuple[int, list[str]]] = []
        for state, (_, line) in zip(self.states([s for s, _ in seen]), seen, strict=True):
            if not out or state % 2 == 0 or out[-1][0] != state // 2:
                out.append((state // 2, []))
            out[-1][1].append(line)
        return [(ROLES[r], "\n".join(lines).strip("\n")) for r, lines in out]


def rendered(turns: list[tuple[str, str]]) -> str:
    """The canonical form of a chat."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def learned(labelled: DataFrame) -> Model:
    """Model from ``text, roles, lines``: a transcript, each turn's role and its number of lines."""

    def count(batches):
        start = np.zeros(STATES, np.int64)
        move = np.zeros((STATES, STATES), np.int64)
        show = np.zeros((STATES, SYMBOLS), np.int64)
        for batch in batches:
            for text, roles, sizes in zip(*[batch.column(c).to_pylist() for c in ("text", "roles", "lines")], strict=True):
                at = [2 * ROLES.index(r) + (k > 0) if r in ROLES else -1
                      for r, n in zip(roles, sizes, strict=True) for k in range(n)]
                symbols = [observed(line)[0] for line in text.split("\n")]
                if at and at[0] >= 0:
                    start[at[0]] += 1
                for k, (state, symbol) in enumerate(zip(at, symbols, strict=True)):
                    if state >= 0:
                        show[state, symbol] += 1
                        if k and at[k - 1] >= 0:
                            move[at[k - 1], state] += 1
        flat = np.concatenate([start, move.ravel(), show.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["cell", "n"])

    cells = labelled.select("text", "roles", "lines").mapInArrow(count, "cell int, n long")
    n = STATES
    flat = np.zeros(n * (1 + n + SYMBOLS), np.int64)
    for cell, total in cells.groupBy("cell").agg(F.sum("n")).collect():  # a fixed number of cells
        flat[cell] = total
    return Model(flat[:n], flat[n:n + n * n].reshape(n, n), flat[n + n * n:].reshape(n, SYMBOLS))


def parsed(transcripts: DataFrame, model: Model) -> DataFrame:
    """Every row of ``transcripts`` (a column ``text``) with ``turns`` and the canonical ``chat``.

    Columns that have these two names already are replaced.
    """
    transcripts = transcripts.drop("turns", "chat")
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def parse(batches):
        for batch in batches:
            turns = [shared.value.turns(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[{"role": r, "text": t} for r, t in x] for x in turns], kind),
                 pa.array([rendered(x) for x in turns], pa.string())], names=[*batch.schema.names, "turns", "chat"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transcripts.schema)
    return transcripts.mapInArrow(parse, schema + ", turns array<struct<role:string,text:string>>, chat string")


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as the plain transcripts that crawls hold: four marker styles, one marker in ten missing.

    ``conv_id, part, text`` with the true ``roles`` and ``lines`` of the turns.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.initcap(F.coalesce("role", F.lit("user")))
    marker = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) == 0, "").when(
        style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(":\n"))).when(
        style == 2, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(F.lit("**"), name, F.lit("**: ")))
    said = rows.withColumn("said", F.concat(marker, F.col("text")))
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return said.groupBy("conv_id", lone.alias("lone"), F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "said"))).alias("all")).select(
        "conv_id", "part", F.array_join(F.transform("all", lambda t: t["said"]), "\n").alias("text"),
        F.transform("all", lambda t: t["role"]).alias("roles"),
        F.transform("all", lambda t: F.size(F.split(t["said"], "\n"))).alias("lines"))


@query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as raw transcripts, parsed back into turns and rendered."""
    raw = raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return parsed(raw, learned(raw)).select(
        "conv_id", "part", F.size("roles").alias("n_turns"), F.array_join("roles", ",", "?").alias("true_roles"),
        F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"), "chat")
