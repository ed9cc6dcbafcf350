"""Token counts by a compiled finite-state tokenizer.

The vocabulary's pair merging is compiled, as texts need it, into a deterministic transducer: a
state holds the longest suffix read that some piece still continues, the last token at each of its
places and the counts there; a transition carries the change of the token count. Compiled
transitions over whole words are kept as well, up to a fixed number.

A run of spaces starts a new word, and no piece holds a space after another character, so every
transition into such a run leads to one state. A chunk of text is therefore a small map: the text
up to its first word start, which depends on the state it is entered in, a count, and the state it
leaves. Maps compose associatively, so chunks are counted apart and joined by a prefix scan.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each;
null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.registry import documents, query
from tickloom.session import materialize

CHUNK_CHARS = 32_768
MOST_STATES = 300_000
MOST_WORDS = 400_000
WORD = re.compile(" *[^ ]+| +")
FIRST_SPACE = re.compile("(?<=[^ ]) ")


class Words(dict):
    """Token count of words read from the root, worked out on first use."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.run(self.machine.root, word)[1]
        if len(self) < MOST_WORDS and len(word) <= 48:
            self[word] = n
        return n


class Transducer:
    """Counts the tokens that merging adjacent symbols, best piece first, leaves of a text."""

    def __init__(self, pieces: dict[str, float]):
        self.score = pieces
        self.longest = max(map(len, pieces), default=1)
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.sound = {p for p in pieces if len(p) == 1 or self.merged(p) == [p]}
        self.fits = lru_cache(1 << 17)(self._fits)
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.words = Words(self)
        self.root = self.state(("", ("",), (0,)))

    def state(self, key: tuple) -> int:
        """Number of a state (suffix, last tokens, counts relative to the end)."""
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return at

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by the merge rule itself: best score, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[m], -i) for i in range(len(parts) - 1)
                        if (m := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens that merge into a piece last; None for a single character."""
        if piece not in self.split:
            parts = list(piece)
            while len(parts) > 2:
                best = max((self.score[m], -i) for i in range(len(parts) - 1)
                           if (m := parts[i] + parts[i + 1]) in self.score)
                i = -best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.split[piece] = tuple(parts) if len(parts) == 2 else None
        return self.split[piece]

    def _fits(self, left: str, right: str) -> bool:
        """Do the two tokens stay apart side by side?

        Undo their merges, latest first: at no time may the tokens that touch have formed a piece
        that comes before the merge that took them away (of equal ones, the left merge comes first).
        """
        if not left:
            return True
        early, score = float("inf"), self.score
        limit, strict = -early, False
        while True:
            across = score.get(left + right)
            if across is not None and (across > limit or across == limit and not strict):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            made_left = score[left] if a else early
            made_right = score[right] if b else early
            if made_left < made_right or made_left == made_right and b is None:
                limit, strict, left = made_left, True, a[1]
            else:
                limit, strict, right = made_right, False, b[0]

    def compiled(self, at: int, c: str) -> tuple[int, int]:
        """Work out the transition of a state on a character and keep it."""
        suffix, tokens, counts = self.states[at]
        grown = suffix + c
        for size in range(min(len(grown), self.longest), 0, -1):
            token, before = grown[-size:], len(grown) - size
            if (size == 1 or token in self.sound) and self.fits(tokens[before], token):
                break
        worth = 1 if token in self.score else len(token.encode("utf-8", "surrogatepass"))
        change = counts[before] + worth
        keep = 0
        while grown[keep:] and grown[keep:] not in self.prefixes:
            keep += 1
        tokens = (*tokens[keep:], token)
        counts = (*[n - change for n in counts[keep:]], 0)
        move = self.moves[at][c] = self.state((grown[keep:], tokens, counts)), change
        return move

    def run(self, at: int, text: str) -> tuple[int, int]:
        """State and token count after reading ``text`` from a state."""
        total, moves = 0, self.moves
        for c in text:
            move = moves[at].get(c)
            if move is None:
                move = self.compiled(at, c)
            at, change = move
            total += change
        return at, total

    def count(self, words: list[str]) -> int:
        """Tokens of whole words, each read from the root."""
        return sum(map(self.words.__getitem__, words))

    def chunk_map(self, text: str, first: bool) -> tuple[str, bool, int, list]:
        """What a chunk does: text before its first word start, whether it has one, count, last state.

        The first chunk of a text starts a word by itself.
        """
        if len(self.states) > MOST_STATES:
            self._clear()
        head = ""
        if not first:
            start = 0 if text[:1] == " " else None
            found = FIRST_SPACE.search(text)
            cut = found.start() if found else None
            if start is not None:  # a leading run of spaces may continue one of the chunk before
                lead = WORD.match(text).end()
                cut = lead if lead < len(text) else None
            if cut is None:
                return text, False, 0, ["", [""], [0]]
            head, text = text[:cut], text[cut:]
        words = WORD.findall(text)
        at, last = self.run(self.root, words[-1]) if words else (self.root, 0)
        suffix, tokens, counts = self.states[at]
        return head, True, self.count(words[:-1]) + last, [suffix, list(tokens), list(counts)]

    def joined(self, a: tuple, b: tuple) -> tuple:
        """The map of one chunk followed by another; associative."""
        if not a[1]:
            return a[0] + b[0], b[1], b[2], b[3]
        suffix, tokens, counts = a[3]
        at, change = self.run(self.state((suffix, tuple(tokens), tuple(counts))), b[0])
        if b[1]:
            return a[0], True, a[2] + change + b[2], b[3]
        suffix, tokens, counts = self.states[at]
        return a[0], True, a[2] + change, [suffix, list(tokens), list(counts)]

    def scanned(self, maps: list[tuple]) -> list[tuple]:
        """Prefix scan of chunk maps by doubling."""
        step = 1
        while step < len(maps):
            maps = [self.joined(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps


_compiled: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    """The transducer of a SentencePiece model file, one per process."""
    if model not in _compiled:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _compiled[model] = Transducer(
            {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in plain})
    return _compiled[model]


def prepared(text: str) -> str:
    """As the model's normalizer leaves it: one leading space, its own space mark for spaces."""
    return " " + text.replace("▁", " ") if text else ""


MAP = "row long, doc_id long, n_bytes long, part int, parts int, head string, closed boolean, count long, state string"


def chunk_maps(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
               chunk: int = CHUNK_CHARS) -> DataFrame:
    """One row per chunk with its map; texts are cut by Spark before they are counted."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"),
                        F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"),
                        F.greatest(F.ceil(F.length(body) / chunk), F.lit(1)).cast("int").alias("parts"))
    cut = whole.select("row", "doc_id", "n_bytes", "parts", F.posexplode(F.expr(
        f"if(parts = 1, array(text), transform(sequence(0, parts - 1), i -> substring(text, i * {chunk} + 1, {chunk})))"
    )).alias("part", "text"))

    def count(batches):
        machine = transducer(model)
        for batch in batches:
            out = []
            for part, piece in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
                piece = prepared(piece) if part == 0 else piece.replace("▁", " ")
                out.append(machine.chunk_map(piece, part == 0))
            parts = batch.column("parts").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), batch.column("part"),
                batch.column("parts"), pa.array([m[0] for m in out], pa.string()),
                pa.array([m[1] for m in out], pa.bool_()), pa.array([m[2] for m in out], pa.int64()),
                pa.array([json.dumps(m[3]) if n > 1 else None for m, n in zip(out, parts, strict=True)], pa.string())],
                names=["row", "doc_id", "n_bytes", "part", "parts", "head", "closed", "count", "state"])

    return cut.mapInArrow(count, MAP)


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; only texts of several chunks are joined."""
    maps = materialize(chunk_maps(docs, model, key, text, chunk), "chunkmaps")

    def joined(pdf):
        machine = transducer(model)
        pdf = pdf.sort_values("part")
        rows = [(h, bool(c), int(n), json.loads(s))
                for h, c, n, s in zip(pdf["head"], pdf["closed"], pdf["count"], pdf["state"], strict=True)]
        out = pdf[["doc_id", "n_bytes"]].iloc[:1].copy()
        out["n_tokens"] = machine.scanned(rows)[-1][2]
        return out

    schema = "doc_id long, n_bytes long, n_tokens long"
    single = maps.filter("parts = 1").select("doc_id", "n_bytes", F.col("count").alias("n_tokens"))
    return single.unionByName(maps.filter("parts > 1").groupBy("row").applyInPandas(joined, schema))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document for the 32k piece vocabulary."""
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
