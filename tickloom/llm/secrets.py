"""Secrets in texts by a trigram inverted index: postings are intersected, only candidates are matched.

The index is a table. Texts are taken in segments of bounded bytes; a segment has one row per trigram
of its texts (bytes, A-Z lower-cased) with the numbers of the rows that hold it, and one head row with
the keys of its rows. A key is a hash of identifier and text: rows that share one share the candidate
rules of both, which costs a match attempt and loses nothing. The index does not know the rules, so one
index serves many rule sets.

A rule's regular expression is turned into a Boolean query of trigrams that every match must hold:
exact strings are carried through literals, small classes, options and alternatives; where they end,
their trigrams are required. The postings of all wanted trigrams are read (a filter on the stored
column), each (segment, row) adds up the bits of its trigrams, and the queries are evaluated on these
bits. Rules without mandatory trigrams are tried on every text. The candidates are written first, so
that Spark knows their size when it plans the join with the rows: it broadcasts them while they are
small and moves each text once beyond that.

Defined results: a null or empty text has no spans; repeated rows are each scanned; a null key stays
null; an empty table gives no rows; columns other than key and text are not read. Offsets count code
points, ends are exclusive. A rule's matches are leftmost and do not overlap; those with too few
characters are dropped after that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as kinds  # the standard library's parse tree of a pattern
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytetext import LOWER, blocks
from tickloom.llm.registry import documents, query
from tickloom.session import fresh_path, materialize

SEGMENT = 1 << 21
#: exact strings carried at most before their trigrams are required
MOST_EXACT = 48


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` characters in ``group``, else the match is dropped."""

    pattern: str
    least: int = 0
    group: int = 0


#: fixed values: the rules that every scan has
BASE_RULES = {
    "assign": Rule(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": Rule(r"AKIA[A-Z0-9]+", 16),
    "hex": Rule(r"[0-9a-f]+", 32),
}
#: further kinds of secrets with a shape of their own
MORE_RULES = {
    "private_key": Rule(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    "code_host": Rule(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat_host": Rule(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "web_token": Rule(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "map_key": Rule(r"AIza[A-Za-z0-9_-]{35}"),
    "payment": Rule(r"[rs]k_live_[A-Za-z0-9]{16,}"),
    "bearer": Rule(r"(?i:authorization)\x20*[:=]\x20*(?i:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]+)", 16, 1),
    "url_login": Rule(r"""[a-z][a-z0-9+.-]{1,20}://[^\x09-\x0D\x20/:@"']{1,100}:([^\x09-\x0D\x20/:@"']+)@""", 3, 1),
}


# --- Boolean trigram queries: True, ("and", parts), ("or", parts) or a trigram of bytes


def both(op: str, parts) -> object:
    """``parts`` under one operator; True decides an "or" and vanishes in an "and"."""
    flat = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if op == "or":  # an alternative that asks for more than another one adds nothing
        asks = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
        flat = {p for p, a in asks.items() if not any(b < a for b in asks.values())}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def needs(strings) -> object:
    """One of the strings must stand in the text."""
    return both("or", [both("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in strings])


def members(items) -> set[bytes] | None:
    """Lower-cased bytes of a small class; None for a large or negated one."""
    out = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            out.add(chr(value).lower().encode() if value < 128 else chr(value).encode())
        elif kind is kinds.RANGE and value[1] - value[0] < 12:
            out |= {chr(v).lower().encode() if v < 128 else chr(v).encode() for v in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 12 else None


def trigram_query(pattern: str) -> object:
    """Trigrams that every text with a match of ``pattern`` holds, A-Z lower-cased."""
    exact, query = walked(parser.parse(pattern, re.ASCII))
    return both("and", [query, needs(exact)]) if exact is not None else query


def walked(tree) -> tuple[set[bytes] | None, object]:
    """(all strings that match, or None if unknown; query that holds besides)."""
    exact, whole, query = {b""}, True, True
    for kind, value in tree:
        more = True
        if kind in (kinds.LITERAL, kinds.IN):
            piece = members([(kind, value)] if kind is kinds.LITERAL else value)
        elif kind is kinds.SUBPATTERN:
            piece, more = walked(value[3])
        elif kind is kinds.BRANCH:
            arms = [walked(arm) for arm in value[1]]
            known = all(e is not None for e, _ in arms)
            piece = set().union(*[e for e, _ in arms]) if known else None
            more = both("or", [q if known or e is None else both("and", [q, needs(e)]) for e, q in arms])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, body = value
            piece, more = walked(body)
            if least == 0:
                piece, more = piece | {b""} if piece is not None and most == 1 else None, True
            elif piece is not None and least == most and len(piece) ** most <= MOST_EXACT:
                piece = {b"".join(p) for p in product(piece, repeat=most)}
            elif piece is not None:
                piece, more = None, both("and", [more, needs(piece)])
        elif kind is kinds.AT:
            piece = {b""}
        else:
            piece = None
        query = both("and", [query, more])
        if piece is not None and len(exact) * len(piece) <= MOST_EXACT:
            exact = {a + b for a in exact for b in piece}
        else:  # what is known ends here; a new stretch begins
            query, whole = both("and", [query, needs(exact)]), False
            exact = piece if piece is not None else {b""}
    return (exact, query) if whole else (None, both("and", [query, needs(exact)]))


def wanted(query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*map(wanted, query[1]))
    return set() if query is True else {query}


def holds(query, bit: dict[bytes, int]) -> F.Column:
    """The query over the columns ``bits0``, ``bits1``, ... of 60 trigrams each."""
    if isinstance(query, bytes):
        return F.col(f"bits{bit[query] // 60}").bitwiseAND(F.lit(1 << bit[query] % 60)) != 0
    parts = [holds(part, bit) for part in sorted(query[1], key=repr)]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if query[0] == "and" else out | part
    return out


# --- index


def row_key(key: str, text: str) -> F.Column:
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def trigram_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings: segment, trigram (24 bits) and rows; trigram -1 has the keys of the segment's rows."""
    from hashlib import blake2b

    def postings(batches):
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            for low, high, data, offsets in blocks(batch, limit=SEGMENT):
                data = LOWER[data].astype(np.int64)
                row = np.repeat(np.arange(high - low), np.diff(offsets))
                inside = row[2:] == row[:-2]
                code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[inside]
                width = max(high - low - 1, 1).bit_length()
                found = np.unique(code << width | row[:-2][inside])
                code, row = found >> width, found & (1 << width) - 1
                begin = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), code[1:] != code[:-1])))
                n = len(begin)
                # the same keys give the same number, however often a task is tried
                own = keys[low:high]
                segment = int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1, segment)),
                    pa.array(np.concatenate(([-1], code[begin])), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0, 0], begin[1:], [len(row)][:n])), pa.int32()),
                                             pa.array(row, pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0] + [len(own)] * (n + 1), pa.int32()), pa.array(own, pa.int64()))],
                    names=["segment", "trigram", "rows", "keys"])

    return docs.select(row_key(key, text).alias("key"), F.col(text).alias("text")).mapInArrow(
        postings, "segment long, trigram int, rows array<int>, keys array<long>").sortWithinPartitions("trigram", "segment")


def stored_index(index: DataFrame, path: str) -> DataFrame:
    """``index`` as a table at ``path``; lists of row numbers compress well."""
    index.write.option("compression", "zstd").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def candidates(index: DataFrame, queries: list) -> DataFrame:
    """Row keys whose trigrams satisfy some of the queries: key, ``rules`` (a bit for each query)."""
    names = sorted(set().union(*map(wanted, queries)))
    bit = {name: i for i, name in enumerate(names)}
    codes = {int.from_bytes(name, "big"): i for i, name in enumerate(names)}
    number = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    hits = index.filter(F.col("trigram").isin(list(codes))).select(
        "segment", F.explode("rows").alias("row"), number[F.col("trigram")].alias("i"))
    words = range((len(names) + 59) // 60)
    seen = hits.groupBy("segment", "row").agg(*[
        F.bit_or(F.when(F.expr(f"i div 60 = {w}"), F.expr("shiftleft(1L, i % 60)")).otherwise(0)).alias(f"bits{w}") for w in words])
    rules = F.lit(0).cast("long")
    for r, q in enumerate(queries):
        rules = rules.bitwiseOR(F.when(holds(q, bit), F.lit(1 << r)).otherwise(0).cast("long"))
    heads = index.filter("trigram = -1").select("segment", "keys")
    return seen.select("segment", "row", rules.alias("rules")).filter("rules <> 0").join(heads, "segment").select(
        F.expr("keys[row]").alias("key"), "rules").groupBy("key").agg(F.bit_or("rules").alias("rules"))


# --- scan


def matcher(rule: Rule) -> re.Pattern:
    """The rule's pattern; where it is one repeated class, its matches are whole runs, and the least length joins it."""
    tree = parser.parse(rule.pattern, re.ASCII)
    if len(tree) == 1 and tree[0][0] is kinds.MAX_REPEAT and rule.group == 0 and rule.pattern.endswith("]+"):
        (least, most, body), = [tree[0][1]]
        if least == 1 and most is kinds.MAXREPEAT and len(body) == 1 and body[0][0] is kinds.IN:
            return re.compile(f"{rule.pattern[:-1]}{{{max(rule.least, 1)},}}", re.ASCII)
    return re.compile(rule.pattern, re.ASCII)


def secret_spans(docs: DataFrame, rules: dict[str, Rule] | None = None, key: str = "doc_id", text: str = "text",
                 index: DataFrame | None = None) -> DataFrame:
    """Per row its key and ``spans`` (kind, start, end), by start and then in the order of the rules.

    ``index`` may be a stored ``trigram_index`` of the same rows; else one is written.
    """
    rules = BASE_RULES | MORE_RULES if rules is None else rules
    kind_names, queries = list(rules), [trigram_query(r.pattern) for r in rules.values()]
    indexed = [i for i, q in enumerate(queries) if q is not True]
    always = [i for i, q in enumerate(queries) if q is True]
    if len(indexed) > 60:
        raise ValueError("at most 60 rules with mandatory trigrams in one scan")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if indexed:
        if index is None:
            index = stored_index(trigram_index(docs, key, text), fresh_path(docs.sparkSession, "trigrams"))
        chosen = materialize(candidates(index, [queries[i] for i in indexed]), "candidates")
        rows = rows.withColumn("key", row_key("doc_id", "text")).join(chosen, "key", "left").select("doc_id", "text", "rules")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("long"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def match(batches):
        patterns = [matcher(r) for r in rules.values()]
        settings = list(rules.values())
        for batch in batches:
            out = []
            for body, bits in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                body, bits, found = body or "", bits or 0, []
                for i in always + [i for b, i in enumerate(indexed) if bits >> b & 1]:
                    r = settings[i]
                    for m in patterns[i].finditer(body):
                        if m.end(r.group) - m.start(r.group) >= r.least:
                            found.append((m.start(), i, m.end()))
                out.append([{"kind": kind_names[i], "start": s, "end": e} for s, i, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return rows.mapInArrow(match, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def said(spans: str) -> F.Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def either_case(pattern: str) -> str:
    """``(?i:...)`` spelled out as classes, since SQL engines fold more letters than A-Z."""
    return re.sub(r"\(\?i:([^()]*)\)", lambda m: "(?:" + re.sub(
        "[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)


def spans_sql() -> str:
    """Places of the matches: lengths of the pieces between them and of the matches, added up."""
    parts = []
    for i, (kind, rule) in enumerate((BASE_RULES | MORE_RULES).items()):
        pattern = either_case(matcher(rule).pattern).replace("'", "''")
        parts.append(f"""
  SELECT row, '{kind}' AS kind, {i} AS place, length(found[j]) AS size,
         coalesce(list_sum(list_transform(pieces[:j], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(found[:j - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT row, found, pieces, groups, unnest(range(1, len(found) + 1)) AS j FROM (
    SELECT row, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS pieces,
           regexp_extract_all(text, '{pattern}', {rule.group}) AS groups FROM rows))
  WHERE length(groups[j]) >= {rule.least}""")
    base = ", ".join(f"'{kind}'" for kind in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE_RULES)
    said_sql = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, place)"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT any_value(rows.doc_id) AS doc_id, {counts}, sha256(coalesce({said_sql} FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce({said_sql} FILTER (kind IS NOT NULL), '') AS spans
FROM rows LEFT JOIN spans USING (row) GROUP BY row
"""


@query("op13_secret_scan", spans_sql())
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all kinds in every document, with the base kinds counted and digested."""
    found = secret_spans(documents(spark, sf_dir))
    base = ", ".join(f"'{kind}'" for kind in BASE_RULES)
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in BASE_RULES],
        F.sha2(said(f"filter(spans, x -> x.kind in ({base}))"), 256).alias("base_sha256"), said("spans").alias("spans"))
