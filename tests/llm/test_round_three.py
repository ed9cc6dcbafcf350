"""Periodic runs, source divergence and secret scans: brute force, edge cases, forced collisions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bytetext, divergence, periods, secrets, words
from tickloom.session import materialize

SF = "/root/testdata/sf0.001"
EXTRA = ["key", "runs", "term", "n", "p", "rules", "rows", "segment", "number", "tile", "spans", "row"]


def with_extra(df):
    return df.select("*", *[F.lit(7).alias(c) for c in EXTRA])


# --- words


def test_word_numbers_survive_equal_hashes(monkeypatch):
    data = np.frombuffer("aa bb aa cc bb aa".encode(), np.uint8)
    starts, ends, _ = bytetext.word_spans(data, np.array([0, len(data)]), ~bytetext.SPACES)
    plain, _ = words.word_ids(data, starts, ends)
    monkeypatch.setattr(words, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    forced, lead = words.word_ids(data, starts, ends)
    for ids in (plain, forced):
        assert len(set(ids.tolist())) == 3 and ids[0] == ids[2] == ids[5] and ids[1] == ids[4]
    assert lead.tolist() == [0, 1, 3]


# --- periodic runs


def plain_runs(row, times=4, least=6):
    found = {}
    for q in range(1, len(row) // times + 1):
        i = 0
        while i + q < len(row):
            j = i
            while j + q < len(row) and row[j] == row[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def random_rows(rng):
    rows = []
    for _ in range(rng.randrange(1, 5)):
        k = rng.choice([1, 2, 3, 5, 30])
        row = [rng.randrange(k) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.7:
            unit = [rng.randrange(k) for _ in range(rng.randrange(1, 7))]
            row += unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit) + 1)]
        rows.append(row + [rng.randrange(k) for _ in range(rng.randrange(0, 10))])
    return rows


def as_runs(rows, got):
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    want = [(int(f) + s, int(f) + s + n, q) for f, r in zip(first, rows) for s, n, q in plain_runs(r)]
    return [tuple(map(int, r)) for r in got(np.array([x for r in rows for x in r], np.int64), first)], sorted(
        want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("slab", [1 << 20, 3])
def test_runs_against_brute_force(monkeypatch, slab):
    monkeypatch.setattr(periods, "SLAB", slab)
    rng, seen = random.Random(4), 0
    for _ in range(600):
        rows = random_rows(rng)
        got, want = as_runs(rows, lambda ids, first: periods.find_runs(ids, first, 4, 6))
        assert got == want
        seen += len(want)
    assert seen > 500


def test_runs_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(periods.Hashes, "same", lambda self, a, b, size: np.ones(len(a), bool))
    rng = random.Random(5)
    for _ in range(200):
        got, want = as_runs(random_rows(rng), lambda ids, first: periods.find_runs(ids, first, 4, 6))
        assert got == want


def test_rare_words_split_until_nothing_changes():
    # 9 splits; the 3s left on one side are then too few and split as well
    row = [1, 2, 3] * 4 + [9] + [3, 1, 2, 1, 2, 1, 2, 1, 2]
    starts, ends = periods.split_segments(np.array(row), np.array([0]), np.array([len(row)]), 4, 6)
    assert list(zip(starts, ends)) == [(0, 12), (14, 22)]


def digests(key, text):
    row = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(row)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            row = [row[i] if i < a else row[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(row)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(row) if i not in gone).encode()).hexdigest(), n)


def test_periodic_runs_query_against_brute_force(spark):
    got = periods.op11_periodic_runs(spark, SF).collect()
    want = [digests(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[1] for w in want) > 5


def test_periodic_runs_edge_cases(spark):
    texts = [(1, "a " * 50_000), (1, "a " * 50_000), (2, None), (3, ""), (4, " \n\t"), (None, "x y " * 9 + "z"), (5, "ñ ü " * 7),
             (6, "a b c"), (7, "w" * 200_000 + " v"), (8, "p q\tp q\np q  p q " + "tail")]
    docs = with_extra(spark.createDataFrame(texts, "doc_id long, text string"))
    out = periods.periodic_runs(docs).collect()
    assert len(out) == len(texts)
    by = {(r.doc_id, r.n_words): r for r in out}
    assert [tuple(x) for x in by[1, 50_000].runs] == [(0, 50_000, 1)] and by[1, 50_000].collapsed == "a"
    assert by[2, 0].runs == by[3, 0].runs == by[4, 0].runs == [] and by[2, 0].collapsed == ""
    assert by[None, 19].collapsed == "x y z" and by[5, 7].collapsed == "ñ ü" and by[6, 3].collapsed == "a b c"
    assert by[8, 9].collapsed == "p q tail"
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    looser = periods.periodic_runs(docs.filter("doc_id = 6"), least=7, times=5).collect()
    assert looser[0].runs == []


# --- source divergence


def test_tree_keeps_every_cell_and_skips_empty_quadrants():
    rng = np.random.default_rng(1)
    for height, rows, columns, filled in ((2, 16, 16, 9), (3, 40, 64, 300), (4, 256, 200, 50)):
        a, b = ({(int(r), int(c)): int(v) for r, c, v in zip(
            rng.integers(0, rows, filled), rng.integers(0, columns, filled), rng.integers(1, 10**9, filled))} for _ in range(2))
        zero = [rng.integers(1, 10**6, rows) for _ in range(2)]
        trees = [divergence.Tree(*(np.array(x) for x in ([r for r, _ in d], [c for _, c in d], list(d.values()))), height) for d in (a, b)]
        for other, same in ((1, False), (0, True)):
            cells = (a, b)[other]
            total, visited = divergence.joint_sums(trees[0], trees[other], zero[0], zero[other], height, same)
            for _ in range(200):
                i, j = (int(x) for x in rng.integers(0, rows, 2))
                if same and i >= j:
                    assert total[i, j] == visited[i, j] == 0
                    continue
                seen = {c for r, c in a if r == i} | {c for r, c in cells if r == j}
                gaps = [(a.get((i, c), int(zero[0][i])), cells.get((j, c), int(zero[other][j]))) for c in seen]
                assert visited[i, j] == len(seen) and total[i, j] == sum((p - q) ** 2 // (p + q) for p, q in gaps)


def plain_divergence(rows, least, most):
    scale, docs = 10**9, [((r[1] or ""), (r[2] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), r[0] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        held = Counter(t for d in here for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter() for s in {d[1] for d in here}}
        for _, s, terms in here:
            count[s].update(t for t in terms if held[t] >= least)
        whole = sum(count.values(), Counter())

        def price(c, t):
            return 1 + scale * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in count.items():
            pairs = [(o, sum(gap(price(c, t), price(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, gap(price(c, t), price(whole, t))) for t in kept if c[t] and price(c, t) > price(whole, t)]
            for part, found, upto in (("pair", pairs, len(pairs)), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:upto])]
    return sorted(out)


@pytest.mark.parametrize("side,wide", [(256, 4096), (4, 5)])
def test_divergence_against_brute_force(spark, side, wide):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["Ab", "bé", "c1d", "DD", "eé-f", f"w{chr(97 + rng.randrange(20))}"]) for _ in range(rng.randrange(30))),
             rng.choice(["en", "en", "de", None]), rng.choice(["", None, *[f"s{i}" for i in range(11)], "é", "Z"])) for _ in range(160)]
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("rare words", "xx", "a"), ("rare words", "xx", "b"), ("one", "yy", "c")] + [rows[0]] * 3
    docs = with_extra(spark.createDataFrame(rows, "text string, lang string, source string"))
    got = divergence.source_divergence(docs, least=4, most=3, side=side, wide=wide)
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 4, 3)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_price_of_counts_beyond_64_bits(spark):
    big = 7 * 10**17
    got = spark.sql(f"select {big}L as n, {big + 1000}L as t").select(divergence.price("n", "t").alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (big + 1000)


# --- secret scans


def plain_spans(text, rules):
    found = []
    for i, (kind, rule) in enumerate(rules.items()):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), i, m.end(), kind))
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def secret_texts(rng):
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " = ", ":", "=", '"', "'", "  ", "hunter2hunter2", "abc",
            "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "deadbeef", "é", "中", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20,
            "xoxb-1234567890-abc", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM-x", "AIza" + "b" * 35, "sk_live_" + "9" * 16,
            "Authorization: Bearer " + "t" * 20, "https://user:pass@host", "\x00", "ſecret=abcdefgh"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]


def test_queries_are_necessary_and_mostly_mandatory():
    rules = secrets.BASE_RULES | secrets.MORE_RULES
    queries = {k: secrets.trigram_query(r.pattern) for k, r in rules.items()}
    assert [k for k, q in queries.items() if q is True] == ["hex"]

    def ok(query, text):
        if query is True:
            return True
        if isinstance(query, bytes):
            return query in text
        return (all if query[0] == "and" else any)(ok(q, text) for q in query[1])

    rng, hits = random.Random(7), Counter()
    for text in secret_texts(rng):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
        for kind, rule in rules.items():
            if re.search(rule.pattern, text, re.ASCII):
                hits[kind] += 1
                assert ok(queries[kind], low)
    assert set(hits) == set(rules)
    for pattern, want in (("ab", True), ("abc|abd?", True), ("abc|xabc", b"abc"), ("(?:abc){2}", ("and", {b"abc", b"bca", b"cab"})),
                          ("abc.*def", ("and", {b"abc", b"def"})), ("x[^y]z", True), ("(?:abc)*", True), ("(?:abcd)+", ("and", {b"abc", b"bcd"}))):
        got = secrets.trigram_query(pattern)
        assert (got if not isinstance(got, tuple) else (got[0], set(got[1]))) == want, pattern


@pytest.mark.parametrize("segment", [1 << 21, 300])
def test_secrets_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(secrets, "SEGMENT", segment)
    rng = random.Random(8)
    rows = [(i // 2, t) for i, t in enumerate(secret_texts(rng))]
    rows += [(None, "token=abcdefgh1"), (None, None), (9000, ""), (9001, "x" * 300_000 + " secret: 0123456789"), rows[3], rows[3]]
    docs = materialize(with_extra(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3), "docs")
    rules = secrets.BASE_RULES | secrets.MORE_RULES
    index = materialize(secrets.trigram_index(docs), "index")
    for given in (None, index):
        got = secrets.secret_spans(docs, index=given).collect()
        ours = sorted((-1 if r.doc_id is None else r.doc_id, [tuple(s) for s in r.spans]) for r in got)
        assert ours == sorted((-1 if i is None else i, plain_spans(t, rules)) for i, t in rows)
    # the index spares most texts the match, and another rule set reads the same index
    chosen = secrets.candidates(index, [secrets.trigram_query(rules["access"].pattern)])
    assert 0 < chosen.count() < 0.7 * len(rows)
    own = {"dead": secrets.Rule("deadbeef", 8)}
    again = secrets.secret_spans(docs, own, index=index).collect()
    assert sum(len(r.spans) for r in again) == sum(len(plain_spans(t, own)) for _, t in rows) > 0
    assert secrets.secret_spans(docs.limit(0)).count() == 0
    only = secrets.secret_spans(docs, {"hex": secrets.BASE_RULES["hex"]}).collect()
    assert sum(len(r.spans) for r in only) == sum(len(plain_spans(t, {"hex": rules["hex"]})) for _, t in rows)
