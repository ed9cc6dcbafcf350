"""The methods themselves: brute force, round trips and planted cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import leaks, licenses, ngramjoin, packing, quality, repeats, sharding, tokencount, transcripts
from tickloom.session import fresh_path, materialize

SF = "/root/testdata/sf0.001"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_transducer_is_the_library(real):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp, machine, rng = sentencepiece.SentencePieceProcessor(model_file=model), tokencount.transducer(model), random.Random(3)
    texts = [r.text or "" for r in real.collect()]
    alphabet = list("aaeeinnost  ▁\n\t.,AB1é中😀\x00<>")
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)]
    for text in texts:
        want = len(sp.encode(text))
        for chunk in (10**9, 1, 7) if len(text) < 100 else (10**9, 501):
            parts = [text[i:i + chunk] for i in range(0, len(text), chunk)] or [""]
            maps = [machine.chunk_map(tokencount.prepared(p) if i == 0 else p.replace("▁", " "), i == 0)
                    for i, p in enumerate(parts)]
            assert machine.scanned(maps)[-1][2] == want


def test_packing_tokens_are_the_library(real):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.gpt_style_encoder()
    rng = random.Random(8)
    texts = [r.text or "" for r in real.limit(80).collect()]
    texts += ["".join(rng.choice("ab  \n\t'sTé中🙂1<|>") for _ in range(60)) for _ in range(300)] + ["x<|endoftext|> <|endoftext|>y"]
    for text in texts:
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_best_fill_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 64): rng.randrange(1, 4) for _ in range(6)}
        lengths = sorted(counts, reverse=True)
        used = packing.best_fill(lengths[0], lengths, counts, 64)
        assert all(u <= counts[n] for n, u in used.items()) and used[lengths[0]] >= 1
        sums = {lengths[0]}
        for n in lengths:
            for _ in range(counts[n] - (n == lengths[0])):
                sums |= {s + n for s in sums if s + n <= 64}
        assert packing.waste(sum(n * u for n, u in used.items()), 64) == min(packing.waste(s, 64) for s in sums)


def test_packing_pieces_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 5000)) for i in range(300)]
    cut = [(i, s, min(1024, n - s), 0, n) for i, n in rows for s in range(0, n, 1024)]
    table = materialize(spark.createDataFrame(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "cut")
    out = packing.packed(table).toPandas()
    assert len(out) == len(cut) and set(zip(out.doc_id, out.start)) == {(c[0], c[1]) for c in cut}
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    total = out.groupby("sequence_id").length.sum()
    assert total.max() <= 1024 and sorted(total.index) == list(range(len(total)))
    assert sum(packing.waste(t, 1024) for t in total) < 0.02 * total.sum()


def covered(texts):
    """Brute force: 50-byte strings that start in a smaller id."""
    first = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], i))
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        yield i, b, gone


def test_repeats_against_brute_force(spark, real, monkeypatch):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (30, 49, 50, 51, 75, 76, 77, 400)]
    rows = [(r.doc_id, r.text) for r in real.collect()]
    rows += [(1000 + i, "".join(rng.choice([*shared, "xy", "q" * 80, "ab" * 40]) for _ in range(rng.randrange(1, 9))))
             for i in range(150)]
    rows += [(1000 + i, rows[200 + i][1] + "!") for i in range(20)]  # ids twice
    rng.shuffle(rows)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id"), "rows")
    out = repeats.without_repeats(docs, repeats.digest_rows("doc_id"),
                                  "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    want = []
    for i, b, gone in covered([(i, t.encode()) for i, t in rows]):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, out)) == sorted(want) and any(w[2] for w in want)


def moved_to(df):
    """Columns and number of partitions of the hash exchanges in the plan of ``df``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {(re.sub(r"#\d+L?", "", m[1]), int(m[2])) for m in re.finditer(r"hashpartitioning\((.*?), (\d+)\)", plan)}


def test_blocks_stay_where_they_are(spark):
    """More shuffle partitions than buckets of the block table do not move the blocks to those."""
    docs = materialize(spark.createDataFrame([(i, f"{i} " * 40) for i in range(60)], "doc_id long, text string"), "rows")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = repeats.without_repeats(docs, repeats.digest_rows("doc_id"),
                                      "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        assert moved_to(out) == {("block", 12)}
        assert out.count() == 60
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_few_pieces_cost_little_more_than_their_text():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 900):
        size = rng.integers(50, 77, n)
        given = [rng.integers(-1 << 62, 1 << 62, n), size, rng.integers(0, 27, n), rng.integers(0, 256, size.sum()).astype(np.uint8)]
        packed = repeats.packed_pieces(*given)
        assert all(np.array_equal(a, b) for a, b in zip(given, repeats.unpacked_pieces(packed), strict=True))
        assert len(packed) <= 10 * n + size.sum() + 40


def test_prefixes_are_moved_once(spark):
    """The rows of a class are found and freed of copies by the same keys."""
    rows = [(i % 7, i % 5, 0, 100, i % 5, 1, [1, 2], b"x") for i in range(40)]
    sets = materialize(spark.createDataFrame(
        rows, "doc_id long, t1 long, t2 long, n long, fp1 long, fp2 long, prefix array<long>, bits binary"), "sets")
    classes = materialize(sets.groupBy("n", "fp1", "fp2").agg(F.min(F.struct("t1", "t2", "doc_id")).alias("chosen")).withColumn(
        "id", F.monotonically_increasing_id()), "classes")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = ngramjoin.class_rows(sets, classes, 80)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted((r.id, r.t1) for r in out.collect()) == sorted((r.id, r.chosen.t1) for r in classes.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_suffixes_sort_like_bytes():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    data[1000:1100] = data[3000:3100]
    at = rng.permutation(3900)[:700]
    sizes = [1, 2, 3, 100, 594]
    begin = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    end = begin + np.repeat(sizes, sizes)
    out = repeats.Suffixes(data).merge_sorted(at, begin, end)
    for a, b in sorted({*zip(begin.tolist(), end.tolist())}):
        keys = [bytes(data[i:i + 50]) for i in out[a:b]]
        assert keys == sorted(bytes(data[i:i + 50]) for i in at[a:b])


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    base = [words(rng, rng.randrange(8, 90)) for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 14)):
            copy = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(words(rng, n, 4)) for n in range(14)] + ["", "a", "a b", "A  b"]
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "texts")
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs, k=k, percent=percent).collect()}
    assert out == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_least_difference_is_a_bound():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, 40).astype(np.uint64)]))
        assert ngramjoin.least_difference(ngramjoin.parities(a), ngramjoin.parities(b)) <= len(np.setxor1d(a, b))


def test_leaks_in_long_documents(spark):
    """Items of every size, whole or with a fifth of the shingles lost, inside long documents."""
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n, 10**6))) for i, n in enumerate([5, 8, 15, 20, 33, 60, 130, 600])]
    docs, want = [], set()
    for i, item in items:
        n = len(item.split()) - 4
        for j in range(12):
            body = words(rng, rng.choice([40, 3000, 20_000]), 10**6)
            kept = item.split()
            if n >= 20 and j % 2:
                kept[0] = "changed"
            at = rng.randrange(len(body))
            docs.append((len(docs), " ".join(body[:at] + [w.upper() + "," for w in kept] + body[at:])))
            want.add((len(docs) - 1, i))
    table = materialize(spark.createDataFrame(docs, "doc_id long, text string"), "long")
    found = leaks.contained_items(table, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_no_small_item_is_hidden():
    """Items of one to seven different shingles, over many seeds: none is hidden by its neighbours."""
    import pyarrow as pa

    want, found = set(), set()
    for seed in range(60):
        rng = random.Random(seed)
        own = [words(rng, 5 + i % 7, 10**6) for i in range(28)] + [[f"again{seed}"] * 30]
        items = leaks.Items(list(range(len(own))), [" ".join(w) for w in own])
        docs = []
        for w in own:
            body = words(rng, 400, 10**6)
            at = rng.randrange(400)
            docs.append(" ".join(body[:at] + w + body[at:]))
        batch = pa.RecordBatch.from_pydict({"text": docs})
        found |= {(seed, r, i) for r, i, _ in items.matches(batch, "text")}
        want |= {(seed, i, i) for i in range(len(own))}
    assert found == want


def test_item_blocks_change_nothing(spark, real, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, leaks.contained_items(real, items).collect()))
    monkeypatch.setattr(leaks, "ITEM_BYTES", 3000)
    monkeypatch.setattr(leaks.item_blocks, "__defaults__", ("item_id", "text", 3000))
    assert sorted(map(tuple, leaks.contained_items(real, items).collect())) == one


def test_license_templates(spark):
    mit = licenses.TEMPLATES["mit"]
    cases = {1: ("mit", licenses.MARK.sub(" ", mit)), 2: ("mit", "x y " + mit.replace("<<optional>>", "").replace("<<end>>", "").upper()),
             3: ("", licenses.MARK.sub(" ", mit).replace("sublicense", "resell")),
             4: ("apache,apache-2.0", "Licensed under the Apache License, Version 2.0."),
             5: ("gpl,gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
             6: ("gpl", "a GNU General Public License here"), 7: ("cc-by-nc-4.0", "licensed under the Creative Commons CC BY-NC 4.0"),
             8: ("mit,mit-notice", "Foo is released under the MIT License"), 9: ("", "mit\x00 licence"), 10: ("mit", "MIT -- license MIT")}
    docs = spark.createDataFrame([(i, t) for i, (_, t) in cases.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert {i: r.labels for i, r in out.items()} == {i: label for i, (label, _) in cases.items()}
    assert (out[10].n_base, out[10].first_word, out[10].last_word, out[10].n_words) == (1, 0, 0, 3)


def test_license_texts_need_their_disclaimers(spark):
    whole = {label: re.sub(r"<<any:(\d+)-\d+>>", lambda m: "thing " * int(m[1]), licenses.TEMPLATES[label])
             for label in ("mit", "isc", "bsd", "gpl", "apache-2.0-header")}
    whole = {label: licenses.MARK.sub(" ", text) for label, text in whole.items()}
    docs, want = [], {}
    for label, text in whole.items():
        cut = text.split()
        for kind, t in (("whole", text), ("cut", " ".join(cut[:-1])), ("changed", " ".join(cut[:-1] + ["else"])),
                        ("head", " ".join(cut[:len(cut) // 2]))):
            want[len(docs)] = (label, kind == "whole")
            docs.append((len(docs), "before " + t + " after" * (kind == "whole")))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    # the phrase "general public license" has the label gpl too, with a score of 0.5
    got = {r.doc_id: r.labels.split(",") if r.score == 1 else [] for r in licenses.license_scan(table).collect()}
    assert {i: (label, label in got[i]) for i, (label, _) in want.items()} == want
    two = whole["bsd"].split(" Neither ")[0].rstrip(" 3.") + " THIS SOFTWARE " + whole["bsd"].split("THIS SOFTWARE IS", 1)[1].join(["IS", ""])
    two = spark.createDataFrame([(1, two)], "doc_id long, text string")
    assert licenses.license_scan(two).first().labels == "bsd"


def binomial_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))


def test_exact_binomial_tail(spark):
    rows = [(n, k) for n in (1, 7, 60, 400) for k in {0, 1, n // 3, n} if k <= n]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("tail", F.exp(quality.log_tail("n", "k", 0.02)))
    for r in df.collect():
        assert r.tail == pytest.approx(binomial_tail(r.n, r.k, 0.02), rel=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    """The certified cutoff is the last of the unbroken row of passing tests."""
    rng = random.Random(3)
    rows = [(i, "en", max(0.0, rng.gauss(0.1, 0.08))) for i in range(3000)]
    scored = spark.createDataFrame(
        [((i, lang), (1000, 1000, int(1000 * s), 0, 0, 1, 0)) for i, lang, s in rows],
        "row struct<doc_id:long,lang:string>, q struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,"
        "n_repeat_words:long,n_lines:long,n_capitals:long>")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, quality int")
    cut = quality.cutoffs(scored, labels).first().cut.symbols
    want = None
    for step in quality.GRID:
        wrong = sum(int(1000 * s) / 1000 > step for _, _, s in rows)
        if not (wrong < 15 and binomial_tail(3000, wrong, quality.RISK / 4) <= quality.ERROR / 4):
            break
        want = step
    assert cut == want is not None


def test_quality_counts(spark, real):
    import re

    docs = real.union(spark.createDataFrame([(900, "a b c d e f g h " * 3 + "\n#x|y\n#x|y\n \n", "en", "s", 1), (901, "p q\n" * 9, "en", "s", 1)],
                                            real.schema))
    out = {r.row.doc_id: r.q for r in quality.with_features(docs).collect()}
    for r in docs.collect():
        w = [x for x in re.split("[\x20\x09-\x0D]+", r.text or "") if x]
        seen, rep = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i:i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                rep |= {i + j for i in at for j in range(8)}
        lines = [x for x in (r.text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        q = out[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(rep))


def test_good_documents_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = materialize(quality.with_features(docs), "scored")
    out = quality.judged(scored, quality.cutoffs(scored, labels)).filter("not base_failed and row.lang = 'en'").select(
        "row.doc_id", "kept").join(labels, "doc_id")
    rate = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rate[1] > 1 - quality.RISK and rate[0] < 0.1


def test_shards_are_even_and_edits_few(spark, real):
    rows = materialize(sharding.sized(real), "sized")
    loads = materialize(sharding.slot_loads(rows), "loads")
    path = fresh_path(spark, "map")
    store = sharding.write_map(spark, loads, 8, path)
    out = sharding.assigned(rows, store, loads).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.02 * sums.mean()
    assert sorted(zlib.crc32((r.text or "").encode()) for r in real.collect()) == sorted(out.text_crc32)
    assert store.filter("version = 1").count() == 4096 and 0 < store.filter("version = 2").count() < 4096
    sharding.rebalanced(spark.read.parquet(path), loads, 9).write.mode("append").parquet(path)
    grown = spark.read.parquet(path)
    assert sharding.current_map(grown, 2).exceptAll(sharding.current_map(store)).count() == 0
    more = sharding.assigned(rows, grown, loads).toPandas().groupby("shard")["size"].sum()
    assert len(more) == 9 and more.max() - more.min() < 0.03 * more.mean()


def test_roles_recovered_on_held_out_conversations(spark):
    talk = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    raw = materialize(transcripts.raw_transcripts(talk), "raw")
    model = transcripts.learned(raw.filter("conv_id % 2 = 0"))
    good = total = 0
    for r in raw.filter("conv_id % 2 = 1").collect():
        symbols = [transcripts.observed(x)[0] for x in r.text.split("\n")]
        truth = [role for role, n in zip(r.roles, r.lines) for _ in range(n)]
        for want, got in zip(truth, model.states(symbols)):
            good += want == transcripts.ROLES[got // 2]
            total += 1
    assert good / total > 0.9


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    model = transcripts.Model(*(rng.integers(0, 9, s) for s in (6, (6, 6), (6, transcripts.SYMBOLS))))

    def score(path, seen):
        s = model.start[path[0]] + model.show[seen[0]][path[0]]
        for a, b, o in zip(path, path[1:], seen[1:]):
            s += model.move[a][b] + model.show[o][b]
        return s

    for _ in range(20):
        seen = rng.integers(0, transcripts.SYMBOLS, 4).tolist()
        best = max(score(p, seen) for p in itertools.product(range(6), repeat=4))
        assert score(model.states(seen), seen) == pytest.approx(best)
