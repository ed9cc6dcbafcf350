"""Every operator and stage: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import (
    fixity, leaks, licenses, ngramjoin, packing, quality, repeats, sharding, tokencount, transcripts)
from tickloom.session import fresh_path, materialize

LONG = "alpha beta gamma delta " * 12_000 + "omega"
PROSE = " ".join(f"w{i * i % 97}x{i}" for i in range(60))
ROWS = [(1, PROSE, "en"), (1, PROSE, "en"), (2, PROSE, None), (3, "", "en"), (4, None, "de"), (None, PROSE, "en"),
        (None, None, None), (5, "one", "en"), (6, "one two", "en"), (7, LONG, "en"), (8, " \n\t ", "en"),
        (9, "ñandú <|endoftext|> 中文 🙂", "es")]
#: extra columns named like columns that operators use inside
EXTRA = ["row", "q", "n", "words", "token", "block", "rows", "bucket", "bits", "masks", "id", "a", "b", "low", "kept",
         "size", "shard", "slot", "parts", "part", "prefix", "length", "start", "item_id", "component", "turns"]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text"))
    return materialize(base.select("*", *[F.lit(7).alias(c) for c in EXTRA]), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (77, 1, 1), (2, None, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE[:120]), (2, None), (3, ""), (4, "one two"), (1, PROSE[:120])],
                                 "item_id long, text string")


def test_sharding(spark, docs, empty):
    for rows, n in ((docs, len(ROWS)), (empty, 0)):
        sized = materialize(sharding.sized(rows), "sized")
        loads = materialize(sharding.slot_loads(sized), "loads")
        store = sharding.write_map(spark, loads, 4, fresh_path(spark, "map"))
        out = sharding.assigned(sized, store, loads).collect()
        assert len(out) == n
        for shard in range(4):
            slots = sorted(r.slot for r in out if r.shard == shard)
            assert slots == list(range(len(slots)))
        assert sorted(r.size for r in out) == sorted(len((t or "").encode()) + 1 for _, t, _ in ROWS)[:n]


def test_token_counts(docs, empty):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = tokencount.token_counts(docs, model, chunk=1000).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == sorted(
        (len((t or "").encode()), len(sp.encode(t or ""))) for _, t, _ in ROWS)
    assert tokencount.token_counts(empty, model).count() == 0


def test_licenses(docs, empty):
    out = licenses.license_scan(docs).collect()
    assert len(out) == len(ROWS) and all(r.labels == "" and r.score == 0 and r.first_word is None for r in out)
    assert licenses.license_scan(empty).count() == 0


def test_leaks(docs, empty, items):
    out = {(r.doc_id, r.item_id) for r in leaks.contained_items(docs, items).collect()}
    assert out == {(1, 1), (2, 1), (None, 1), (6, 4)}
    left = leaks.decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 5
    assert leaks.contained_items(empty, items).count() == leaks.contained_items(docs, items.limit(0)).count() == 0
    assert leaks.decontaminated(docs, items.limit(0)).count() == len(ROWS)


def test_ngram_join(docs, empty):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(docs).collect()}
    assert out[1] == out[2] == (58, 1) and out[3] == (0, 3) and out[5] == (1, 5) and out[6] == (1, 6)
    assert out[7] == (5, 7) and out[9][1] == 9
    assert ngramjoin.jaccard_components(docs).count() == len(ROWS)
    kept = ngramjoin.one_per_group(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, None, 5, 6, 7, 8, 9}
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_repeats(docs, empty):
    cut = repeats.cut_texts(docs)
    assert cut.columns == docs.columns
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in cut.collect() if r.text)
    # rows of one id or without an id cost each other nothing, id 2 loses what id 1 has
    assert [i for i, _ in out] == [-1, 1, 1, 5, 6, 7, 8, 9] and all(r.n_chars == len(r.text) for r in cut.collect() if r.text)
    assert cut.count() == len(ROWS) - 1
    assert repeats.cut_texts(empty).count() == 0


def test_packing(docs, empty):
    out = packing.pack_documents(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.doc_tokens for r in out if r.start == 0) == sum(r.length for r in out)
    assert packing.pack_documents(empty).count() == 0


def test_quality(docs, empty, labels):
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None} and kept.count() == 4
    assert quality.quality_filter(empty, labels).count() == 0
    assert quality.quality_filter(docs, labels.limit(0)).count() == 4


def test_fixity(spark):
    ddl = "page_id long, url string, html string, record string, replica int"
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (2, None, None), (None, "u", "y"), (None, None, None), (9000, "v", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "r", 5) for r in rows], ddl)
    ours = fixity.hashed(fixity.warc_records(pages), 0)
    other = fixity.hashed(fixity.warc_records(pages.filter("page_id is null or page_id <> 2")), 1)
    out = fixity.damaged_records(materialize(ours.unionByName(other), "both")).collect()
    assert len(out) == len(rows) and [r.page_id for r in out if r.damaged] == [2]
    none = pages.limit(0)
    both = fixity.hashed(fixity.warc_records(none), 0).unionByName(fixity.hashed(fixity.warc_records(none), 1))
    assert fixity.damaged_records(both).count() == 0


def test_fixity_counts_copies_on_both_sides(spark):
    """One of two equal records lost, one record that only the replica holds."""
    ddl = "page_id long, url string, html string"
    ours = [(1, "u", "<p>x"), (1, "u", "<p>x"), (2, "u", "y")]
    both = [fixity.hashed(fixity.warc_records(spark.createDataFrame(rows, ddl)), replica) for replica, rows in enumerate(
        [ours, [ours[0], ours[2], (3, "u", "new")]])]
    rows = materialize(both[0].unionByName(both[1]), "both")
    out = fixity.replica_differences(rows).collect()
    assert sorted((r.page_id, r.missing, r.extra) for r in out) == [(1, 1, 0), (3, 0, 1)]
    assert [(r.page_id, r.damaged) for r in fixity.damaged_records(rows).orderBy("offset").collect()] == [
        (1, False), (1, True), (2, False)]


def test_ngram_join_one_id_of_two_texts_and_rows_without_id(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    a, b, c = " ".join(base), " ".join(other), " ".join(f"u{i}" for i in range(60))

    def near(words, i):
        return " ".join([*words[:-1], f"x{i}"])

    rows = [(9, a), (9, b), (3, near(base, 3)), (5, near(base, 5)), (7, near(base, 7)), (10, near(other, 10)),
            (None, near(base, 1)), (None, c), (None, c + " more"), (20, near(other, 20)), (21, "alone here now")]
    out = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or -1, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == sorted([(9, 3), (9, 3), (3, 3), (5, 3), (7, 3), (10, 3), (-1, 3), (-1, -1), (-1, -1), (20, 3), (21, 21)])


def test_transcripts(spark):
    ddl = "conv_id long, turn long, role string, text string, said string, lone int"
    rows = [(1, 0, "user", "hi there?"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (2, None, None, None),
            (None, 0, "user", "x"), (None, 0, "user", "y"), (3, 0, "odd", "z " * 50_000)]
    raw = transcripts.raw_transcripts(spark.createDataFrame([(*r, "s", 1) for r in rows], ddl))
    out = transcripts.parsed(raw, transcripts.learned(raw)).collect()
    assert sorted((r.conv_id or 0) for r in out) == [0, 0, 1, 2, 3]
    none = raw.limit(0)
    assert transcripts.parsed(none, transcripts.learned(none)).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, items):
    folder = fresh_path(spark, "tables")
    labels.write.parquet(os.path.join(folder, "labels.parquet"))
    items.write.parquet(os.path.join(folder, "benchmark.parquet"))
    for table in (docs, empty):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, folder), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns
    assert now.count() == 0
