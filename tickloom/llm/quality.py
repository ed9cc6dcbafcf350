"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Base features are counted over whole texts. On labelled documents, every rule's cutoff is the
lowest on its grid for which an exact binomial test shows that at most its share of ``risk`` of the
good documents of a stratum are rejected; all rules together stay below ``risk``. Cutoffs are tested from the mildest down and testing stops
at the first that fails, so a grid needs no correction of its own; the error rate is divided by
the number of (stratum, rule) pairs. A stratum with too few labels gets no cutoff.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a
stratum; labels without a document, null ids and repeated labels (the lowest counts) do no harm;
repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.registry import documents, query
from tickloom.session import materialize

#: good documents of a stratum that all rules together may reject
RISK = 0.02
ERROR = 0.05
#: share of a text that a rule may object to, mildest first
GRID = [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08,
        0.06, 0.05, 0.04, 0.03, 0.02]
#: rule: what it counts, out of what
RULES = {
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
}
#: strata whose cutoffs are sent to every task; with more, the join is left to Spark
MOST_STRATA = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the given row as a struct, and ``q``, its counts; no names of ``docs`` can clash."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        F.struct("*").alias("row"), F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).alias("symbols"),
        F.length(F.regexp_replace(body, r"[^A-Z]+", "")).alias("capitals"))
    windows = words.withColumn("n", F.size("words")).withColumn("w8", F.expr(
        "if(n < 8, cast(array() as array<bigint>),"
        " transform(sequence(1, greatest(n - 7, 1)), i -> xxhash64(slice(words, i, 8))))"))
    # only a text with a repeated window is sorted; equal windows then stand side by side
    ordered = windows.withColumn("sorted", F.expr(
        "if(size(array_distinct(w8)) < size(w8),"
        " array_sort(transform(w8, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>))"))
    found = ordered.withColumn("hits", F.expr(
        "array_sort(transform(filter(sorted, (x, j) -> (j > 0 and sorted[greatest(j - 1, 0)].h = x.h)"
        " or (j + 1 < size(sorted) and sorted[least(j + 1, size(sorted) - 1)].h = x.h)), x -> x.i))"))
    covered = F.expr("aggregate(hits, struct(0 as upto, 0 as total), (a, p) -> struct("
                     "p + 8 as upto, a.total + p + 8 - greatest(p, a.upto) as total), a -> a.total)")
    return found.select("row", F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("capitals").cast("long").alias("n_capitals")).alias("q"))


def scores() -> dict[str, F.Column]:
    """Every rule's share, from the struct ``q``."""
    return {name: F.col(f"q.{part}") / F.greatest(F.col(f"q.{whole}"), F.lit(1))
            for name, (part, whole) in RULES.items()}


def base_failed() -> F.Column:
    return (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))


def log_tail(n: str, k: str, p: float) -> F.Column:
    """Logarithm of P(X <= k) for X binomial (n, p), summed term by term in logarithms."""
    return F.expr(f"""
        aggregate(if({k} > 0, sequence(1L, greatest({k}, 1L)), cast(array() as array<bigint>)),
            struct({n} * ln(1 - {p}D) as term, {n} * ln(1 - {p}D) as total),
            (a, i) -> struct(
                a.term + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D)) as term,
                greatest(a.total, a.term + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D)))
                  + ln(1 + exp(-abs(a.total - (a.term + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D)))))) as total),
            a -> a.total)""")


def cutoffs(scored: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang",
            risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per stratum a struct with each rule's certified cutoff (null: none is certified)."""
    good = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(
        F.min("quality").alias("__quality")).filter("__quality = 1")
    rules = scores()
    share = risk / len(rules)
    held = scored.select(F.col("row")[key].alias("__key"), F.col("row")[stratum].alias("stratum"),
                         *[rule.alias(name) for name, rule in rules.items()]).join(good, "__key")
    tried = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *[
        F.count_if(F.col(name) > cut).alias(f"{name}_{j}") for name in rules for j, cut in enumerate(GRID)]), "tests")
    tests = tried.select("stratum", "n", F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(j).alias("step"), F.lit(cut).alias("cutoff"),
                 F.col(f"{name}_{j}").alias("rejected"))
        for name in rules for j, cut in enumerate(GRID)])))
    strata = max(tried.count(), 1)
    level = math.log(error / (len(rules) * strata))
    # the exact tail is wanted only where the rejected share is below the risk at all
    passed = tests.withColumn("ok", F.when(
        F.col("rejected") < F.col("n") * share, log_tail("n", "rejected", share) <= level).otherwise(False))
    steps = passed.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(len(GRID))).alias("failed"))
    chosen = steps.withColumn("cutoff", F.when(
        F.col("failed") > 0, F.element_at(F.array(*map(F.lit, GRID)), F.greatest("failed", F.lit(1)))))
    return chosen.groupBy("stratum").agg(F.struct(*[
        F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(name) for name in rules]).alias("cut"))


def judged(scored: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """``scored`` with booleans ``base_failed`` and ``kept``."""
    rejected = F.lit(False)
    for name, rule in scores().items():
        rejected = rejected | F.coalesce(rule > F.col(f"cut.{name}"), F.lit(False))
    limits = limits.withColumnRenamed("stratum", "__stratum")
    if limits.count() <= MOST_STRATA:
        limits = F.broadcast(limits)
    return scored.join(limits, F.col("row")[stratum].eqNullSafe(F.col("__stratum")), "left").select(
        "row", "q", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    scored = materialize(with_features(docs), "scored")
    limits = materialize(cutoffs(scored, labels), "cutoffs")
    return judged(scored, limits).filter("kept").select("row.*")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, cutoffs certified per language."""
    docs = documents(spark, sf_dir)
    scored = materialize(with_features(docs).select(F.struct("row.doc_id", "row.lang").alias("row"), "q"), "scored")
    limits = materialize(cutoffs(scored, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cutoffs")
    return judged(scored, limits).select(
        "row.doc_id", *[F.col(f"q.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "row.lang")
