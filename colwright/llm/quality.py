"""Quality rules: base measures, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two smoothed multinomials over the
buckets are fitted: the raw corpus (all documents) and the trusted target (labelled good, not
toxic). A document's score is the mean over its n-grams of log(target / raw); documents below a
threshold go. The threshold is the score that a given share of the trusted documents reaches.
Everything is built-in column functions; the fitted model is one literal array.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, settings, text_of, written

BUCKETS = 10_000
KEEP_TRUSTED = 0.995  # share of the trusted documents that must pass
SCALE = 1_000_000  # ratios are whole millionths, so that sums don't depend on their order
BIN = 1_000  # width of the bins in which trusted scores are counted, in millionths
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "[^#*$%&|<>]+"
DIRECT = 512  # repeated windows up to which membership is tested in the list itself
BLOOM = {"spark__sql__optimizer__runtime__bloomFilter__" + k: v for k, v in {  # whatever the sizes; 4 MB
    "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": "4000000", "numBits": "33554432"}.items()}
_W = "__quality_"


class Model(NamedTuple):
    ratios: list[int]
    threshold: int  # millionths


def with_words(docs: DataFrame) -> DataFrame:
    """Adds the word digests."""
    words = F.array_remove(F.split(text_of(), SPACE + "+"), "")
    return docs.withColumn(f"{_W}h", F.transform(words, lambda w: F.xxhash64(w)))


def _grams(h: Column, n: int) -> Column:
    """Digests of the runs of n words; none if the text is shorter."""
    runs = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(runs, lambda i: F.xxhash64(
        *[F.get(h, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _buckets() -> Column:
    h = F.col(f"{_W}h")
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(h, bucket), F.transform(_grams(h, 2), bucket))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (prefixed names) to with_words."""
    text, h = text_of(), F.col(f"{_W}h")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    docs = docs.withColumns({f"{_W}w": _grams(h, 3), f"{_W}lines": lines})
    w = F.col(f"{_W}w")
    docs = docs.withColumn(f"{_W}s", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(w)))
    s = F.col(f"{_W}s")
    docs = docs.withColumn(f"{_W}twice", F.when(s.isNotNull(), F.array_distinct(
        F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))))
    twice = F.col(f"{_W}twice")
    near = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    docs = docs.withColumn(f"{_W}pairs", F.when(F.size(twice) > DIRECT, pairs))
    p = F.col(f"{_W}pairs")
    far = F.sort_array(F.transform(F.filter(p, lambda a, k: (F.get(p, k - 1).x == a.x) & (k > 0)
                                            | F.coalesce(F.get(p, k + 1).x == a.x, F.lit(False))),
                                   lambda a: a.i))
    places = F.when(F.size(twice) > DIRECT, far).when(twice.isNotNull(), near)
    docs = docs.withColumn(f"{_W}at", places)
    covered = F.aggregate(
        f"{_W}at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")),
        lambda a: a["sum"])
    found = F.col(f"{_W}lines")
    return docs.withColumns({
        f"{_W}n_words": F.size(h).cast("bigint"),
        f"{_W}word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint"),
        f"{_W}n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint"),
        f"{_W}n_dup_lines": (F.size(found) - F.size(F.array_distinct(found))).cast("bigint"),
        f"{_W}n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
    })


def base_failed() -> Column:
    n, repeat = F.col(f"{_W}n_words"), F.col(f"{_W}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def with_score(docs: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds the whole millionths of the mean log ratio (null without words)."""
    model = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') as array<bigint>)")
    docs = docs.withColumn(f"{_W}b", _buckets())
    b = F.col(f"{_W}b")
    total = F.aggregate(b, F.lit(0).cast("bigint"), lambda a, i: a + F.get(model, i))
    return docs.withColumn(f"{_W}score", F.when(F.size(b) > 0, F.floor(total / F.size(b)).cast("bigint")))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all documents and over all trusted ones. Without trusted documents nothing is rejected.

    The texts of the trusted documents are written once. Unless their ids are few enough to be sent to
    the tasks, texts are shuffled, most others being dropped before that by Spark's Bloom filter."""
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id")
    texts = docs.select("doc_id", "text")
    with settings(docs.sparkSession, **BLOOM):
        good_texts = written(texts.join(trusted, "doc_id", "left_semi").select("text"), "trusted")

    def counts(of: DataFrame) -> list[int]:
        found = [0] * BUCKETS
        for row in with_words(of).select(F.explode(_buckets()).alias("bucket")).groupBy("bucket").count().collect():
            found[row["bucket"]] = row["count"]
        return found

    good = counts(good_texts)
    if not sum(good):
        return Model([0] * BUCKETS, -(1 << 62))
    raw = counts(texts)
    raw_all, good_all = sum(raw) + 0.5 * BUCKETS, sum(good) + 0.5 * BUCKETS
    ratios = [round(SCALE * math.log((g + 0.5) / good_all * raw_all / (r + 0.5))) for g, r in zip(good, raw)]
    bins = (with_score(with_words(good_texts), ratios).where(f"size({_W}h) >= {MIN_WORDS}")
            .groupBy(F.floor(F.col(f"{_W}score") / BIN).alias("bin")).count().orderBy("bin").collect())
    spare = math.floor((1 - KEEP_TRUSTED) * sum(r["count"] for r in bins))
    threshold = -(1 << 62)
    for row in bins:
        if row["count"] > spare:
            threshold = row.bin * BIN
            break
        spare -= row["count"]
    return Model(ratios, threshold)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and the prefixed measures, score and verdicts."""
    docs = with_score(with_base(with_words(docs)), model.ratios)
    return docs.withColumn(f"{_W}failed", base_failed()).withColumn(
        f"{_W}kept", ~F.col(f"{_W}failed") & (F.coalesce(f"{_W}score", F.lit(0)) >= model.threshold))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept),
    a row for each row of docs (doc_id, text; other columns are ignored).

    A null or blank text has no words, fails the base rules and has a null score. Rows that repeat a
    doc_id are judged one by one. Null ids are judged but never trusted. A score equal to the
    threshold is kept. Empty tables give an empty result; without labels only the base rules reject.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = judged(docs, fit(docs, labels))
    return found.select("doc_id", *[F.col(_W + m).alias(m) for m in MEASURES],
                        F.col(f"{_W}failed").alias("base_failed"),
                        (F.col(f"{_W}score") / SCALE).alias("score"), F.col(f"{_W}kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    # The row number, always true here, keeps the optimizer from moving the filter below the steps that
    # make the word lists, where it would repeat them for every element.
    found = judged(docs, fit(docs, labels)).withColumn(
        f"{_W}keep", F.col(f"{_W}kept") & (F.monotonically_increasing_id() >= 0))
    return found.where(f"{_W}keep").select(*[F.col(f"`{c}`") for c in docs.columns])
