"""License scans by ordered signature rules.

A text becomes a sequence of words, each written as |word and a space, so that a rule is a regular
expression over whole words and its matches never share a word. Rules are gated by a keyword that
the sequence must hold. Matches become word intervals; an interval that lies inside another one of
equal or better tier is suppressed, in one pass over the intervals in order of their start.

Rules are built from license families and forms, both below. A pattern is a list of word tokens:
`a|b` is a choice, a final `?` makes a token optional.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, text_of

BREAKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # what stands between words of either case


class Rule(NamedTuple):
    rule_id: int
    label: str
    gate: str  # words of which every match holds one: texts without any gate word are not scanned
    keyword: str  # a word that every match holds: the rule is tried on texts that have it
    pattern: str  # regular expression over |word sequences
    tier: int  # 1 is the best
    score: float
    base: bool


# Phrases whose places and labels are always reported (fixed values).
BASE = (
    ("under the mit license", "mit", "under", "mit"),
    ("apache license version 2", "apache-2", "license", "apache"),
    ("cc by nc", "cc-by-nc", "cc", "cc"),
)

# label, keyword, name tokens (all that a notice or a reference uses for the license).
FAMILIES = (
    ("mit", "mit", "mit"),
    ("apache-2", "apache", "apache license? version? 2|v2 0?"),
    ("apache-1.1", "apache", "apache license? version? 1 1"),
    ("bsd-2-clause", "bsd", "bsd 2|two clause"),
    ("bsd-3-clause", "bsd", "bsd 3|three clause"),
    ("bsd-4-clause", "bsd", "bsd 4|four clause"),
    ("bsd-2-clause", "bsd", "simplified|freebsd bsd"),
    ("bsd-3-clause", "bsd", "new|revised|modified bsd"),
    ("gpl-2", "gpl", "gnu? gpl version? 2|v2 0?"),
    ("gpl-3", "gpl", "gnu? gpl version? 3|v3 0?"),
    ("lgpl-2.1", "lgpl", "gnu? lgpl version? 2|v2 1"),
    ("lgpl-3", "lgpl", "gnu? lgpl version? 3|v3 0?"),
    ("agpl-3", "agpl", "gnu? agpl version? 3|v3 0?"),
    ("gpl-2", "general", "gnu general public license version? 2|v2"),
    ("gpl-3", "general", "gnu general public license version? 3|v3"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license version? 2|v2 1"),
    ("lgpl-3", "lesser", "gnu lesser general public license version? 3|v3"),
    ("agpl-3", "affero", "gnu affero general public license version? 3|v3"),
    ("gfdl-1.3", "documentation", "gnu free documentation license version? 1 3"),
    ("mpl-2", "mozilla", "mozilla public license version? 2|v2 0?"),
    ("mpl-1.1", "mozilla", "mozilla public license version? 1 1"),
    ("mpl-2", "mpl", "mpl version? 2 0?"),
    ("epl-2", "eclipse", "eclipse public license version? 2|v2 0?"),
    ("epl-1", "eclipse", "eclipse public license version? 1|v1 0?"),
    ("cddl-1", "cddl", "cddl version? 1 0?"),
    ("eupl-1.2", "eupl", "eupl version? 1 2"),
    ("cc-by-nc", "cc", "cc by nc 1|2|3|4 0|5"),
    ("cc-by-nc-sa", "cc", "cc by nc sa 1|2|3|4? 0|5?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd 1|2|3|4? 0|5?"),
    ("cc-by-sa", "cc", "cc by sa 1|2|3|4? 0|5?"),
    ("cc-by-nd", "cc", "cc by nd 1|2|3|4? 0|5?"),
    ("cc-by", "cc", "cc by 1|2|3|4 0|5"),
    ("cc0", "cc0", "cc0 1? 0?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("bsl-1", "boost", "boost software license"),
    ("artistic-2", "artistic", "artistic license 2 0?"),
    ("ofl-1.1", "ofl", "sil ofl 1? 1?"),
    ("python-2", "psf", "psf license version? 2"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("postgresql", "postgresql", "postgresql"),
    ("x11", "x11", "x11"),
    ("afl-3", "academic", "academic free license version? 3"),
)

# Forms that notices take, from the most explicit to the loosest: tier, score, gate words, tokens
# before and after the name.
FORMS = (
    (1, 1.0, "spdx", "spdx license identifier", ""),
    (1, 0.95, "under", "licensed|released|distributed|available|published|redistributed under the? terms? of? the?",
     "license|licence?"),
    (2, 0.8, "license|licence", "license|licence is|are?", "license|licence?"),
    (2, 0.8, "covered|governed|bound", "covered|governed|bound by the?", "license|licence?"),
    (3, 0.7, "license|licence", "the?", "license|licence"),
)

# Notices without a family name.
GENERAL = (
    ("all-rights-reserved", "reserved", "all rights reserved", 3, 0.5),
    ("public-domain", "domain", "in|into|to the public domain", 3, 0.6),
    ("permissive-notice", "permission", "permission is hereby granted free of charge", 1, 0.9),
    ("bsd-notice", "redistribution", "redistribution and use in source and binary forms", 1, 0.9),
    ("no-warranty", "warranty", "without warranty of any kind", 3, 0.3),
    ("copyright", "copyright", "copyright c?", 4, 0.2),
    ("license-reference", "license", "license|licence", 4, 0.1),
    ("license-reference", "licensed", "licensed under", 4, 0.2),
)


def compiled(pattern: str) -> str:
    """The regular expression of a token list."""
    out = []
    for token in pattern.split():
        optional = token.endswith("?")
        choices = token.rstrip("?").split("|")
        body = choices[0] if len(choices) == 1 else f"(?:{'|'.join(choices)})"
        out.append(f"(?:\\|{body} )?" if optional else f"\\|{body} ")
    return "".join(out)


@lru_cache(maxsize=1)
def default_rules() -> tuple[Rule, ...]:
    """Base phrases, then every family in every form, then the general notices."""
    rows = [(label, gate, word, phrase, 1, 1.0, True) for phrase, label, gate, word in BASE]
    for tier, score, gate, before, after in FORMS:
        rows += [(label, gate, word, f"{before} {name} {after}", tier, score, False) for label, word, name in FAMILIES]
    rows += [(label, word, word, pattern, tier, score, False) for label, word, pattern, tier, score in GENERAL]
    return tuple(Rule(i, label, gate, word, compiled(pattern), tier, score, base)
                 for i, (label, gate, word, pattern, tier, score, base) in enumerate(rows))


def sequence(text: Column) -> Column:
    """|word and a space for each word, A-Z lower-cased."""
    spaced = ascii_lower(F.trim(F.regexp_replace(text, BREAKS, " ")))
    return F.when(spaced == "", "").otherwise(
        F.concat(F.lit("|"), F.replace(spaced, F.lit(" "), F.lit(" |")), F.lit(" ")))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame(
        [tuple(r) for r in rules],
        "rule_id int, label string, gate string, keyword string, pattern string, tier int, rule_score double, base boolean")


def _keyed(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, sequence and a digest of the text, for texts that hold a keyword."""
    words = sorted({w for r in rules for w in r.gate.split("|")})
    # Cheaper than whole words and never stricter: no ASCII letter or digit on either side.
    gate = text_of().rlike(f"(?i)(?<![0-9A-Za-z])(?:{'|'.join(words)})(?![0-9A-Za-z])")
    return docs.where(gate).select("doc_id", F.md5(text_of()).alias("digest"), sequence(text_of()).alias("seq"))


def detections(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, digest, rule_id, label, tier, score, base, first, last, suppressed): all matches.

    first and last are word positions from 0, both inclusive; digest is the text's MD5. Rows with
    the same doc_id and text are one text.
    """
    rules = rules or default_rules()
    seqs = _keyed(docs, rules)
    words = F.array(*[F.lit(w) for w in sorted({r.keyword for r in rules})])
    held = F.filter(words, lambda w: F.contains(F.col("seq"), F.concat(F.lit("|"), w, F.lit(" "))))
    tried = (seqs.withColumn("keyword", F.explode(held))
             .join(F.broadcast(rule_table(seqs.sparkSession, rules)), "keyword")
             .where(F.expr("seq rlike pattern")))
    marked = F.split(F.expr("regexp_replace(seq, concat('(', pattern, ')'), '\u0001$1\u0002')"), "\\|")
    at = lambda mark, shift: F.filter(F.transform(
        F.col("parts"), lambda p, i: F.when(F.contains(p, F.lit(mark)), i + shift)), lambda i: i.isNotNull())
    # An opening mark ends the part before its word; part i + 1 holds word i.
    spans = (tried.withColumn("parts", marked)
             .withColumn("span", F.explode(F.arrays_zip(at("\u0001", 0).alias("first"), at("\u0002", -1).alias("last"))))
             .select("doc_id", "digest", "rule_id", "label", "tier", F.col("rule_score").alias("score"), "base",
                     F.col("span.first").cast("bigint").alias("first"),
                     F.col("span.last").cast("bigint").alias("last")).distinct())
    order = (Window.partitionBy("doc_id", "digest").orderBy("first", F.desc("last"), "tier", "rule_id")
             .rowsBetween(Window.unboundedPreceding, -1))
    inside = F.lit(False)
    for tier in sorted({r.tier for r in rules}):
        reach = F.max(F.when(F.col("tier") <= tier, F.col("last"))).over(order)
        inside = F.when(F.col("tier") == tier, F.coalesce(reach >= F.col("last"), F.lit(False))).otherwise(inside)
    return spans.withColumn("suppressed", inside)


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each
    row of docs (doc_id, text; other columns are ignored).

    base counts all places of base rules, suppressed or not; labels are those of base rules and of
    matches that are not suppressed; score is the best rule score among them, 0 without any. Of equal
    intervals the better tier, then the smaller rule number stands. Null texts count as empty; empty
    texts have no words and no labels; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    base, live = F.col("base"), F.col("base") | ~F.col("suppressed")
    names = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    found = detections(docs, rules).groupBy("doc_id", "digest").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"), names(base).alias("base_labels"),
        names(live).alias("labels"), F.max(F.when(live, F.col("score"))).alias("score"))
    counted = docs.select(F.col("doc_id").alias("id"), F.size(F.array_remove(F.split(text_of(), BREAKS), "")).cast("bigint").alias("n_words"),
                          F.md5(text_of()).alias("text_digest"))
    return counted.join(found, counted.id.eqNullSafe(found.doc_id) & (counted.text_digest == found.digest), "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
