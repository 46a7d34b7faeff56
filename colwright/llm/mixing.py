"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A node's capacity is its leaves' supply times the allowed
epochs. From the root down, each node's budget is split among its children by weight; children that
cannot fill their share keep their capacity and the rest goes to their siblings. A node never gets
more than its capacity, so a shortage leaves a family only when all of that family is exhausted.
Each leaf then takes whole epochs, and of the last epoch, put in a seeded order, a prefix of tokens.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, text_of, written

LEVELS = ("domain", "lang", "source")
SALTS = 64  # parts of a leaf's documents when budgets are attached
HEX = 3  # digits of the order digest that make the buckets of a running sum: 4096 a leaf


class Mix(NamedTuple):
    weights: tuple[dict[str, int], dict[str, int], dict[str, int]]  # per level; others weigh 1
    share: float  # of the supplied tokens that the mix takes
    epochs: int  # how often a document may be used
    seed: int


MIX = Mix(weights=({"head": 2, "web": 3, "curated": 5}, {"en": 6, "de": 2, "fr": 2}, {"src0": 2}),
          share=0.5, epochs=2, seed=17)


def domain_of(source: Column) -> Column:
    return F.when(source == "src0", "head").when(source.startswith("src1"), "web").otherwise("curated")


def _weight(name: str, weights: dict[str, int]) -> Column:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    out = F.lit(1).cast("bigint")
    for value, w in weights.items():
        out = F.when(F.col(name) == value, F.lit(w).cast("bigint")).otherwise(out)
    return out


def _split(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """nodes (parent, name, cap, budget of the parent) with each node's own budget."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = family.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("w", _weight(name, weights)).withColumns({
        "all_w": F.sum("w").over(family), "done_w": F.coalesce(F.sum("w").over(before), F.lit(0)),
        "done_cap": F.coalesce(F.sum("cap").over(before), F.lit(0))})
    full = F.expr("cap * (all_w - done_w) <= w * (budget - done_cap)")
    nodes = nodes.withColumn("is_full", full).withColumns({
        "full_cap": F.sum(F.expr("if(is_full, cap, 0)")).over(family),
        "full_w": F.sum(F.expr("if(is_full, w, 0)")).over(family)})
    own = F.expr("if(is_full, cap, (w * (budget - full_cap)) div (all_w - full_w))")
    return nodes.withColumn("own", own).select(*parent, name, "cap", F.col("own").alias("budget"))


def leaf_budgets(counts: DataFrame, mix: Mix = MIX) -> DataFrame:
    """(domain, lang, source, supply, budget) of (domain, lang, source, n_tokens) rows."""
    leaves = counts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")).withColumn(
        "cap", F.col("supply") * mix.epochs)
    level = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    every = Window.partitionBy(F.lit(0))
    level = level.withColumn("budget", F.least(F.sum("cap").over(every), F.floor(
        F.sum("supply").over(every) * F.lit(mix.share)).cast("bigint")))
    level = _split(level, [], "domain", mix.weights[0])
    for i in (1, 2):
        parent = list(LEVELS[:i])
        children = leaves.groupBy(*LEVELS[:i + 1]).agg(F.sum("cap").alias("cap"))
        level = _split(children.join(level.drop("cap"), parent), parent, LEVELS[i], mix.weights[i])
    return leaves.drop("cap").join(level.drop("cap"), list(LEVELS)).where("supply > 0")


def mix_sources(docs: DataFrame, mix: Mix = MIX, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, part_tokens), a row for each selected row of
    docs (doc_id, text, lang, source; other columns are ignored).

    copies: whole epochs in which the document is used; part_tokens: its tokens in the last epoch,
    all but the last document of a leaf's prefix being whole. Tokens are words between white space.
    Null languages and sources are a leaf of their own, named ''. Empty texts have no tokens and are
    never selected. The order of an epoch is the MD5 of seed, epoch and doc_id; equal ones go by
    doc_id (null first) and length. Shares are rounded down, at most a token per child. Repeated rows
    count one by one; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"),
                       F.coalesce("source", F.lit("")).alias("source"))
    words = F.size(F.array_remove(F.split(text_of(), SPACE + "+"), "")).cast("bigint")
    counts = written(docs.select("doc_id", (domain_of(F.col("source")) if domain is None else domain).alias("domain"),
                                 "lang", "source", words.alias("n_tokens")).where("n_tokens > 0"), "counts")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    # Written, since its windows would stand in the plan once for each use below.
    budgets = written(leaf_budgets(counts, mix), "budgets").select(
        *LEVELS, F.expr("budget div supply").alias("copies"), F.expr("budget % supply").alias("rest"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    order = F.md5(F.concat_ws("|", F.lit(mix.seed).cast("string"), F.col("copies").cast("string"),
                              F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = (counts.withColumn("salt", salt).join(budgets, [*LEVELS, "salt"]).drop("salt")
              .withColumn("at", order).withColumn("bucket", F.substring("at", 1, HEX)))
    leaf = Window.partitionBy(*LEVELS)
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"))
    sums = written(sums.withColumn("before", F.sum("held").over(leaf.orderBy("bucket")) - F.col("held")), "buckets")
    placed = placed.join(sums, [*LEVELS, "bucket"])
    clear = placed.where("before + held <= rest OR before >= rest").withColumn(
        "part_tokens", F.when(F.col("before") + F.col("held") <= F.col("rest"), F.col("n_tokens")).otherwise(F.lit(0).cast("bigint")))
    inside = leaf.orderBy("at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = (placed.where("before < rest AND before + held > rest")
            .withColumn("run", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .withColumn("part_tokens", F.greatest(F.lit(0).cast("bigint"), F.least("n_tokens", F.col("rest") - F.col("run"))))
            .drop("run"))
    return clear.unionByName(edge).where("copies > 0 OR part_tokens > 0").select(
        "doc_id", *LEVELS, "n_tokens", "copies", "part_tokens")


def mix_sql(documents: str = "documents", mix: Mix = MIX) -> str:
    """The same mix in SQL over the whole order of each leaf."""
    def weight(level):
        cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in mix.weights[level].items())
        return f"(CASE {LEVELS[level]} {cases} ELSE 1 END)"

    def split(level):
        parent, name = ", ".join(LEVELS[:level]), LEVELS[level]
        by = f"PARTITION BY {parent}" if parent else ""
        source = (f"(SELECT {', '.join(LEVELS[:level + 1])}, sum(cap) AS cap FROM leaf GROUP BY ALL)"
                  + (f" JOIN (SELECT {parent}, budget FROM l{level - 1}) USING ({parent})" if parent else ", total"))
        keep = ", ".join(LEVELS[:level + 1])
        return f"""a{level} AS (SELECT *, {weight(level)} AS w FROM {source}),
b{level} AS (SELECT *, sum(w) OVER ({by}) AS all_w, coalesce(sum(w) OVER o, 0) AS done_w, coalesce(sum(cap) OVER o, 0) AS done_cap
  FROM a{level} WINDOW o AS ({by} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c{level} AS (SELECT *, cap * (all_w - done_w) <= w * (budget - done_cap) AS is_full FROM b{level}),
d{level} AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS full_cap,
  sum(CASE WHEN is_full THEN w ELSE 0 END) OVER ({by}) AS full_w FROM c{level}),
l{level} AS (SELECT {keep}, CASE WHEN is_full THEN cap ELSE (w * (budget - full_cap)) // (all_w - full_w) END AS budget FROM d{level})"""
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n_tokens FROM {documents}),
counts AS (SELECT *, CASE WHEN source = 'src0' THEN 'head' WHEN starts_with(source, 'src1') THEN 'web' ELSE 'curated' END AS domain
  FROM t WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {mix.epochs} AS cap FROM counts GROUP BY ALL),
total AS (SELECT least(sum(cap), floor(sum(supply) * {mix.share})::BIGINT) AS budget FROM leaf),
{split(0)},
{split(1)},
{split(2)},
e AS (SELECT domain, lang, source, budget // supply AS copies, budget % supply AS rest FROM leaf JOIN l2 USING (domain, lang, source)),
f AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{mix.seed}|' || copies || '|' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS run FROM counts JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, copies::BIGINT AS copies,
  greatest(0, least(n_tokens, rest - run))::BIGINT AS part_tokens
FROM f WHERE copies > 0 OR rest > run"""
