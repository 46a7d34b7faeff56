"""Shared passes over many columns at once.

Columns are melted to ``(k, v)`` rows, ``k`` being the position of the column in
the request, and aggregated by ``k``. The plan has the same small size for ten
columns and for a thousand, its code is compiled once, and map-side combining
leaves one row per task and column for the shuffle. Only per-column scalars
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def melt(df: DataFrame, values: dict, **riders: dict) -> DataFrame:
    """Usable cells of the given expressions as ``(k int, v, riders...)``.

    Nulls, NaN and infinities are left out. ``riders`` are per-column literals (a
    bound, a test name) that travel with the cells, so that one short expression over
    ``v`` serves every column. The expressions are projected first and therefore
    evaluated once per row, however often ``v`` is used later.
    """
    flat = df.select(*[value.alias(f"c{k}") for k, value in enumerate(values.values())])
    cells = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("v"),
                 *[F.lit(rider[name]).alias(field) for field, rider in riders.items()])
        for k, name in enumerate(values)
    ])
    usable = F.col("v").isNotNull()
    if flat.schema[0].dataType.typeName() == "double":
        usable = F.abs("v") < float("inf")
    return flat.select(F.inline(cells)).where(usable)


def by_column(df: DataFrame, values: dict, riders: dict | None = None, **metrics: Column) -> dict:
    """Aggregates of ``v`` for every column: ``{name: {metric: value}}``."""
    if not values:
        return {}
    long = melt(df, values, **(riders or {}))
    grouped = long.groupBy("k").agg(*[m.alias(n) for n, m in metrics.items()])
    names = list(values)
    found = {names[row["k"]]: row.asDict() for row in grouped.collect()}
    return {name: found.get(name, {}) for name in names}


def wide(df: DataFrame, metrics: dict, width: int = 120) -> dict:
    """Plain aggregates, ``width`` of them per job so that generated code stays small.

    Each job reads only the columns its own aggregates need.
    """
    keys, out = list(metrics), {}
    for start in range(0, len(keys), width):
        part = keys[start:start + width]
        row = df.agg(*[metrics[key].alias(f"m{i}") for i, key in enumerate(part)]).first()
        out.update({key: row[i] for i, key in enumerate(part)})
    return out


def frequencies(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(k, v, n)``: each distinct cell value of each column with its count.

    A hot value is combined inside every task first, so it costs one row per task.
    """
    return melt(df, values).groupBy("k", "v").agg(F.count("*").alias("n"))


def frequency_summary(df: DataFrame, values: dict, counts: dict | None = None) -> dict[str, dict]:
    """Distinct count, mode and its count per column; ties go to the smallest value.

    With the cell ``counts`` known beforehand, also the Shannon entropy in bits.
    """
    if not values:
        return {}
    names = list(values)
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v")))
    entropy = F.lit(None).cast("double")
    if counts is not None:
        total = F.element_at(F.array(*[F.lit(max(counts[c], 1)) for c in names]), F.col("k") + 1)
        share = F.col("n") / total
        entropy = F.sum(-share * F.log2(share + 1e-12))
    rows = (
        frequencies(df, values).groupBy("k")
        .agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), best.alias("best"),
             entropy.alias("entropy"))
        .select("k", "distinct", "total", F.col("best.v").alias("mode"),
                (-F.col("best.neg")).alias("mode_count"), "entropy")
        .collect()
    )
    found = {names[row["k"]]: row.asDict() for row in rows}
    empty = {"distinct": 0, "total": 0, "mode": None, "mode_count": 0, "entropy": None}
    return {name: found.get(name, empty) for name in names}
