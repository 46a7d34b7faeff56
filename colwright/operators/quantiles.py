"""Exact quantiles without collecting a column in one place.

The built-in exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer. Here a small mergeable sketch first brackets each wanted
rank, then one counting pass aggregates the column into a few line segments plus
the distinct values inside the brackets. Cumulative counts over that short table
give the exact order statistics, and also prove that each bracket held its rank:
a rank found in a plain segment is searched again within that segment. While a
bracket is expected to hold more than ``limit`` values it is sketched again, so
the values shuffled and the state of any task stay bounded whatever the size of
the table or the skew of its values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .melt import by_column, melt

SKETCH_K = 2048
# Rank margin around a sketched quantile, several times its rank error.
MARGIN = 0.004
LIMIT = 250_000


@dataclass
class _Target:
    """One wanted rank (0-based) of one column, inside the closed range [lo, hi]."""

    name: str
    rank: int
    lo: float = -math.inf
    hi: float = math.inf
    below: int = 0
    inside: int = 0
    value: float | None = None


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    counts: dict[str, int] | None = None,
    rank_error: float | None = None,
) -> dict[str, list[float] | None]:
    """Exact quantiles, or with ``rank_error`` values of the columns whose ranks are off by at most that
    share of the column: one pass, a mergeable sketch of bounded size per task and column."""
    if rank_error is None:
        return exact_quantiles(df, values, probabilities, counts)
    if not 0 < rank_error < 1:
        raise ValueError("rank_error is a share of the column, between 0 and 1")
    sketch = F.percentile_approx("v", list(probabilities), math.ceil(1 / rank_error))
    found = by_column(df, values, q=sketch)
    return {name: found[name].get("q") or None for name in values}


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    counts: dict[str, int] | None = None,
    limit: int = LIMIT,
) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of double columns, ``None`` for empty ones."""
    if not values:
        return {}
    if counts is None:
        counts = {n: m.get("n", 0) for n, m in by_column(df, values, n=F.count("v")).items()}
    targets = {
        (name, rank): _Target(name, rank, inside=counts[name])
        for name in values
        for p in probabilities
        for rank in _ranks(counts[name], p)
    }
    unresolved = list(targets.values())
    while unresolved:
        _narrow(df, values, unresolved, limit)
        _resolve(df, values, unresolved)
        unresolved = [t for t in unresolved if t.value is None]
    return {
        name: [_interpolate(targets, name, counts[name], p) for p in probabilities]
        if counts[name] else None
        for name in values
    }


def _ranks(n: int, p: float) -> set[int]:
    if n == 0:
        return set()
    position = (n - 1) * p
    return {math.floor(position), math.ceil(position)}


def _interpolate(targets, name, n, p) -> float:
    position = (n - 1) * p
    low, high = math.floor(position), math.ceil(position)
    a, b = targets[name, low].value, targets[name, high].value
    return a + (b - a) * (position - low)


def _narrow(df, values, targets, limit) -> None:
    """Sketch until every bracket holds few values or a single (repeated) one."""
    while wide := [t for t in targets if t.inside > limit and t.lo < t.hi]:
        _sketch(df, values, wide)
        # One sketch leaves 2 * MARGIN of a column; only a very long column needs
        # its exact counts and another round.
        if long := [t for t in wide if t.inside > limit]:
            _count(df, values, long)


def _in_ranges(df, values, keys) -> DataFrame:
    """Melted ``(k, v, lo, hi)`` for ``keys`` of ``(name, lo, hi)``."""
    return melt(df, {key: values[key[0]] for key in keys}, lo={key: key[1] for key in keys},
                hi={key: key[2] for key in keys})


def _sketch(df, values, targets) -> None:
    keys = list(dict.fromkeys((t.name, t.lo, t.hi) for t in targets))
    wanted = {}
    for t in targets:
        centre = (t.rank - t.below) / max(t.inside - 1, 1)
        wanted[id(t)] = (max(0.0, centre - MARGIN), min(1.0, centre + MARGIN))
    grid = sorted({q for pair in wanted.values() for q in pair})
    rows = (
        _in_ranges(df, values, keys).where("v between lo and hi").groupBy("k")
        .agg(F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("s"))
        .select("k", F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, grid))).alias("q"))
        .collect()
    )
    cuts = {keys[row["k"]]: dict(zip(grid, row["q"])) for row in rows}
    for t in targets:
        low, high = wanted[id(t)]
        found = cuts[t.name, t.lo, t.hi]
        # The ends stay where they are when the margin reaches past them.
        lo = t.lo if low == 0.0 else found[low]
        hi = t.hi if high == 1.0 else found[high]
        t.lo, t.hi = lo, hi
        t.inside = math.ceil(t.inside * 2 * MARGIN) + 1


def _count(df, values, targets) -> None:
    """Exact counts around each bracket.

    A rank on a bracket end is settled there, however often that value repeats; a
    rank inside loses the ends; a missed rank moves its bracket.
    """
    keys = list(dict.fromkeys((t.name, t.lo, t.hi) for t in targets))
    rows = _in_ranges(df, values, keys).groupBy("k").agg(
        F.expr("count_if(v < lo)"), F.expr("count_if(v = lo)"),
        F.expr("count_if(v > lo and v < hi)"), F.expr("count_if(v = hi and lo < hi)"),
        F.expr("count_if(v > hi)"),
    ).collect()
    found = {keys[row[0]]: row[1:] for row in rows}
    for t in targets:
        lo, hi = t.lo, t.hi
        spans = [
            (-math.inf, _before(lo)), (lo, lo), (_after(lo), _before(hi)), (hi, hi),
            (_after(hi), math.inf),
        ]
        start = 0
        for span, size in zip(spans, found[t.name, lo, hi]):
            if t.rank < start + size:
                (t.lo, t.hi), t.below, t.inside = span, start, size
                break
            start += size


def _before(x: float) -> float:
    return math.nextafter(x, -math.inf)


def _after(x: float) -> float:
    return math.nextafter(x, math.inf)


def _union(ranges) -> list[tuple[float, float]]:
    """Overlapping ranges joined, in order."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _resolve(df, values, targets) -> None:
    """One counting pass; reads the values at the wanted ranks off cumulative counts."""
    by_name: dict[str, list[_Target]] = {}
    for t in targets:
        by_name.setdefault(t.name, []).append(t)
    names = list(by_name)
    brackets = {name: _union((t.lo, t.hi) for t in by_name[name]) for name in names}
    width = max(map(len, brackets.values()))
    riders = {}
    for i in range(width):
        # Columns with fewer brackets get one that no value reaches.
        pair = {n: (b + [(math.inf, math.inf)] * width)[i] for n, b in brackets.items()}
        riders |= {f"lo{i}": {n: lo for n, (lo, _) in pair.items()},
                   f"hi{i}": {n: hi for n, (_, hi) in pair.items()}}
    # Number of bracket ends passed: one number per segment of the line.
    passed = " + ".join(f"int(v >= lo{i}) + int(v > hi{i})" for i in range(width))
    inside = " or ".join(f"v between lo{i} and hi{i}" for i in range(width))
    table = (
        melt(df, {name: values[name] for name in names}, **riders)
        .select("k", F.expr(passed).alias("segment"), F.expr(f"if({inside}, v, null)").alias("key"))
        .groupBy("k", "segment", "key").agg(F.count("*").alias("n"))
    )
    running = Window.partitionBy("k").orderBy("segment", "key")
    table = table.withColumn("upto", F.sum("n").over(running))
    wanted = F.create_map(*[
        x for k, name in enumerate(names)
        for x in (F.lit(k), F.array(*[F.lit(r) for r in sorted({t.rank for t in by_name[name]})]))
    ])
    first = F.col("upto") - F.col("n")
    hits = table.where(
        F.exists(F.element_at(wanted, F.col("k")), lambda r: (r >= first) & (r < F.col("upto")))
    )
    for row in hits.collect():
        start = row["upto"] - row["n"]
        for t in by_name[names[row["k"]]]:
            if not start <= t.rank < row["upto"]:
                continue
            if row["key"] is not None:
                t.value = row["key"]
            else:
                _move(t, start, row["n"], row["segment"], brackets[t.name])


def _move(t: _Target, start: int, size: int, segment: int, brackets) -> None:
    """The rank lies between two brackets: that open segment is the new bracket."""
    starts = [(lo, _before(lo)) for lo, _ in brackets]
    stops = [(hi, _after(hi)) for _, hi in brackets]
    ends = sorted(starts + stops)
    t.lo = ends[segment - 1][1] if segment > 0 else -math.inf
    t.hi = ends[segment][1] if segment < len(ends) else math.inf
    t.below, t.inside = start, size
