"""Exact quantiles against sorted lists, whatever the skew and the memory limit."""

import random

import pytest
from pyspark.sql import functions as F

from colwright.operators import quantiles
from colwright.operators.quantiles import exact_quantiles
from colwright.operators.stats import grouped_median

PROBABILITIES = (0.0, 0.001, 0.25, 0.5, 0.75, 1.0)


def expected(values, p):
    values = sorted(values)
    position = (len(values) - 1) * p
    low = int(position)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (position - low)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    n = 20_000
    return {
        "smooth": [rng.gauss(0, 1) for _ in range(n)],
        "hot": [7.0 if rng.random() < 0.4 else rng.random() * 10 for _ in range(n)],
        "two": [float(rng.random() < 0.5) for _ in range(n)],
        "wild": [rng.choice((-1, 1)) * 10.0 ** rng.randint(-30, 30) for _ in range(n)],
        "gaps": [rng.random() if rng.random() < 0.3 else None for _ in range(n)],
        "empty": [None] * n,
    }


@pytest.mark.parametrize("limit, margin", [(250_000, 0.004), (500, 0.004), (100, 0.00001)])
def test_exact(spark, table, monkeypatch, limit, margin):
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    names = list(table)
    df = spark.createDataFrame(
        list(zip(*table.values())), ", ".join(f"{n} double" for n in names)).repartition(4)
    got = exact_quantiles(df, {n: F.col(n) for n in names}, PROBABILITIES, limit=limit)
    assert got.pop("empty") is None
    for name, found in got.items():
        values = [v for v in table[name] if v is not None]
        for p, q in zip(PROBABILITIES, found):
            assert q == pytest.approx(expected(values, p), rel=1e-12, abs=1e-300), (name, p)


def test_grouped_median(spark, table):
    rows = [("a" if i % 3 else f"g{i % 30}", v) for i, v in enumerate(table["hot"])]
    df = spark.createDataFrame(rows + [("one", 4.0), ("pair", 1.0), ("pair", 2.0)], "g string, y double")
    got = {r["g"]: r["value"] for r in grouped_median(df, ["g"]).collect()}
    groups = {}
    for g, v in rows + [("one", 4.0), ("pair", 1.0), ("pair", 2.0)]:
        groups.setdefault(g, []).append(v)
    assert got == pytest.approx({g: expected(v, 0.5) for g, v in groups.items()})
