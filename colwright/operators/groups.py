"""Profiles of every column within every group of rows.

The rows of a group meet once, in one task, as typed cells: numbers and times in eight bytes, long text as its
digest. There they lie side by side, so each column of a group is sorted on its own, and counts, quartiles,
outliers and shape are exact; a task holds the groups of one batch at a time. Groups with too many cells for
that (``CELLS``) are melted instead: their counts are combined inside the tasks, so a group that holds a third
of all rows is one row per task and column in their shuffle; a sketch says where their quartiles lie, the cells
there are ranked exactly, and their distinct cells, combined by value, meet the fences of their group by
broadcast. Only the types of the columns, the number of rows and the names of those large groups reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs as X, fixed
from .profiling import type_rows

ACCURACY = 10_000  # of the sketch that says where to look for the quartiles of a melted group
CELLS = 2_000_000  # cells that one task measures side by side, those of one group included
MEASURES = ("g string, k int, total bigint, filled bigint, n bigint, bad bigint, skew double, "
            "unique bigint, out bigint")


def _cells(position: int, name: str, kind: str, col_type: str) -> list[Column]:
    """One cell as ``v``, the value that counts as distinct, and where they need a column of their own
    ``x``, its number, and ``b``, whether it is unreadable as the type of its column."""
    numeric = col_type in fixed.NUMERIC_TYPES
    cell = value = X.finite(X.ref(name)) if kind == "number" else X.ref(name)
    if kind not in ("number", "datetime"):
        value = X.text(value)
        # Text of 64 characters and more never equals a digest of 64 from shorter text.
        value = F.when(F.octet_length(value) < 64, value).otherwise(F.sha2(value, 256))
    out = [value.alias(f"v{position}")]
    if numeric and kind != "number":
        out.append(X.to_profile_number(X.ref(name), kind).alias(f"x{position}"))
    bad = None
    if col_type == "date" and kind != "datetime":
        bad = X.to_datetime(X.ref(name), kind, True).isNull()
    elif col_type == "email":
        bad = ~X.is_email(X.lower_strip(X.ref(name)))
    elif col_type == "boolean":
        bad = ~X.lower_strip(X.ref(name)).isin(*fixed.TRUE_TOKENS, *fixed.FALSE_TOKENS)
    if bad is not None:
        out.append((cell.isNotNull() & bad).alias(f"b{position}"))
    return out


def _side_by_side(columns: list[str], numeric: list[bool], batch_rows: int):
    """Arrow function over rows that come group by group; complete groups are measured together."""
    place = {c: i for i, c in enumerate(columns)}

    def codes(column):
        """Cells as numbers that sort with the missing ones last, and from which number on they are missing."""
        if pa.types.is_floating(column.type):
            return column.to_numpy(zero_copy_only=False) + 0.0, np.inf
        found = column.dictionary_encode()
        size = len(found.dictionary)
        return found.indices.fill_null(size).to_numpy(zero_copy_only=False).astype("int32"), size

    def sums(of, starts):
        return np.add.reduceat(of.astype("int64"), starts)

    def ordered(values, starts, ends):
        values = values.copy()
        for a, z in zip(starts.tolist(), ends.tolist()):
            values[a:z].sort()
        return values

    def distinct(values, there, starts):
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[starts] = True
        return sums(new & there, starts)

    def shape(x, starts, lengths):
        """Numbers, fences, outliers and skewness of each group; ``x`` is sorted, gaps last."""
        there = ~np.isnan(x)
        n = sums(there, starts)
        at = lambda share: x[starts + np.maximum(np.ceil(share * n).astype("int64") - 1, 0)]
        low, high = at(0.25), at(0.75)
        reach = np.where((n >= 4) & (high > low), 1.5 * (high - low), np.nan)
        out = sums((x < np.repeat(low - reach, lengths)) | (x > np.repeat(high + reach, lengths)), starts)
        mean = np.add.reduceat(np.where(there, x, 0.0), starts) / np.maximum(n, 1)
        off = np.where(there, x - np.repeat(mean, lengths), 0.0)
        square, cube = np.add.reduceat(off * off, starts), np.add.reduceat(off * off * off, starts)
        flat = (n == 0) | (x[starts] == x[starts + np.maximum(n - 1, 0)])
        skew = np.where(flat, np.nan, np.sqrt(n) * cube / np.where(flat, 1.0, square ** 1.5))
        return n, out, skew

    def measured(rows, starts):
        ends = np.append(starts[1:], len(rows))
        lengths, zeros = ends - starts, np.zeros(len(starts), "int64")
        keys = rows.column(0).take(pa.array(starts))
        for k in range(len(numeric)):
            cells, gap = codes(rows.column(place[f"v{k}"]))
            cells = ordered(cells, starts, ends)
            there = cells < gap
            filled, unique = sums(there, starts), distinct(cells, there, starts)
            n, out, skew, bad = zeros, zeros, np.full(len(starts), np.nan), zeros
            if numeric[k]:
                x = cells
                if f"x{k}" in place:
                    x = ordered(codes(rows.column(place[f"x{k}"]))[0], starts, ends)
                n, out, skew = shape(x, starts, lengths)
                bad = filled - n
            elif f"b{k}" in place:
                bad = sums(rows.column(place[f"b{k}"]).fill_null(False).to_numpy(zero_copy_only=False), starts)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.full(len(starts), k, "int32")), *map(pa.array, (lengths, filled, n, bad, skew, unique, out))],
                names=["g", "k", "total", "filled", "n", "bad", "skew", "unique", "out"])

    def whole(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def beginnings(rows):
        group = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)

    def run(batches):
        held, count, due = [], 0, batch_rows
        with np.errstate(all="ignore"):
            for batch in batches:
                if not len(batch):
                    continue
                held.append(batch)
                count += len(batch)
                if count < due:
                    continue
                rows = whole(held)
                starts = beginnings(rows)
                if len(starts) > 1:  # the last group may go on
                    yield from measured(rows.slice(0, starts[-1]), starts[:-1])
                    rows = rows.slice(starts[-1])
                held, count = [rows], len(rows)
                due = count + batch_rows
            if held:
                rows = whole(held)
                yield from measured(rows, beginnings(rows))

    return run


def _with_fences(shape: DataFrame, values: DataFrame) -> DataFrame:
    """Adds the fences ``lo`` and ``hi`` of each large group and column. The cells between the neighbours of a
    quartile, one in 2,500, are gathered; those below are counted, so the quartile is found exactly."""
    x, near = F.col("x"), shape.select(F.col("g").alias("g1"), F.col("k").alias("k1"), "q").where("q is not null")
    sides = values.where("x is not null").join(  # one row per large group and column
        F.broadcast(near), F.col("g").eqNullSafe(F.col("g1")) & (F.col("k") == F.col("k1")))
    found = sides.groupBy("g1", "k1").agg(*[
        c for i, name in ((0, "low"), (2, "high")) for c in (
            F.sum(F.when(x < F.col("q")[i], F.col("rows")).otherwise(0)).alias(f"below_{name}"),
            F.collect_list(F.when(x.between(F.col("q")[i], F.col("q")[i + 1]), F.struct("x", "rows"))).alias(f"near_{name}"))])

    def at(share, name):
        rank = F.greatest(F.ceil(F.col("n") * share), F.lit(1))
        begin = F.struct(F.col(f"below_{name}").cast("bigint").alias("rows"), F.lit(None).cast("double").alias("x"))
        return F.aggregate(F.array_sort(f"near_{name}"), begin, lambda seen, e: F.when(seen["rows"] >= rank, seen).otherwise(
            F.struct((seen["rows"] + e["rows"]).alias("rows"), e["x"].alias("x"))))["x"]

    shape = shape.join(F.broadcast(found), F.col("g").eqNullSafe(F.col("g1")) & (F.col("k") == F.col("k1")), "left")
    shape = shape.withColumns({"low": at(0.25, "low"), "high": at(0.75, "high")})
    reach = F.when((F.col("n") >= 4) & (F.col("high") > F.col("low")), 1.5 * (F.col("high") - F.col("low")))
    return shape.select("g", "k", "total", "filled", "n", "bad", "skew", (F.col("low") - reach).alias("lo"), (F.col("high") + reach).alias("hi"))


def _melted(rows: DataFrame, numeric: list[bool]) -> DataFrame:
    """The measures of few, large groups."""
    typed = {f.name: X.kind_of(f.dataType) for f in rows.schema.fields}

    def cell(k):
        number = typed[f"v{k}"] == "number"
        v, nothing = F.col(f"v{k}"), F.lit(None)
        x = F.col(f"x{k}") if f"x{k}" in typed else (v if numeric[k] else nothing.cast("double"))
        # Numbers are kept as such; other cells as text.
        text, value = (nothing.cast("string"), v) if number else (v.cast("string"), nothing.cast("double"))
        bad = v.isNotNull() & x.isNull() if numeric[k] else F.coalesce(
            F.col(f"b{k}") if f"b{k}" in typed else F.lit(False), F.lit(False))
        return F.struct(F.lit(k).alias("k"), text.alias("s"), value.alias("d"), x.alias("x"), bad.alias("bad"))

    cells = rows.select("g", F.inline(F.array(*map(cell, range(len(numeric))))))
    there = F.col("s").isNotNull() | F.col("d").isNotNull()
    step = 2 / ACCURACY  # the sketch is off by half of it at most, so a quartile lies between its two neighbours
    shape = cells.groupBy("g", "k").agg(
        F.count("*").alias("total"), F.count_if(there).alias("filled"), F.count("x").alias("n"),
        F.count_if("bad").alias("bad"), F.skewness("x").alias("skew"),
        F.percentile_approx("x", [0.25 - step, 0.25 + step, 0.75 - step, 0.75 + step], ACCURACY).alias("q"))
    values = cells.where(there).groupBy("g", "k", "s", "d").agg(F.count("*").alias("rows"), F.first("x").alias("x"))
    shape = _with_fences(shape, values)
    # One row per large group and column.
    met = values.alias("a").join(
        F.broadcast(shape.select("g", "k", "lo", "hi")).alias("b"),
        F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.k") == F.col("b.k")))
    spread = met.groupBy(F.col("a.g").alias("g2"), F.col("a.k").alias("k2")).agg(
        F.count("*").alias("unique"), F.sum(F.when((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi")), F.col("rows"))).alias("out"))
    return shape.join(spread, F.col("g").eqNullSafe(F.col("g2")) & (F.col("k") == F.col("k2")), "left").select(
        "g", "k", "total", "filled", "n", "bad", "skew", F.coalesce("unique", F.lit(0)).alias("unique"),
        F.coalesce("out", F.lit(0)).alias("out"))


def _measures(df: DataFrame, group: Column, names: list[str], of_kind: dict, types: dict) -> DataFrame:
    numeric = [types[c] in fixed.NUMERIC_TYPES for c in names]
    limit = max(CELLS // len(names), 1)
    large = F.col("count") > limit
    sizes = df.groupBy(group.cast("string").alias("g")).count().agg(
        F.sum(F.when(~large, F.col("count"))).alias("rows"), F.collect_list(F.when(large, F.struct("g"))).alias("large")).first()
    rows = df.select(group.cast("string").alias("g"), *[
        cell for i, c in enumerate(names) for cell in _cells(i, c, of_kind[c], types[c])])

    def side(kind):  # as such a join filters, Spark has it below the projection
        hot = df.sparkSession.createDataFrame([(r["g"],) for r in sizes["large"]], "hot string")
        return rows.join(F.broadcast(hot), F.col("g").eqNullSafe(F.col("hot")), kind) if sizes["large"] else rows

    parts = []
    if sizes["rows"] or not sizes["large"]:
        tasks = max(math.ceil((sizes["rows"] or 0) / (2 * limit)), 1)
        run = _side_by_side(rows.columns, numeric, max(limit // 8, 1))
        parts.append(side("left_anti").repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(run, MEASURES))
    if sizes["large"]:
        parts.append(_melted(side("left_semi"), numeric))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def profile_groups(df: DataFrame, group: Column, types: dict[str, str] | None = None) -> DataFrame:
    """(group_key, column_name, col_type, total_rows, missing_count, missing_rate, unique_count, unique_ratio,
    invalid_numeric_count, outlier_count_iqr, invalid_date_count, invalid_email_count, skewness): a row for
    each group and column.

    ``group`` is any expression over the rows; rows where it is null form a group of their own. Types are
    those of the whole columns unless given; only columns with a type are measured. Quartiles are cells of
    the group, not interpolated. Nested columns are left out; an empty table has no groups.
    """
    of_kind = X.kinds(df)
    if types is None:
        types = {r["column_name"]: r["semantic_type"] for r in type_rows(df, "cleaning", False)}
    names = list(types)
    measures = _measures(df, group, names, of_kind, types)

    def of(values):
        return F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)

    kind, n = of(types.values()), F.col("n")
    skew = F.when(n >= 3, F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)) * F.sqrt(n * (n - 1.0)) / (n - 2))
    missing = F.col("total") - F.col("filled")
    invalid = lambda *kinds: F.when(kind.isin(*kinds), F.col("bad")).otherwise(F.lit(0))
    return measures.select(
        F.col("g").alias("group_key"), of(names).alias("column_name"), kind.alias("col_type"),
        F.col("total").alias("total_rows"), missing.alias("missing_count"),
        F.round(missing / F.col("total"), 4).alias("missing_rate"), F.col("unique").alias("unique_count"),
        F.round(F.col("unique") / F.col("total"), 4).alias("unique_ratio"),
        invalid(*fixed.NUMERIC_TYPES, "boolean").alias("invalid_numeric_count"),
        F.col("out").alias("outlier_count_iqr"), invalid("date").alias("invalid_date_count"),
        invalid("email").alias("invalid_email_count"),
        F.coalesce(F.round(skew, 4), F.lit(0.0)).alias("skewness"))
