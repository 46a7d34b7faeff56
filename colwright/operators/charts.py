"""Chart data sets. Each function returns a small aggregated DataFrame."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exprs as X
from ..sources.tables import check_columns
from .profiling import date_orders, moments
from .quantiles import quantiles
from .stats import grouped


def filter_rows(df: DataFrame, filters) -> DataFrame:
    """Rows that pass every filter; filters that cannot be applied are ignored (``build_chart`` notes them).

    A filter is ``{"column", "operator", "value"}`` with ``== != > < >= <= contains``; the value of
    ``contains`` is a regular expression.
    """
    conditions = [c for c, _ in _conditions(df, filters) if c is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _conditions(df: DataFrame, filters) -> list[tuple[Column | None, str]]:
    """Each filter's condition and its words, or None and why it is ignored."""
    of_kind, out = X.kinds(df), []
    for f in filters or []:
        column, operator, value = f.get("column"), f.get("operator", "=="), f.get("value")
        words = f"{column} {operator} {value}"
        if column not in of_kind:
            out.append((None, f"{words}: no such column"))
            continue
        condition = _condition(X.ref(column), of_kind[column], operator, value)
        why = {"contains": "no regular expression"}.get(operator, "no number" if operator in ORDERINGS else "no such operator")
        out.append((condition, words if condition is not None else f"{words}: {why}"))
    return out


ORDERINGS = (">", "<", ">=", "<=")


def _condition(c: Column, kind: str, operator: str, value) -> Column | None:
    if operator in ("==", "!="):
        if kind == "number" and _is_number(value):
            whole = str(value).strip().lstrip("+-").isdigit()
            equal = c.eqNullSafe(F.lit(int(value))) if whole \
                else X.to_number(c, kind).eqNullSafe(F.lit(float(value)))
        else:
            equal = X.text(c).eqNullSafe(F.lit(str(value)))
        return equal if operator == "==" else ~equal
    if operator == "contains":
        return X.text(c).rlike(f"(?i){value}") if _is_pattern(value) else None
    if not _is_number(value):
        return None
    number = X.to_number(c, kind)
    compare = {">": number.__gt__, "<": number.__lt__, ">=": number.__ge__, "<=": number.__le__}
    return compare[operator](float(value)) if operator in compare else None


def _is_pattern(value) -> bool:
    try:
        re.compile(str(value))
    except re.error:
        return False
    return True


def _is_number(value) -> bool:
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return True


def scatter(df: DataFrame, x: str, y: str, group_by=None, key=None, max_points=None) -> DataFrame:
    """``x, y[, group]`` points: all, or a repeatable sample of ``max_points``.

    Rows are ranked by a digest of ``key`` (default: the point itself), so the sample
    does not depend on partitioning, and only the best rows of each task travel.
    """
    names = list(key or [c for c in (x, y, group_by) if c])
    columns = [X.ref(x).alias("x"), X.ref(y).alias("y")]
    if group_by:
        columns.append(X.text(X.ref(group_by)).alias("group"))
    digest = F.md5(F.concat_ws("|", *[X.text(X.ref(c)) for c in names]))
    points = df.where(X.ref(x).isNotNull() & X.ref(y).isNotNull())
    if max_points is None:
        return points.select(*columns)
    points = points.select(
        *columns, digest.alias("digest"), F.struct(*map(X.ref, names)).alias("tie"))
    return points.orderBy("digest", "tie").limit(max_points).drop("digest", "tie")


def bar(df: DataFrame, x: str, y=None, aggregation=None, sort_by=None, sort_asc=True, top_n=None):
    """``name, value``: frequency of ``x``, or an aggregate of ``y`` by ``x``."""
    if y is None or y == "count":
        counts = df.where(X.ref(x).isNotNull()).groupBy(X.ref(x)).agg(F.count("*").alias("value"))
        table, ascending = counts, False
    else:
        table = grouped(df, [x], y, aggregation)
        ascending = sort_asc if sort_by == "value" else False
    value = F.col("value").asc() if ascending else F.col("value").desc()
    table = table.orderBy(value, X.ref(x))
    if top_n:
        table = table.limit(top_n)
    return table.select(X.text(X.ref(x)).alias("name"), "value")


def grouped_bar(df: DataFrame, x: str, group_by: str, y=None, aggregation=None, top_n=None,
                wide: bool = True) -> DataFrame:
    """One row per ``x`` with a column per group, zero where a combination is absent.

    ``wide=False`` gives ``name, series, value`` rows of the combinations that occur, and so do
    groups with more values than MOST_SERIES, which a table cannot have as columns.
    """
    if y is None or y == "count":
        rows = df.select(X.ref(x), X.ref(group_by)).dropna()
        cells = rows.groupBy(X.ref(x), X.ref(group_by)).agg(F.count("*").alias("value"))
    else:
        cells = grouped(df, [x, group_by], y, aggregation)
    if top_n:
        # The first names in sort order; the list is as long as the chart.
        first = cells.select(X.ref(x)).distinct().orderBy(X.ref(x)).limit(top_n)
        cells = cells.join(first, x, "left_semi")
    cells = cells.select(
        X.ref(x).alias("name"), X.text(X.ref(group_by)).alias("series"), "value")
    if not wide or _too_many(cells):
        return cells.select(X.text(F.col("name")).alias("name"), "series", "value")
    # Combinations are unique by now, so the pivot only moves small cells around.
    table = cells.groupBy("name").pivot("series").agg(F.first("value")).orderBy("name")
    return table.select(
        X.text(F.col("name")).alias("name"),
        *[F.coalesce(X.ref(c), F.lit(0)).alias(c) for c in table.columns[1:]])


MOST_SERIES = 1000


def _too_many(cells: DataFrame) -> bool:
    return cells.select("series").distinct().limit(MOST_SERIES + 1).count() > MOST_SERIES


def line(df: DataFrame, x: str, y: str, aggregation=None, group_by=None, wide: bool = True,
         raw_points: bool = False):
    """``date, value`` in date order; one column per group with ``group_by``.

    Values are aggregated per date, or shown point by point with ``raw_points``.
    """
    kind = X.kinds(df)
    orders = date_orders(df, [x]) if kind[x] == "string" else {}
    stamp = X.to_datetime(X.ref(x), kind[x], orders.get(x))
    number = X.to_number(X.ref(y), kind[y])
    columns = [stamp.alias("stamp"), number.alias("y")]
    if group_by:
        columns.append(X.text(X.ref(group_by)).alias("series"))
    points = df.select(*columns).where(F.col("stamp").isNotNull() & F.col("y").isNotNull())
    day = F.date_format("stamp", "yyyy-MM-dd").alias("date")
    if group_by:
        cells = grouped(points.where("series is not null"), ["stamp", "series"], "y", aggregation)
        if not wide or _too_many(cells):
            return cells.orderBy("stamp", "series").select(day, "series", "value")
        table = cells.groupBy("stamp").pivot("series").agg(F.first("value")).orderBy("stamp")
        return table.select(day, *[X.ref(c) for c in table.columns[1:]])
    if raw_points:
        return points.orderBy("stamp", "y").select(day, F.col("y").alias("value"))
    return grouped(points, ["stamp"], "y", aggregation).orderBy("stamp").select(day, "value")


def histogram(df: DataFrame, x: str, max_values=None) -> DataFrame:
    """``bin, bin_from, bin_to, count``: equal-width bins, the last one closed.

    A column without numbers gives its values by frequency instead: all, or ``max_values``.
    """
    spark = df.sparkSession
    value = X.to_number(X.ref(x), X.kinds(df)[x])
    n, lo, hi = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if not n:
        cell = F.coalesce(X.text(X.ref(x)), F.lit("nan"))
        values = (df.groupBy(cell.alias("bin")).agg(F.count("*").alias("count"))
                  .orderBy(F.desc("count"), "bin"))
        return (
            (values if max_values is None else values.limit(max_values))
            .select("bin", F.lit(None).cast("double").alias("bin_from"),
                    F.lit(None).cast("double").alias("bin_to"), "count"))
    bins = min(30, max(5, n // 20))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    edge = lambda i: F.lit(lo) + i * F.lit(step)
    v = F.col("v")
    guess = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
    # The division can land one bin off; the edges decide.
    index = (
        F.when(v < edge(F.col("i")), F.col("i") - 1)
        .when((v >= edge(F.col("i") + 1)) & (F.col("i") < bins - 1), F.col("i") + 1)
        .otherwise(F.col("i"))
    )
    counts = (
        df.select(value.alias("v")).where("v is not null").select("v", guess.alias("i"))
        .select(index.alias("i")).groupBy("i").agg(F.count("*").alias("count")))
    every = spark.range(bins).withColumnRenamed("id", "i")
    last = F.when(F.col("i") == bins - 1, F.lit(hi)).otherwise(edge(F.col("i") + 1))
    # At most 30 rows on either side.
    return every.join(F.broadcast(counts), "i", "left").orderBy("i").select(
        F.format_string("%.2f–%.2f", edge(F.col("i")), last).alias("bin"),
        F.round(edge(F.col("i")), 4).alias("bin_from"), F.round(last, 4).alias("bin_to"),
        F.coalesce("count", F.lit(0)).alias("count"))


def box(df: DataFrame, x: str, y=None, rank_error: float | None = None) -> DataFrame:
    """One row: extremes, quartiles, fences, and how many values lie below and above the fences.

    The values themselves, which can be many, are the rows of ``box_outliers``.
    """
    column = y if y and y != "count" else x
    values = {column: X.to_number(X.ref(column), X.kinds(df)[column])}
    shape = moments(df, values)[column]
    schema = ("name string, min_value double, q1 double, median double, q3 double, "
              "max_value double, lower_fence double, upper_fence double, low_outliers long, high_outliers long")
    if shape["n"] < 5:
        return df.sparkSession.createDataFrame([], schema)
    q1, q2, q3 = quantiles(df, values, counts={column: shape["n"]}, rank_error=rank_error)[column]
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    v = values[column]
    below, above = df.agg(F.count_if(v < lo), F.count_if(v > hi)).first()
    row = (column, shape["low"], q1, q2, q3, shape["high"], lo, hi, below, above)
    return df.sparkSession.createDataFrame([row], schema)


def box_outliers(df: DataFrame, x: str, y=None, max_points=None) -> DataFrame:
    """``name, value, side`` of every value outside the fences of ``box``, or of the ``max_points``
    that lie farthest out."""
    frame = box(df, x, y).first()
    if frame is None:
        return df.sparkSession.createDataFrame([], "name string, value double, side string")
    column, lo, hi = frame["name"], frame["lower_fence"], frame["upper_fence"]
    v = F.col("value")
    rows = (df.select(F.lit(column).alias("name"), X.to_number(X.ref(column), X.kinds(df)[column]).alias("value"))
            .where((v < lo) | (v > hi)).withColumn("side", F.when(v < lo, "low").otherwise("high")))
    if max_points is None:
        return rows
    return rows.orderBy(F.greatest(lo - v, v - hi).desc(), "value").limit(max_points)


def pie(df: DataFrame, x: str, y=None, aggregation=None, top_n=None) -> DataFrame:
    """``name, value, pct``: largest slices; shares are of the slices kept."""
    counting = not y or y == "count" or y not in df.columns
    table = bar(df, x, None if counting else y, aggregation or "sum", top_n=top_n)
    total = F.sum("value").over(Window.partitionBy(F.lit(0)))
    if top_n:
        shared = table.withColumn("total", total)
    else:
        # An uncut pie can have any number of slices: total them apart.
        whole = table.agg(F.sum("value")).first()[0]
        shared = table.withColumn("total", F.lit(whole))
    pct = F.coalesce(F.round(F.try_divide(F.col("value") * F.lit(100.0), "total"), 1), F.lit(0.0))
    return shared.select("name", "value", pct.alias("pct"))


def chart_data(df: DataFrame, chart_type: str, x: str, y=None, aggregation=None, group_by=None,
               filters=None, sort_by=None, sort_asc=True, top_n=None, key=None, max_points=None,
               max_values=None, raw_points=False, wide=True, rank_error=None) -> DataFrame:
    """Data set of one chart. Unknown columns and chart types are errors.

    ``wide=False`` keeps grouped bars and lines in long form, for any number of groups;
    ``rank_error`` takes the quartiles of a box from a sketch.
    """
    check_columns(df, [x] + ([y] if y and y != "count" else []))
    if group_by and group_by not in df.columns:
        group_by = None
    rows = filter_rows(df, filters)
    kind = chart_type.lower()
    if kind == "scatter":
        return scatter(rows, x, y, group_by, key, max_points)
    if kind in ("bar", "grouped_bar"):
        if group_by:
            return grouped_bar(rows, x, group_by, y, aggregation, top_n, wide)
        return bar(rows, x, y, aggregation, sort_by, sort_asc, top_n)
    if kind == "line":
        return line(rows, x, y, aggregation, group_by, wide, raw_points)
    if kind == "histogram":
        return histogram(rows, x, max_values)
    if kind == "box":
        return box(rows, x, y, rank_error)
    if kind == "pie":
        return pie(rows, x, y, aggregation, top_n)
    raise ValueError(f"Unknown chart type '{chart_type}'.")


class Chart(NamedTuple):
    """data is None where there is nothing to draw; notes then say why."""

    data: DataFrame | None
    notes: DataFrame
    title: str


NOTES = "position int, kind string, subject string, rows bigint"
FEWEST_FOR_BOX = 5
_TITLES = {"scatter": "{x} vs {y}", "line": "{y} over {x}", "histogram": "Distribution of {x}", "pie": "{x} share"}


def build_chart(df: DataFrame, chart_type: str, x: str, y=None, aggregation=None, group_by=None, filters=None, title=None,
                max_points=None, **options) -> Chart:
    """A chart with its title and notes on what did not go into it.

    notes: (position, kind, subject, rows). Kinds: ``ignored_group``; ``ignored_filter``, with the reason;
    ``kept``, the rows left after each filter; ``unusable``, rows left without a value the chart can draw;
    ``sampled``, points left out of a sample; ``no_rows``, nothing left after the filters; ``too_few``, not
    enough numbers for a box. All counts come from one pass with a partial row per task. A chart
    without rows has no data, which is an answer, not an error; unknown columns and types are errors.
    """
    kind, of_kind = chart_type.lower(), X.kinds(df)
    check_columns(df, [x] + ([y] if y and y != "count" else []))
    notes: list[tuple] = []
    if group_by and group_by not in df.columns:
        notes.append(("ignored_group", group_by, None))
        group_by = None
    conditions = _conditions(df, filters)
    passed, counts = F.lit(True), {"all": F.count("*")}
    for i, (condition, _) in enumerate(conditions):
        if condition is not None:
            passed = passed & F.coalesce(condition, F.lit(False))
            counts[f"f{i}"] = F.count_if(passed)
    usable = _drawable(kind, x, y, of_kind)
    counts |= {"left": F.count_if(passed), "usable": F.count_if(passed & usable)}
    found = df.agg(*[c.alias(n) for n, c in counts.items()]).first()
    for i, (condition, words) in enumerate(conditions):
        notes.append(("ignored_filter", words, None) if condition is None else ("kept", words, found[f"f{i}"]))
    drawn = found.usable
    if not found.left:
        notes.append(("no_rows", "", 0))
    else:
        if drawn < found.left:
            notes.append(("unusable", y if kind in ("scatter", "line", "box") and y and y != "count" else x, found.left - drawn))
        if kind == "scatter" and max_points is not None and drawn > max_points:
            notes.append(("sampled", f"{max_points} points", drawn - max_points))
        if kind == "box" and drawn < FEWEST_FOR_BOX:
            notes.append(("too_few", y if y and y != "count" else x, drawn))
    nothing = not found.left or any(n[0] == "too_few" for n in notes)
    table = df.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(notes)], NOTES)
    data = None if nothing else chart_data(df, chart_type, x, y, aggregation, group_by, filters, max_points=max_points, **options)
    words = title or _TITLES.get(kind, "{x} by {y}" if y and y != "count" else "{x}").format(x=x, y=y)
    return Chart(data, table, words)


def _drawable(kind: str, x: str, y, of_kind: dict) -> Column:
    """Whether a row has the values that the chart draws."""
    there = X.ref(x).isNotNull()
    number = lambda c: X.to_number(X.ref(c), of_kind[c]).isNotNull()
    has_y = bool(y) and y != "count"
    if kind == "scatter":
        return there & X.ref(y).isNotNull()
    if kind == "line":
        return X.to_datetime(X.ref(x), of_kind[x], True).isNotNull() & number(y)
    if kind == "box":
        return number(y if has_y else x)
    if kind == "histogram":
        return there
    return there & number(y) if has_y else there
