"""Raw against cleaned: change log, totals, missing-value scorecard, raw snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exprs as X, fixed
from ..sources.staging import stage
from ..sources.tables import blanks_to_null
from .melt import by_column
from .profiling import missing_counts


def change_tag(raw: Column, clean: Column) -> Column:
    """FILLED, FLAGGED, FIXED, MISSING or OK, on trimmed text; null counts as empty."""
    return (
        F.when((raw == "") & (clean == ""), "MISSING").when(raw == "", "FILLED")
        .when(clean == "", "FLAGGED").when(raw != clean, "FIXED").otherwise("OK")
    )


def _cell_text(c: Column) -> Column:
    return F.coalesce(X.strip(X.text(c)), F.lit(""))


def change_rows(df: DataFrame, key: Column, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``(key, column_name, raw_value, clean_value, change_type)`` for every cell pair of a row."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("column_name"), _cell_text(raw).alias("raw_value"),
                 _cell_text(clean).alias("clean_value"))
        for name, (raw, clean) in pairs.items()
    ])
    long = df.select(key, F.inline(cells))
    return long.withColumn("change_type", change_tag(F.col("raw_value"), F.col("clean_value")))


def compare(raw: DataFrame, clean: DataFrame, key: str, columns=None) -> DataFrame:
    """Cell diff of two tables matched on ``key``, a unique row key of both; a repeated key is an error.

    Cells of rows that only one table holds are tagged REMOVED or ADDED; a null key
    matches a null key. The rows are joined before the columns are melted, so each table is shuffled
    once at its own width.
    """
    names = [c for c in (columns or raw.columns) if c != key and c in clean.columns]
    for side, rows in (("raw", raw), ("cleaned", clean)):
        if not rows.groupBy(X.ref(key)).count().where("count > 1").isEmpty():
            raise ValueError(f"'{key}' is no unique key of the {side} table; compare by position instead.")
    return _matched(raw, clean, key, names)


def _matched(raw: DataFrame, clean: DataFrame, key: str, names: list[str]) -> DataFrame:
    left = raw.select(X.ref(key).alias("k"), F.struct(*[X.ref(c) for c in names]).alias("raw"))
    right = clean.select(X.ref(key).alias("k"), F.struct(*[X.ref(c) for c in names]).alias("clean"))
    pairs = {c: (F.col("raw").getField(c), F.col("clean").getField(c)) for c in names}
    right = right.withColumnRenamed("k", "k2")
    both = left.join(right, F.col("k").eqNullSafe(F.col("k2")), "full_outer")
    both = both.withColumn("row_state", F.when(F.col("clean").isNull(), "REMOVED")
                           .when(F.col("raw").isNull(), "ADDED"))
    found = change_rows(both, F.struct(F.coalesce("k", "k2").alias(key), "row_state").alias("row"), pairs)
    return found.select(
        X.ref("row").getField(key).alias(key), "column_name", "raw_value", "clean_value",
        F.coalesce(F.col("row.row_state"), "change_type").alias("change_type"))


def positioned(df: DataFrame, name: str = "row_position") -> DataFrame:
    """The rows with their position from 0, in the order of the files they are read from (file, then
    byte range), else in the order of the partitions.

    Rows are written once with their place in their range; ranges are counted, and the counts before
    a range give its offset. No task sees all rows, and only a row per range is summed in order.
    """
    place = {"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start")}
    try:
        rows = df.select("*", *[c.alias(n) for n, c in place.items()])
    except AnalysisException:  # no files below: the partitions are the ranges
        rows = df.withColumns({"__file": F.lit(""), "__start": F.spark_partition_id().cast("bigint")})
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "positions")
    ranges = rows.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    found = rows.join(offsets, ["__file", "__start"]).withColumn(name, F.expr("__offset + __row - __first"))
    return found.select(*map(X.ref, df.columns), X.ref(name))


def compare_by_position(raw: DataFrame, clean: DataFrame, columns=None, name: str = "row_position") -> DataFrame:
    """Cell diff of two tables matched row by row, for tables without a key.

    Rows are numbered by ``positioned`` unless a table has the column ``name`` already, as the tables
    of ``clean_by_position`` do. Cells of rows that only one table holds are tagged REMOVED or ADDED.
    """
    left, right = (t if name in t.columns else positioned(t, name) for t in (raw, clean))
    return _matched(left, right, name, [c for c in (columns or raw.columns) if c != name and c in clean.columns])


def clean_by_position(df: DataFrame, name: str = "row_position", **options):
    """(raw, cleaned, plan) with the row position in both tables: duplicates keep their first row's
    position, so the rows that cleaning drops are the positions that only the raw table has."""
    from ..plans.cleaning import CleaningPlan

    columns, raw = df.columns, positioned(df, name)
    keys = {f"__key_{i}": X.canonical(X.ref(f.name), f.dataType) for i, f in enumerate(df.schema.fields)}
    kept = raw.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(
        F.min_by(F.struct(*map(X.ref, columns)), X.ref(name)).alias("row"), F.min(X.ref(name)).alias(name))
    kept = kept.select(*[F.col("row").getField(c).alias(c) for c in columns], X.ref(name))
    some = reduce(lambda a, b: a | b, [X.ref(c).isNotNull() for c in columns])
    source = stage(blanks_to_null(kept).where(some), "preflight")
    plan = CleaningPlan.fit(source, columns, preflighted=True, **options)
    return raw, plan.cleaned(), plan


def change_log(changes: DataFrame) -> DataFrame:
    """Changed cells only."""
    return changes.where(F.col("change_type").isin("FILLED", "FIXED", "FLAGGED"))


def change_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("cells"))


def missing_scorecard(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Missing cells before and after per column, with the outcome in words."""
    names = [c for c in raw.columns if c in clean.columns]
    _, before = missing_counts(raw, names)
    _, after = missing_counts(clean, names)
    rows = []
    for c in names:
        b, a = before[c], after[c]
        if a == 0 and b > 0:
            result = f"All {b} filled"
        elif a > 0 and b == 0:
            result = f"{a} nulled (invalid data)"
        elif a > 0:
            result = f"{b - a} filled, {a} unparseable remain"
        else:
            result = "No missing"
        rows.append((c, b, a, b - a, result))
    schema = "column_name string, before long, after long, fixed long, result string"
    return raw.sparkSession.createDataFrame(rows, schema)


def raw_snapshot(df: DataFrame) -> DataFrame:
    """Missing count and share, and the known-bad tokens per column."""
    of_kind = X.kinds(df)
    names = [c for c in df.columns if of_kind[c] != "nested"]
    total, missing = missing_counts(df, names)
    bad = F.when(F.lower("v").isin(*fixed.BAD_TOKENS), F.col("v"))
    # The set holds spellings of a fixed token list only.
    found = by_column(df, {c: X.text(X.ref(c)) for c in names},
                      bad=F.array_sort(F.collect_set(bad)))
    rows = [
        (c, total, missing[c], round(missing[c] / total * 100) if total else 0,
         ", ".join(found[c].get("bad") or []))
        for c in names
    ]
    schema = ("column_name string, total_rows long, missing_count long, missing_pct long, "
              "sample_issues string")
    return df.sparkSession.createDataFrame(rows, schema)


def problem_cells(df: DataFrame, key: str, columns=None) -> DataFrame:
    """Raw cells that are missing or hold a known-bad token."""
    names = [c for c in (columns or df.columns) if c != key]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), X.text(X.ref(c)).alias("value"),
                 X.cell_class(X.ref(c)).alias("problem"))
        for c in names
    ])
    return df.select(X.ref(key), F.inline(cells)).where(F.col("problem") != "")


def review_rows(clean: DataFrame, pattern: str | None = None) -> DataFrame:
    """Rows flagged for review, optionally only those whose notes match ``pattern``."""
    flagged = clean.where("review_required")
    return flagged.where(F.col("review_notes").rlike(f"(?i){pattern}")) if pattern else flagged


def report_tables(raw: DataFrame, plan, key: str) -> dict[str, DataFrame]:
    """The four report tables: raw, cleaned, change log, summary per column."""
    return {
        "raw": raw, "cleaned": plan.cleaned(), "change_log": change_log(plan.changes(key)),
        "summary": plan.report(),
    }
