"""Table input, output, previews and input checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import exprs as X, fixed
from ..operators.melt import by_column
from .csvsplit import split_csv
from .staging import stage

INT64 = 2.0 ** 63


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with a header; missing-value tokens become null and columns get their type.

    A column is promoted to bigint, double or boolean only when every non-null cell
    of the whole file parses, which one aggregation finds out for all columns.
    Quoted cells may hold line ends; large files are split all the same (``csvsplit``) and
    each record is parsed once, into the shared staging folder. ``multiLine`` chooses Spark's own
    reader instead: True reads a file in one task, False takes every line for a record. Options that
    change quotes, escapes, line ends, comments or the encoding need one of these.
    """
    options = {"header": True, "escape": '"'} | options
    own = not {"multiLine", "quote", "lineSep", "comment", "encoding", "charset", "charToEscapeQuoteEscaping"} & set(options)
    if own and options["header"] is True and options["escape"] == '"':
        schema = spark.read.options(**options, multiLine=True).csv(path).schema  # reads the first record only
        raw = split_csv(spark, path, schema, **options)
    else:
        raw = spark.read.options(**{"multiLine": True} | options).csv(path)
    clean = raw.select(
        *[F.when(~X.ref(c).isin(*fixed.CSV_MISSING), X.ref(c)).alias(c) for c in raw.columns]
    )
    return promote(stage(clean, "csv") if own else clean)


def promote(df: DataFrame) -> DataFrame:
    of_kind = X.kinds(df)
    v = F.col("v")
    number = X.parse_number(v)
    found = by_column(
        df, {c: X.ref(c) for c in df.columns if of_kind[c] == "string"},
        n=F.count("v"), numbers=F.count(number),
        whole=F.count_if(v.rlike(r"^\s*[+-]?\d+\s*$") & (F.abs(number) < INT64)),
        truths=F.count_if(v.isin("True", "TRUE", "true", "False", "FALSE", "false")),
    )
    out = []
    for c in df.columns:
        m, cell = found.get(c, {}), X.ref(c)
        if m.get("n") and m["whole"] == m["n"]:
            cell = X.strip(cell).cast("bigint")
        elif m.get("n") and m["numbers"] == m["n"]:
            cell = X.parse_number(cell)
        elif m.get("n") and m["truths"] == m["n"]:
            cell = (F.lower(cell) == "true")
        out.append(cell.alias(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, min_columns: int = 1, **options) -> DataFrame:
    """CSV, JSON, ORC or parquet by file extension; empty input is rejected."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension == "csv":
        df = read_csv(spark, path, **options)
    elif extension in ("json", "orc", "parquet"):
        df = spark.read.options(**options).format(extension).load(path)
    else:
        raise ValueError("Only csv, json, orc and parquet tables are accepted.")
    return check_table(df, min_columns)


def check_table(df: DataFrame, min_columns: int = 1) -> DataFrame:
    if len(df.columns) < min_columns:
        raise ValueError(f"The table needs at least {min_columns} column(s).")
    if df.isEmpty():
        raise ValueError("The table holds no rows.")
    return df


def check_columns(df: DataFrame, columns) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Column(s) not found: {absent}. Available columns: {df.columns}")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; blanks around cells are kept."""
    df.write.mode(mode).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Several result tables side by side, one parquet folder each."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating-point column, nested ones included."""
    return df.select(*[X.finite_cell(X.ref(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """First rows of a table, sanitised."""
    return sanitise(df.limit(rows))


def preflight(df: DataFrame) -> DataFrame:
    """Exact duplicates dropped, then blank text to null, then empty rows dropped."""
    return drop_empty(blanks_to_null(distinct_rows(df)))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates dropped, whatever the types: maps with equal entries are equal."""
    maps = {f.name: X.canonical(X.ref(f.name), f.dataType) for f in df.schema.fields if X.holds(f.dataType, T.MapType)}
    if not maps:
        return df.dropDuplicates()
    keys = {c: f"__entries_{i}" for i, c in enumerate(maps)}
    keyed = df.withColumns({keys[c]: entries for c, entries in maps.items()})
    return keyed.dropDuplicates([keys.get(c, c) for c in df.columns]).drop(*keys.values())


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Blank text, NaN and infinities to null."""
    of_kind = X.kinds(df)
    text = [X.blank_to_null(X.ref(c)).alias(c) if of_kind[c] == "string" else X.ref(c) for c in df.columns]
    return sanitise(df.select(*text))


def drop_empty(df: DataFrame) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [X.ref(c).isNotNull() for c in df.columns]))
