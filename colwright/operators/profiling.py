"""Column profiles and semantic types: one row per column of the table.

Every pass covers all columns at once (see ``melt``). The driver sees only
per-column scalars, from which the profile table is made.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import exprs as X, fixed
from .melt import by_column, frequencies, frequency_summary, wide
from .quantiles import quantiles

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()

PROFILE_SCHEMA = T.StructType(
    [T.StructField("column_name", _S), T.StructField("position", _L), T.StructField("kind", _S),
     T.StructField("col_type", _S), T.StructField("total_rows", _L),
     T.StructField("missing_count", _L), T.StructField("missing_rate", _D),
     T.StructField("unique_count", _L), T.StructField("unique_ratio", _D),
     T.StructField("invalid_numeric_count", _L), T.StructField("outlier_count_iqr", _L),
     T.StructField("invalid_date_count", _L), T.StructField("invalid_email_count", _L),
     T.StructField("skewness", _D), T.StructField("min_value", _D), T.StructField("max_value", _D),
     T.StructField("mean", _D), T.StructField("median", _D), T.StructField("std", _D),
     T.StructField("bool_true_count", _L), T.StructField("bool_false_count", _L),
     T.StructField("bool_invalid_count", _L), T.StructField("bool_unrecognised_count", _L),
     T.StructField("most_common", _S),
     T.StructField("top_values", T.ArrayType(T.StructType(
         [T.StructField("value", _S), T.StructField("count", _L)]))),
     T.StructField("wrong_case_count", _L), T.StructField("negative_count", _L),
     T.StructField("extreme_upper", _D), T.StructField("extreme_count", _L),
     T.StructField("range_violations", _L), T.StructField("age_violations", _L),
     T.StructField("actual_skewness", _D), T.StructField("actual_outliers", _L),
     T.StructField("is_integer_column", T.BooleanType()), T.StructField("mode_dominance", _D),
     T.StructField("mode_text", _S)]
)


def named(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None


def name_type(name: str) -> str | None:
    return next((t for t, pattern in fixed.NAME_TYPES if named(pattern, name.strip())), None)


def sample_skewness(population: float | None, n: int) -> float | None:
    """Bias-corrected skewness; 0 for a constant column."""
    if n < 3:
        return None
    return (population or 0.0) * (n * (n - 1)) ** 0.5 / (n - 2)


def sample_kurtosis(population: float | None, n: int) -> float | None:
    """Bias-corrected excess kurtosis; 0 for a constant column."""
    if n < 4:
        return None
    if population is None:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)


def missing_counts(df: DataFrame, columns) -> tuple[int, dict[str, int]]:
    """Row count, and null (or NaN) count per column."""
    of_kind = X.kinds(df)
    found = wide(df, {None: F.count("*")} | {c: F.count(present(c, of_kind[c])) for c in columns})
    total = found[None]
    return total, {c: total - found[c] for c in columns}


def present(name: str, kind: str):
    """The column with NaN as null."""
    return X.finite(X.ref(name)) if kind == "number" else X.ref(name)


def cell_text(name: str, kind: str):
    return X.text(present(name, kind) if kind == "number" else X.ref(name))


def cell_frequencies(df: DataFrame, columns) -> dict[str, dict]:
    """Distinct count, mode (as text) and mode count of the raw cells of each column.

    Columns are melted per storage family: whole numbers, other numbers and text, so
    that numbers are not printed to be counted.
    """
    families: dict[str, dict] = {}
    for field in df.schema.fields:
        if field.name not in columns:
            continue
        kind = field.dataType.typeName()
        family = {"byte": "bigint", "short": "bigint", "integer": "bigint", "long": "bigint",
                  "float": "double", "double": "double"}.get(kind, "string")
        families.setdefault(family, {})[field.name] = X.ref(field.name).cast(family)
    out: dict[str, dict] = {}
    for values in families.values():
        out |= frequency_summary(df, values)
    for m in out.values():
        m["mode"] = None if m["mode"] is None else str(m["mode"])
    return out


def distinct_counts(df: DataFrame, columns, approximate: bool = False) -> dict[str, int]:
    """Distinct non-null cells per column; ``approximate`` avoids the shuffle of values."""
    if approximate:
        texts = {c: X.text(X.ref(c)) for c in columns}
        found = by_column(df, texts, u=F.approx_count_distinct("v", 0.02))
        return {c: found[c].get("u", 0) for c in columns}
    return {c: m["distinct"] for c, m in cell_frequencies(df, columns).items()}


def date_orders(df: DataFrame, columns) -> dict[str, bool]:
    """Whether the day comes first, for each text column with cells that only inference can read: the
    order in which more of them are dates, the day first on a tie. Columns without such cells are left
    out. One pass counts the votes of all columns."""
    found = by_column(df, {c: X.strip(X.text(X.ref(c))) for c in columns}, balance=F.sum(X.order_votes(F.col("v"))))
    return {c: m["balance"] >= 0 for c, m in found.items() if m.get("balance") is not None}


def _date_shares(df: DataFrame, columns) -> dict[str, float]:
    """Share of dates among the cells of text columns, inferred ones included."""
    found = by_column(df, {c: X.strip(X.text(X.ref(c))) for c in columns},
                      share=F.avg(X.to_datetime(F.col("v"), "string", True).isNotNull().cast("int")))
    return {c: m.get("share", 0.0) for c, m in found.items()}


def infer_cleaning_types(df: DataFrame, columns, unique: dict | None, missing: dict, total: int):
    """Cleaning type of each column: name rules, then storage kind, then cell content. Without distinct
    counts, those of the columns that hang on them are taken here."""
    of_kind, types, open_columns = X.kinds(df), {}, []
    for c in columns:
        named_type = name_type(c)
        if named_type:
            types[c] = named_type
        elif of_kind[c] == "nested":
            types[c] = "nested"
        elif total == missing[c]:
            types[c] = "text"
        elif of_kind[c] != "string":
            types[c] = {"number": "numeric", "boolean": "boolean", "datetime": "date"}[of_kind[c]]
        else:
            open_columns.append(c)
    v = F.col("v")
    tokens = fixed.TRUE_TOKENS + fixed.FALSE_TOKENS
    hits = by_column(
        df, {c: X.strip(X.ref(c)) for c in open_columns},
        truth=F.avg(F.lower(v).isin(*tokens).cast("int")),
        email=F.avg(X.is_email(v).cast("int")),
        date=F.avg(X.to_datetime(v, "string").isNotNull().cast("int")),
        maybe=F.avg(X.may_be_inferred(v).cast("int")),
        number=F.avg(X.parse_number(X.strip_symbols(v)).isNotNull().cast("int")),
    )
    # Dates are inferred only where they could tip the decision.
    near = [c for c, h in hits.items() if h["date"] <= 0.5 < h["date"] + h["maybe"]]
    for c, share in _date_shares(df, near).items():
        hits[c]["date"] = share
    for c in open_columns:
        h = hits[c]
        if h["truth"] >= 0.90:
            types[c] = "boolean"
        elif h["email"] > 0.5:
            types[c] = "email"
        elif h["date"] > 0.5:
            types[c] = "date"
        elif h["number"] > 0.7:
            types[c] = "numeric"
    words = [c for c in open_columns if c not in types]
    if unique is None:
        unique = distinct_counts(df, words)
    for c in words:
        types[c] = "category" if unique[c] / (total - missing[c]) < 0.15 else "text"
    return {c: types[c] for c in columns}


def moments(df: DataFrame, values) -> dict[str, dict]:
    """Count, mean, spread, shape and extremes of numeric expressions, one pass."""
    found = by_column(
        df, values, n=F.count("v"), mean=F.avg("v"), std=F.stddev_samp("v"),
        skew=F.skewness("v"), kurt=F.kurtosis("v"), low=F.min("v"), high=F.max("v"),
        zeros=F.count_if(F.col("v") == 0), negatives=F.count_if(F.col("v") < 0),
        whole=F.bool_and(F.rint("v") == F.col("v")),
    )
    empty = dict.fromkeys(("mean", "std", "skew", "kurt", "low", "high"), None) | {
        "n": 0, "zeros": 0, "negatives": 0, "whole": False}
    return {c: m or empty for c, m in found.items()}


def count_outside(df: DataFrame, values: dict, ranges: dict) -> dict:
    """Cells outside ``[lo, hi]`` per column."""
    found = by_column(
        df, {c: values[c] for c in ranges},
        {"lo": {c: lo for c, (lo, _) in ranges.items()}, "hi": {c: hi for c, (_, hi) in ranges.items()}},
        n=F.expr("count_if(v < lo or v > hi)"))
    return {c: m.get("n", 0) for c, m in found.items()}


def fences(quartiles: dict, counts: dict[str, int], reach: float = 1.5):
    """IQR fences of the columns that have any: at least 4 values and IQR above 0."""
    out = {}
    for c, q in quartiles.items():
        if q and counts[c] >= 4 and q[-1] - q[0] > 0:
            width = reach * (q[-1] - q[0])
            out[c] = (q[0] - width, q[-1] + width)
    return out


def top_values(df: DataFrame, columns, k: int = 5) -> DataFrame:
    """``(column_name, rank, value, count, pct)``: most frequent trimmed cells per column.

    The ranking window keeps only ``k`` rows per task and column before its shuffle.
    """
    of_kind = X.kinds(df)
    names = list(columns)
    table = frequencies(df, {c: X.strip(cell_text(c, of_kind[c])) for c in names})
    totals = table.groupBy("k").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("k").orderBy(F.desc("n"), "v")
    ranked = table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    label = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    # One row per column on the broadcast side.
    return ranked.join(F.broadcast(totals), "k").select(
        label.alias("column_name"), "rank", F.col("v").alias("value"), F.col("n").alias("count"),
        F.round(F.col("n") / F.col("total") * 100, 2).alias("pct"),
    )


def _rate(part: int, whole: int, digits: int = 4) -> float:
    return round(part / whole, digits) if whole else 0.0


def _round(x, digits=4):
    return None if x is None else round(x, digits)


def profile_rows(
    df: DataFrame, columns=None, evidence: bool = True, approximate_distinct: bool = False,
    top: int = 5, rank_error: float | None = None,
) -> list[dict]:
    """Profile of every column as plain rows. ``evidence`` adds the refinement measures, ``top`` is the
    number of top values, ``rank_error`` takes quartiles from a one-pass sketch."""
    columns = list(columns or df.columns)
    of_kind = X.kinds(df)
    total, missing = missing_counts(df, columns)
    flat = [c for c in columns if of_kind[c] != "nested"]
    modes, unique = {}, distinct_counts(df, flat, True) if approximate_distinct else {}
    if not approximate_distinct:
        modes = cell_frequencies(df, flat)
        unique = {c: m["distinct"] for c, m in modes.items()}
    types = infer_cleaning_types(df, columns, unique, missing, total)
    if approximate_distinct and evidence:  # the mode of text decides an action; its counts are needed for the top values too
        modes = cell_frequencies(df, [c for c in flat if types[c] in ("text", "category")])

    numbers = _number_measures(df, flat, of_kind, types, evidence, rank_error)
    texts = _text_measures(df, flat, of_kind, types, evidence)
    words = [c for c in flat if types[c] in ("text", "category")]
    best: dict[str, list] = {}
    if words:
        for r in top_values(df, words, top).collect():
            best.setdefault(r["column_name"], []).append((r["rank"], r["value"], r["count"]))

    rows = []
    for position, c in enumerate(columns):
        row = dict.fromkeys(PROFILE_SCHEMA.names)
        row |= {
            "column_name": c, "position": position, "kind": of_kind[c], "col_type": types[c],
            "total_rows": total, "missing_count": missing[c],
            "missing_rate": _rate(missing[c], total), "unique_count": unique.get(c),
            "unique_ratio": _rate(unique.get(c, 0), total), "invalid_numeric_count": 0,
            "outlier_count_iqr": 0, "invalid_date_count": 0, "invalid_email_count": 0,
            "skewness": 0.0,
        }
        row |= texts.get(c, {}) | numbers.get(c, {})
        if "valid_count" in row:
            row["invalid_numeric_count"] = total - missing[c] - row.pop("valid_count")
        if c in best:
            row["top_values"] = [(v, n) for _, v, n in sorted(best[c])]
            row["most_common"] = row["top_values"][0][0]
        if c in modes:
            row["mode_text"] = modes[c]["mode"]
            if c in words and evidence:
                m = modes[c]
                row["mode_dominance"] = m["mode_count"] / m["total"] if m["total"] else 0.0
        rows.append(row)
    return rows


def _number_measures(df, columns, of_kind, types, evidence, rank_error=None) -> dict[str, dict]:
    """Numeric part of the profile and the evidence for refinement.

    A column is measured under up to two readings: ``loose`` drops currency signs and
    codes, ``plain`` does not. Typed numbers read the same either way. All columns and
    readings share one pass for the moments, one search for the quartiles and one pass
    for the cells outside fences and limits.
    """
    numeric = [c for c in columns if types[c] in fixed.NUMERIC_TYPES]
    checked = [
        c for c in columns if evidence and (
            types[c] in fixed.NUMERIC_TYPES or named(fixed.MONEY_NAME, c)
            or named(fixed.COUNTED_NAME, c) or named(fixed.SCORE_NAME, c))
    ]
    values, plain = {}, {}
    for c in numeric:
        values[c, "loose"] = X.to_profile_number(X.ref(c), of_kind[c])
    for c in checked:
        same = of_kind[c] == "number" and c in numeric
        plain[c] = (c, "loose") if same else (c, "plain")
        if not same:
            values[plain[c]] = X.to_number(X.ref(c), of_kind[c])
    shape = moments(df, values)
    counts = {key: m["n"] for key, m in shape.items()}
    quartiles = quantiles(df, values, counts=counts, rank_error=rank_error)

    ranges = {(key, "iqr"): bounds for key, bounds in fences(quartiles, counts).items()}
    money = [c for c in checked if named(fixed.MONEY_NAME, c) and not shape[plain[c]]["negatives"]]
    far = fences({plain[c]: quartiles[plain[c]] for c in money}, counts, 3.0)
    upper = {c: far[plain[c]][1] for c in money if plain[c] in far}
    for c in checked:
        if c in upper:
            ranges[plain[c], "extreme"] = (float("-inf"), upper[c])
        if types[c] == "credit_score" or named(fixed.CREDIT_NAME, c):
            ranges[plain[c], "limit"] = (300.0, 850.0)
        elif types[c] == "score" or named(fixed.SCORE_NAME, c):
            ranges[plain[c], "limit"] = (0.0, 100.0)
        if types[c] == "age" or named(fixed.AGE_NAME, c):
            ranges[plain[c], "age"] = (0.0, 120.0)
    outside = count_outside(df, {r: values[r[0]] for r in ranges}, ranges)

    out: dict[str, dict] = {c: {} for c in numeric + checked}
    for c in numeric:
        key = (c, "loose")
        m, q = shape[key], quartiles[key]
        out[c] |= {
            "valid_count": m["n"], "outlier_count_iqr": outside.get((key, "iqr"), 0),
            "skewness": _round(sample_skewness(m["skew"], m["n"]) or 0.0),
            "min_value": m["low"], "max_value": m["high"], "mean": m["mean"],
            "median": q[1] if q else None, "std": m["std"],
        }
    for c in checked:
        key = plain[c]
        m = shape[key]
        out[c] |= {
            "negative_count": m["negatives"], "extreme_upper": upper.get(c),
            "extreme_count": outside.get((key, "extreme"), 0),
            "range_violations": outside.get((key, "limit"), 0),
            "age_violations": outside.get((key, "age"), 0),
            "actual_skewness": sample_skewness(m["skew"], m["n"]) if m["n"] >= 4 else 0.0,
            "actual_outliers": outside.get((key, "iqr"), 0), "is_integer_column": bool(m["whole"]),
        }
    return out


def _text_measures(df, columns, of_kind, types, evidence) -> dict[str, dict]:
    """Unreadable dates, emails and booleans, and wrong case, in one pass.

    Each cell carries the test it is due, so no cell is parsed for another type.
    """
    due = {}
    for c in columns:
        if types[c] == "date" and of_kind[c] != "datetime":
            due[c, "date"] = X.text(X.ref(c))
        elif types[c] in ("email", "boolean"):
            due[c, types[c]] = X.lower_strip(X.ref(c))
        if evidence and named(fixed.TITLE_NAME, c):
            due[c, "title"] = X.strip(X.text(X.ref(c)))
    v, test = F.col("v"), F.col("test")
    out: dict[str, dict] = {c: {} for c, _ in due}
    truth = test == "boolean"
    found = by_column(
        df, due, {"test": {key: key[1] for key in due}}, n=F.count("v"),
        bad=F.count_if(
            F.when(test == "date", X.to_datetime(v, "string").isNull())
            .when(test == "email", ~X.is_email(v)).when(test == "title", v != X.title_case(v))
            .otherwise(X.to_bit(v).isNull())),
        true=F.count_if(truth & v.isin(*fixed.TRUE_TOKENS)),
        false=F.count_if(truth & v.isin(*fixed.FALSE_TOKENS)),
    )
    # Cells in none of the known formats are inferred in a pass of their own.
    open_ = {c: due[c, k] for (c, k), m in found.items() if k == "date" and m.get("bad")}
    left = by_column(df, open_, bad=F.count_if(X.to_datetime(v, "string", True).isNull()))
    for (c, kind), m in found.items():
        if kind == "date" and c in left:
            m = m | left[c]
        bad, yes, no = (m.get(x, 0) for x in ("bad", "true", "false"))
        if kind == "date":
            out[c]["invalid_date_count"] = bad
        elif kind == "email":
            out[c]["invalid_email_count"] = bad
        elif kind == "title":
            out[c]["wrong_case_count"] = bad
        else:
            odd = m.get("n", 0) - yes - no
            out[c] |= {
                "bool_true_count": yes, "bool_false_count": no, "bool_invalid_count": odd,
                "bool_unrecognised_count": bad, "invalid_numeric_count": odd,
                "most_common": "true" if yes >= no else "false",
            }
    return out


def profile(df: DataFrame, columns=None, evidence: bool = True, approximate_distinct: bool = False,
            top: int = 5, rank_error: float | None = None) -> DataFrame:
    """Profile table: one row per column; see ``profile_rows`` for the options."""
    rows = profile_rows(df, columns, evidence, approximate_distinct, top, rank_error)
    return rows_to_df(df.sparkSession, rows, PROFILE_SCHEMA)


def rows_to_df(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)


TYPE_SCHEMA = T.StructType(
    [T.StructField("column_name", _S), T.StructField("position", _L),
     T.StructField("semantic_type", _S), T.StructField("missing_pct", _D),
     T.StructField("unique_count", _L)]
)


def type_rows(df: DataFrame, mode: str = "insight", count_distinct: bool = True) -> list[dict]:
    """Semantic type per column for ``cleaning``, ``statistics`` or ``insight`` use.

    Without ``count_distinct``, distinct cells are counted only of the columns whose type hangs on them:
    none for ``statistics``, text in no other type for ``cleaning``, all for ``insight``.
    """
    of_kind = X.kinds(df)
    columns = [c for c in df.columns if of_kind[c] != "nested"]
    total, missing = missing_counts(df, columns)
    unique = distinct_counts(df, columns) if count_distinct or mode == "insight" else {}
    if mode == "cleaning":
        types = infer_cleaning_types(df, columns, unique if count_distinct else None, missing, total)
    elif mode in ("statistics", "insight"):
        types = _shape_types(df, columns, of_kind, total, missing, unique, mode)
    else:
        raise ValueError(f"Unknown typing mode '{mode}'.")
    return [
        {"column_name": c, "position": i, "semantic_type": types[c],
         "missing_pct": round(missing[c] / max(total, 1) * 100, 1), "unique_count": unique.get(c),
         "missing_count": missing[c], "total_rows": total, "kind": of_kind[c]}
        for i, c in enumerate(columns)
    ]


def _shape_types(df, columns, of_kind, total, missing, unique, mode):
    shapes = fixed.STAT_DATE_SHAPES if mode == "statistics" else fixed.INSIGHT_DATE_SHAPES
    v = F.col("v")
    strings = [c for c in columns if of_kind[c] == "string"]
    metrics = {
        "date": F.avg(X.has_date_shape(X.strip(v), shapes).cast("int")),
        "number": F.avg(X.parse_number(v).isNotNull().cast("int")),
    }
    if mode == "insight":
        metrics["parsed"] = F.avg(X.to_datetime(v, "string").isNotNull().cast("int"))
        metrics["maybe"] = F.avg(X.may_be_inferred(X.strip(v)).cast("int"))
    hits = by_column(df, {c: X.ref(c) for c in strings}, **metrics)
    if mode == "insight":
        near = [c for c, h in hits.items() if h and h["date"] < 0.60 and h["parsed"] < 0.75 <= h["parsed"] + h["maybe"]]
        for c, share in _date_shares(df, near).items():
            hits[c]["parsed"] = share
    types = {}
    for c in columns:
        n = total - missing[c]
        if of_kind[c] == "datetime":
            types[c] = "date"
        elif of_kind[c] == "boolean":
            types[c] = "categorical"
        elif of_kind[c] == "number":
            is_id = (
                mode == "insight" and named(fixed.INSIGHT_ID_NAME, c)
                and (n < 5 or unique[c] / n > 0.95))
            types[c] = "id" if is_id else "numerical"
        elif n == 0:
            types[c] = "categorical"
        elif hits[c]["date"] >= 0.60 or hits[c].get("parsed", 0) >= 0.75:
            types[c] = "date"
        elif hits[c]["number"] >= 0.80:
            types[c] = "numerical"
        elif mode == "insight" and unique[c] / n > 0.90 and unique[c] > 100:
            types[c] = "text"
        else:
            types[c] = "categorical"
    return types


def semantic_types(df: DataFrame, mode: str = "insight") -> DataFrame:
    """Column information: type, missing share and distinct count of each column."""
    return rows_to_df(df.sparkSession, type_rows(df, mode), TYPE_SCHEMA)
