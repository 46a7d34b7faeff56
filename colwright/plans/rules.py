"""The rules that choose a cleaning action from a column profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import fixed

_is_numeric = lambda: F.col("col_type").isin(*fixed.NUMERIC_TYPES)


def rule_action() -> Column:
    """Invalid cells first, then outliers, then missing cells."""
    numeric, kind = _is_numeric(), F.col("col_type")
    missing = F.col("missing_rate") > 0
    return (
        F.when((F.col("invalid_numeric_count") > 0) & numeric, "convert_and_flag")
        .when((F.col("invalid_date_count") > 0) & (kind == "date"), "parse_and_flag")
        .when((F.col("invalid_email_count") > 0) & (kind == "email"), "normalize_and_flag")
        .when((F.col("outlier_count_iqr") > 0) & numeric, "flag_outliers")
        .when(missing & numeric & (F.abs("skewness") < 0.5), "impute_mean")
        .when(missing & numeric, "impute_median")
        .when(missing & kind.isin("text", "category") & (F.col("unique_ratio") < 0.3), "fill_mode")
        .when(missing & kind.isin("text", "category"), "fill_unknown")
        .when(missing & (kind == "date"), "date_manual_review")
        .when(missing & (kind == "email"), "normalize_and_flag")
        .otherwise("no_change")
    )
