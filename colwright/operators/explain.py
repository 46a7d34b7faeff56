"""Explanation text and reliability notes as columns of the insight table.

Texts are a table: for each insight type its paragraphs, for each paragraph its alternatives as
(condition, sentence). In both, ``$name`` is a metric and ``@name`` a label; sentences print a field
as ``{field}`` or ``{field:format}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

TEXTS = {
    "numerical_numerical": (
        (
            ("strength = 'strong'",
             "Knowing {a} says a lot about {b}: the correlation is {$correlation:.2f} ({@direction})."),
            ("strength = 'moderate'",
             "{a} and {b} go together in part, with a {@direction} correlation of "
             "{$correlation:.2f}; much of {b} varies on its own."),
            ("strength = 'weak'",
             "A slight {@direction} correlation, {$correlation:.2f}, links {a} and {b}. It leaves "
             "nearly all variation open."),
            ("true", "{a} and {b} vary apart from each other (correlation {$correlation:.2f})."),
        ),
        (
            ("$p_value < 0.05", "Chance alone rarely gives this over {$sample_size:d} rows (p {$p_value:.4f})."),
            ("$p_value >= 0.05", "Chance alone can give this (p {$p_value:.4f})."),
        ),
        (("true", "A correlation does not tell which column acts on which, if either does."),),
    ),
    "categorical_numerical": (
        (("true",
          "Split by {a}, mean {b} is greatest for '{@top_category}' ({$top_value:.2f}) and least for "
          "'{@low_category}' ({$low_value:.2f}). Over all rows it is {$overall_mean:.2f}."),),
        (("true", "Measured in standard deviations, the lead of the top one among {$group_count:d} groups is {strength}."),),
        (
            ("$anova_p_value < 0.05", "Analysis of variance tells the groups apart (p {$anova_p_value:.4f})."),
            ("$anova_p_value >= 0.05",
             "Analysis of variance cannot tell the groups apart (p {$anova_p_value:.4f})."),
        ),
    ),
    "date_numerical": (
        (
            ("strength = 'very weak'", "{b} has no clear course along {a} (R² {$r_squared:.2f})."),
            ("true",
             "A straight line along {a} is {@trend_direction} and fits {b} with R² {$r_squared:.2f}, "
             "which counts as {strength}."),
        ),
        (
            ("$p_value < 0.05", "Chance alone rarely gives such a slope over {$sample_size:d} rows (p {$p_value:.4f})."),
            ("$p_value >= 0.05", "The slope may be chance (p {$p_value:.4f})."),
        ),
    ),
    "categorical_categorical": (
        (("true",
          "The values of {a} and {b} depend on each other: Cramér's V is {$cramers_v:.2f} of at most "
          "1, which counts as {strength}."),),
        (("true", "The largest cell holds '{@top_a}' of {a} and '{@top_b}' of {b}."),),
        (
            ("$p_value < 0.05", "The chi-square test rejects independence (p {$p_value:.4f}, {$sample_size:d} rows)."),
            ("$p_value >= 0.05", "The chi-square test does not reject independence (p {$p_value:.4f})."),
        ),
    ),
    "data_quality": (
        (
            ("$missing_pct > 60",
             "Most of {a} is empty ({$missing_pct:.1f}%). Fill it from another source or leave it out."),
            ("$missing_pct > 0",
             "A large part of {a} is empty ({$missing_pct:.1f}%). Results with it hold for the filled "
             "rows only."),
            ("true", "{a} names single rows. Group and correlate by other columns."),
        ),
    ),
    "distribution": (
        (
            ("$skewness > 0",
             "A few large values stretch {a} upwards (skewness {$skewness:.2f}); its mean lies above "
             "most rows. The median, or logarithms, describe it better."),
            ("$skewness <= 0",
             "A few small values stretch {a} downwards (skewness {$skewness:.2f}); its mean lies below "
             "most rows. The median describes it better."),
            ("$outlier_pct IS NOT NULL",
             "{$outlier_pct:.1f}% of {a} lies more than one and a half quartile ranges outside "
             "{$q1:.1f} to {$q3:.1f}. Find out whether these cells are errors before using means."),
        ),
    ),
}

NOTES = (
    ("$sample_size < 30", "Fewer than 30 rows ({$sample_size:d})."),
    ("$sample_size >= 30 AND $sample_size < 100", "Fewer than 100 rows ({$sample_size:d})."),
    ("$p_value > 0.05", "May be chance (p {$p_value:.4f})."),
    ("NOT coalesce($p_value > 0.05, false) AND $anova_p_value > 0.05", "May be chance (p {$anova_p_value:.4f})."),
    ("$missing_pct > 20", "Many cells are empty ({$missing_pct:.1f}%)."),
    ("type = 'numerical_numerical'", "Only straight-line relations are measured."),
)
NO_NOTES = "Nothing speaks against this finding."

_FIELD = re.compile(r"\{([$@]?\w+)(?::([^}]+))?\}")


def _sql(text: str) -> str:
    text = re.sub(r"\$(\w+)", r"try_element_at(metrics, '\1')", text)
    return re.sub(r"@(\w+)", r"try_element_at(labels, '\1')", text)


def _field(name: str, form: str | None) -> Column:
    if name in ("a", "b"):
        return F.try_element_at("columns", F.lit(1 if name == "a" else 2))
    value = F.expr(_sql(name))
    return value.cast("long") if form == "d" else value


def _sentence(text: str) -> Column:
    pattern = _FIELD.sub(lambda m: "\0" + (m[2] or "s"), text).replace("%", "%%").replace("\0", "%")
    fields = [_field(*m) for m in _FIELD.findall(text)]
    return F.format_string(pattern, *fields) if fields else F.lit(text)


def _first(options) -> Column:
    """The sentence of the first alternative that holds, else null."""
    return F.coalesce(*[F.when(F.expr(_sql(when)), _sentence(text)) for when, text in options])


def explanation() -> Column:
    """Plain-language explanation of an insight, by type; its summary where no text fits."""
    texts = [
        F.when(F.col("type") == kind,
               F.array_join(F.array_compact(F.array(*map(_first, paragraphs))), "\n\n"))
        for kind, paragraphs in TEXTS.items()
    ]
    said = F.coalesce(*texts, F.lit(""))
    return F.when(said == "", F.col("summary")).otherwise(said)


def reliability_notes() -> Column:
    """Caveats of an insight; never empty."""
    notes = F.array_compact(F.array(*[_first([note]) for note in NOTES]))
    return F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(NO_NOTES)))


def explain(insights: DataFrame) -> DataFrame:
    """Adds ``explanation`` and ``reliability_notes``."""
    return insights.withColumn("explanation", explanation()).withColumn(
        "reliability_notes", reliability_notes())


def insight_details(df: DataFrame, insights: DataFrame, insight_id: str):
    """One insight with its explanation, and the data set of its recommended chart."""
    from .charts import chart_data

    detail = explain(insights.where(F.col("insight_id") == insight_id))
    row = detail.select("chart").first()
    if row is None:
        raise ValueError(f"No insight has the id '{insight_id}'.")
    chart = row["chart"]
    if chart is None:
        return detail, None
    return detail, chart_data(
        df, chart["chart_type"], chart["x"], chart["y"], aggregation=chart["aggregation"],
        group_by=chart["group_by"])
