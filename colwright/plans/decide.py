"""Choice of a cleaning action, as expressions over the profile table.

Rules and refinement are plain ``when`` chains, so they run unchanged on the
profiles of one table or of a whole catalog.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .action_model import action_labels, model_type
from .rules import rule_action


def predict(profile: DataFrame, model=None, threshold: float = 0.65) -> DataFrame:
    """Adds ``rule_action``, ``predicted_action``, ``confidence``, ``method``, ``probabilities``.

    ``model`` is a fitted action model; below ``threshold`` the rule decides.
    """
    ruled = profile.withColumn("rule_action", rule_action())
    if model is None:
        return ruled.select(
            "*", F.col("rule_action").alias("predicted_action"), F.lit(1.0).alias("confidence"),
            F.lit("rule_based").alias("method"),
            F.create_map("rule_action", F.lit(1.0)).alias("probabilities"),
        )
    labels = F.array(*map(F.lit, action_labels(model)))
    scored = model.transform(ruled.withColumn("model_type", model_type()))
    scored = scored.withColumn(
        "probability", F.transform(vector_to_array("probability"), lambda p: F.round(p, 4))
    )
    best = F.array_max("probability")
    sure = best >= threshold
    return scored.select(
        *ruled.columns,
        F.when(sure, F.col("predicted")).otherwise(F.col("rule_action")).alias("predicted_action"),
        best.alias("confidence"),
        F.when(sure, "ml").otherwise("fallback_low_confidence").alias("method"),
        F.map_from_arrays(labels, F.col("probability")).alias("probabilities"),
    )


def refine(predicted: DataFrame) -> DataFrame:
    """Adds ``action``, ``refined`` and ``reason``: the prediction checked against the data."""
    name = F.lower("column_name")
    action = F.col("predicted_action")
    money = name.rlike(fixed.MONEY_NAME)
    credit = (F.col("col_type") == "credit_score") | name.rlike(fixed.CREDIT_NAME)
    score = (F.col("col_type") == "score") | name.rlike(fixed.SCORE_NAME)
    settled = action.isin("convert_and_flag", "flag_outliers")
    beyond = (credit | score) & (F.col("range_violations") > 0) & ~settled
    aged = (F.col("age_violations") > 0) & (action != "convert_and_flag")
    boolean = F.col("col_type") == "boolean"
    clean_boolean = boolean & (F.col("kind") == "boolean") & (F.col("missing_count") == 0)
    imputing = action.isin("impute_mean", "impute_median")
    filling = action.isin("fill_mode", "fill_unknown")
    skewed = (F.col("actual_outliers") > 1) | (F.abs("actual_skewness") >= 0.5)
    dominant = F.col("mode_dominance") >= 0.30
    wrong_case = F.col("wrong_case_count") > 0
    negative = money & (F.col("negative_count") > 0)
    extreme = money & (F.col("extreme_count") > 0)

    def say(pattern: str, *columns) -> Column:
        return F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in columns])

    # One ordered list of cases: condition, action, reason when the action changes.
    cases = [
        (wrong_case, F.lit("title_case"),
         say("Cells of '%s' are written in mixed case", "column_name")),
        (clean_boolean, F.lit("no_change"),
         F.lit("All cells are booleans already")),
        (boolean, F.lit("normalize_boolean"),
         say("Booleans to write as 1 and 0; %s unknown spelling(s), %s empty",
             "bool_unrecognised_count", "missing_count")),
        (negative, F.lit("convert_and_flag"),
         say("%s amount(s) below zero in '%s' need review", "negative_count", "column_name")),
        (extreme, F.lit("convert_and_flag"),
         say("%s amount(s) beyond %.0f, three quartile ranges out, in '%s' need review",
             "extreme_count", "extreme_upper", "column_name")),
        (beyond & credit, F.lit("convert_and_flag"),
         say("%s credit score(s) not within 300 to 850: review takes the place of '%s'",
             "range_violations", "predicted_action")),
        (beyond, F.lit("convert_and_flag"),
         say("%s score(s) not within 0 to 100: review takes the place of '%s'", "range_violations",
             "predicted_action")),
        (aged, F.lit("convert_and_flag"),
         say("%s age(s) not within 0 to 120 need review",
             "age_violations")),
        (imputing, F.when(skewed, "impute_median").otherwise("impute_mean"),
         say("'%s' became '%s': skewness %.2f, %s outlier(s)", "predicted_action",
             F.when(skewed, "impute_median").otherwise("impute_mean"), "actual_skewness",
             "actual_outliers")),
        (filling, F.when(dominant, "fill_mode").otherwise("fill_unknown"),
         say("'%s' became '%s': the top value fills %.1f%% of the filled cells", "predicted_action",
             F.when(dominant, "fill_mode").otherwise("fill_unknown"),
             F.col("mode_dominance") * 100)),
    ]
    chosen, reason = action, F.lit("")
    for condition, result, words in reversed(cases):
        condition = F.coalesce(condition, F.lit(False))
        chosen = F.when(condition, result).otherwise(chosen)
        reason = F.when(condition, words).otherwise(reason)
    escalated = negative | extreme
    out = predicted.withColumn("action", chosen).withColumn("reason", reason)
    # A clean boolean column counts as confirmed, an escalated money column as refined.
    changed = (F.col("action") != action) & ~F.coalesce(clean_boolean & ~wrong_case, F.lit(False))
    forced = F.coalesce(escalated & ~wrong_case & ~boolean, F.lit(False))
    out = out.withColumn("refined", F.coalesce(changed, F.lit(False)) | forced)
    keep = F.col("refined") | boolean | wrong_case
    return out.withColumn("reason", F.when(F.coalesce(keep, F.lit(False)), F.col("reason")).otherwise(""))


def decide(profile: DataFrame, model=None, threshold: float = 0.65) -> DataFrame:
    return refine(predict(profile, model, threshold))
