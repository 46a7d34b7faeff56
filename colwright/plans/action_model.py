"""The learned action chooser: training rows from grouped profiles, decision tree, evaluation.

Splits follow digests of the key of a profile, so they do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.groups import profile_groups
from ..sources.staging import drop_shuffles, stage
from .rules import rule_action

LABEL = "recommended_action"
FEATURES = (
    "col_type_encoded", "missing_rate", "unique_ratio", "invalid_numeric_count",
    "outlier_count_iqr", "invalid_date_count", "invalid_email_count", "skewness",
)
# Types that the model tells apart; every other type counts as text.
EVERY = ("numeric", "age", "score", "credit_score", "salary", "date", "email", "text", "category")


def training_rows(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Labelled column profiles: one per table, column and group of rows, named by ``key``.

    ``tables`` gives a table and the expression that groups its rows. The label is the action of the
    rules for the profile, so the tree learns them from the tables that it will see. The profiles of a
    table are written and its shuffles dropped before the next table is read, so the disk holds the
    cells of one table at a time.
    """
    parts = []
    for name, (df, group) in tables.items():
        parts.append(stage(profile_groups(df, group).select(F.lit(name).alias("table_name"), "*"), "profiles"))
        drop_shuffles(df.sparkSession)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(
        F.to_json(F.struct("table_name", "group_key", "column_name")).alias("key"), "*", rule_action().alias(LABEL))


def model_type() -> Column:
    """Column type as the model knows it."""
    known = F.col("col_type").isin(*EVERY)
    return F.when(known, F.col("col_type")).otherwise("text")


def with_splits(rows: DataFrame, folds: int = 10) -> DataFrame:
    """Adds ``is_test`` (20 %), ``fold`` and ``place`` (0 to 1), stratified by class.

    Position within a class follows a digest of the key. Counts per digest prefix
    locate each row, so no class is sorted as a whole in one task.
    """
    digest = F.md5(F.concat_ws("|", F.lit("split"), F.col("key").cast("string")))
    rows = rows.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, 3))
    sizes = rows.groupBy(LABEL, "bucket").agg(F.count("*").alias("in_bucket"))
    ahead = Window.partitionBy(LABEL).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # 4,096 buckets per class at most.
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).withColumn(
        "class_rows", F.sum("in_bucket").over(Window.partitionBy(LABEL)))
    inside = Window.partitionBy(LABEL, "bucket").orderBy("digest", "key")
    rank = F.col("ahead") + F.row_number().over(inside) - 1
    place = F.col("rank") / F.col("class_rows")
    return (
        rows.join(F.broadcast(sizes), [LABEL, "bucket"]).withColumn("rank", rank)
        .withColumn("fold", F.pmod("rank", F.lit(folds)).cast("int"))
        .withColumn("place", place).withColumn("is_test", place < 0.20)
        .drop("digest", "bucket", "in_bucket", "ahead", "rank", "class_rows")
    )


def class_weights(rows: DataFrame) -> DataFrame:
    """Adds ``weight`` so that every class counts the same."""
    counts = {r[LABEL]: r["count"] for r in rows.groupBy(LABEL).count().collect()}
    total = sum(counts.values())
    table = F.create_map(*[
        F.lit(x) for c, n in counts.items() for x in (c, total / (len(counts) * n))])
    return rows.withColumn("weight", F.element_at(table, F.col(LABEL)))


def train_action_model(rows: DataFrame, max_depth: int = 10, min_leaf: int = 4) -> PipelineModel:
    """Decision tree over the profile features."""
    prepared = class_weights(rows).withColumn("model_type", model_type())
    stages = [
        StringIndexer(inputCol="model_type", outputCol="col_type_encoded", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        StringIndexer(inputCol=LABEL, outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep"),
        DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=256,
                               weightCol="weight", seed=42),
    ]
    types, labels, features, tree = Pipeline(stages=stages).fit(prepared).stages
    # Prediction needs no label column, but the names of the classes.
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)
    return PipelineModel([types, features, tree, names])


def tree_of(model: PipelineModel):
    return model.stages[2]


def action_labels(model: PipelineModel) -> list[str]:
    """Class names in prediction order."""
    return model.stages[3].getLabels()


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``predicted``."""
    return model.transform(rows.withColumn("model_type", model_type())).select(
        *rows.columns, "predicted")


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    """Rows per label and prediction, for each value of the columns ``by``."""
    return scored.groupBy(*by, LABEL, "predicted").agg(F.count("*").alias("rows"))


def class_report(scored: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support per class, for each value of the columns ``by``."""
    cells = confusion(scored, *by)
    right = F.col(LABEL) == F.col("predicted")
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col(LABEL).alias("label"), F.col("rows").alias("support"), F.lit(0).alias("guesses"),
                 F.when(right, F.col("rows")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("support"), F.col("rows").alias("guesses"),
                 F.lit(0).alias("hits")))))
    found = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "guesses", "hits")])
    precision = F.coalesce(F.try_divide("hits", "guesses"), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return found.where("support > 0").select(
        *by, "label", "support", F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def quality_by(scored: DataFrame, *by: str) -> DataFrame:
    """``by..., scored_rows, accuracy, macro_f1``."""
    report = class_report(scored, *by).groupBy(*by).agg(
        F.sum("support").alias("scored_rows"), F.sum(F.col("support") * F.col("recall")).alias("hits"), F.avg("f1").alias("f1"))
    return report.select(*by, "scored_rows", F.round(F.col("hits") / F.col("scored_rows"), 4).alias("accuracy"),
                         F.round("f1", 4).alias("macro_f1"))


def gap_verdict(gap: float) -> str:
    if gap < 0.03:
        return "GOOD"
    return "OK" if gap < 0.07 else "WARN"


def cross_validate(rows: DataFrame, folds: int = 10) -> DataFrame:
    """``fold, scored_rows, accuracy, macro_f1``: every row scored by the tree that has not seen its fold."""
    scored = [
        score_rows(train_action_model(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold))
        for fold in range(folds)]
    return quality_by(reduce(DataFrame.unionByName, scored), "fold")


def learning_curve(rows: DataFrame, steps=tuple(i / 10 for i in range(1, 11))) -> DataFrame:
    """Train and test accuracy for growing shares of the training rows."""
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    scored = []
    for step in steps:
        part = train.where(F.col("place") < 0.20 + 0.80 * step)
        model = train_action_model(part)
        scored += [score_rows(model, side).withColumn("share", F.lit(step)) for side in (part, test)]
    found = quality_by(reduce(DataFrame.unionByName, scored), "share", "is_test")
    side = lambda test, c: F.max(F.when(F.col("is_test") == test, F.col(c)))
    out = found.groupBy("share").agg(
        side(False, "scored_rows").alias("train_rows"), side(False, "accuracy").alias("train_accuracy"),
        side(True, "accuracy").alias("test_accuracy"))
    return out.withColumn("gap", F.round(F.col("train_accuracy") - F.col("test_accuracy"), 4))


def evaluate(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """One row: accuracies, macro F1, gap verdict, depth and leaf count."""
    found = {r["is_test"]: r for r in quality_by(score_rows(model, rows), "is_test").collect()}
    a, b, f1 = found[False]["accuracy"], found[True]["accuracy"], found[True]["macro_f1"]
    tree = tree_of(model)
    row = (a, b, f1, round(a - b, 4), gap_verdict(a - b), tree.depth, (tree.numNodes + 1) // 2)
    return rows.sparkSession.createDataFrame(
        [row], "train_accuracy double, test_accuracy double, macro_f1 double, gap double, "
               "verdict string, depth int, leaves int")


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    values = tree_of(model).featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(FEATURES, values)], "feature string, importance double"
    ).orderBy(F.desc("importance"))


def model_status(model: PipelineModel | None) -> dict:
    if model is None:
        return {"model_loaded": False}
    tree = tree_of(model)
    return {
        "model_loaded": True, "action_classes": action_labels(model),
        "col_type_classes": list(model.stages[0].labels), "n_features": len(FEATURES),
        "features": list(FEATURES), "tree_depth": tree.depth,
        "tree_leaves": (tree.numNodes + 1) // 2,
    }


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Row count and share per value of a training column."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.select("value", "rows", F.round(F.col("rows") / total, 4).alias("share"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
