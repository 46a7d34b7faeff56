"""Profiles, cleaning, insights and charts on small tables."""

import math
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import colwright as cw
from checks import registry
from checks.registry import QUERIES, dirty
from colwright.functions import exprs as X, fixed
from colwright.operators import charts, groups, insights, profiling
from colwright.operators.groups import profile_groups
from colwright.operators.profiling import profile_rows
from colwright.plans import action_model as am
from colwright.sources.staging import stage
from colwright.sources.tables import blanks_to_null

SF = "/root/testdata/sf0.001"


def test_read_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d\n1,1.5,true,x\nN/A,2,False,"say ""hi"""\n3,nan,,NULL\n')
    df = cw.read_table(spark, str(path), min_columns=2)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    rows = sorted(df.collect(), key=lambda r: (r["a"] is None, r["a"] or 0))
    assert [tuple(r) for r in rows] == [
        (1, 1.5, True, "x"), (3, None, None, None), (None, 2.0, False, 'say "hi"')]
    with pytest.raises(ValueError):
        cw.read_table(spark, str(path), min_columns=5)
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        cw.read_table(spark, str(tmp_path / "e.csv"))


def test_profile_edge_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, float("nan"), "x"), (1.0, None, float("inf"), "x")],
        "same double, nothing string, odd double, tag string")
    rows = {r["column_name"]: r for r in cw.profile(df).collect()}
    assert rows["same"]["skewness"] == 0.0 and rows["same"]["std"] == 0.0
    assert rows["nothing"]["col_type"] == "text" and rows["nothing"]["missing_rate"] == 1.0
    assert rows["odd"]["mean"] is None
    assert rows["tag"]["top_values"][0]["value"] == "x"


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,), (10,)], "v int")
    assert cw.describe_numeric(df).first()["mode"] == 1.0


def test_cleaning_invariants(spark):
    df = dirty(spark, SF)
    cleaned, plan = cw.clean(df)
    assert cleaned.count() == plan.source.count()
    bad = cleaned.where(F.col("review_required") != (F.col("review_notes") != ""))
    assert bad.isEmpty()
    # Normalising twice gives what normalising once gives.
    for column, action in (("account_created", "parse_and_flag"), ("email", "normalize_and_flag"),
                           ("segment", "fill_mode"), ("segment", "fill_unknown"),
                           ("is_active", "normalize_boolean"), ("full_name", "title_case")):
        once = cw.CleaningPlan.fit_column(df, column, action).cleaned().select("customer_id", column)
        twice = cw.CleaningPlan.fit_column(once, column, action).cleaned().select("customer_id", column)
        assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty(), action
    unknown = cw.CleaningPlan.fit_column(df, "segment", "polish")
    assert "warning" in unknown.columns["segment"].details
    with pytest.raises(ValueError):
        cw.CleaningPlan.fit_column(df, "absent")


def test_transform_has_no_shuffle(spark):
    plan = cw.CleaningPlan.fit_column(dirty(spark, SF), "age", "convert_and_flag")
    text = plan.cleaned()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_two_by_two_table_gets_the_correction(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    df = spark.createDataFrame(rows, "p string, q string")
    found = insights.detect_cat_cat(insights.TableScan(df), ["p", "q"])[0]
    n, det = 65, abs(10 * 5 - 20 * 30)
    chi2 = n * (det - n / 2) ** 2 / (30 * 35 * 40 * 25)
    assert found["metrics"]["chi2"] == pytest.approx(chi2, abs=1e-3)


def test_no_column_or_value_is_left_out(spark):
    """14 numbers, 9 categories, one of them with 60 values; limits are the caller's."""
    rows = [tuple(float((i * (j + 3)) % 97 + j) for j in range(14))
            + tuple(f"v{(i * 13 + j) % (60 if j == 0 else 3 + j)}" for j in range(9)) for i in range(600)]
    names = [f"n{j}" for j in range(14)] + [f"c{j}" for j in range(9)]
    df = spark.createDataFrame(rows, names)
    scan = insights.TableScan(df)
    assert len(scan.numeric()) == 14 and scan.categorical() == names[14:]
    few = insights.TableScan(df, max_columns=4, max_values=50)
    assert len(few.numeric()) == 4 and few.categorical() == names[15:19]
    pdf = df.toPandas()
    for found in insights.detect_cat_num(scan, ["c0", "c4"], ["n0", "n5"]):
        cat, num = found["columns"]
        means = pdf.groupby(cat)[num].mean()
        assert found["metrics"]["top_value"] == round(means.max(), 2)
        assert found["metrics"]["low_value"] == round(means.min(), 2)
        assert found["metrics"]["group_count"] == len(means)
        inside = pdf[num] - pdf.groupby(cat)[num].transform("mean")
        between = ((pdf.groupby(cat)[num].transform("mean") - pdf[num].mean()) ** 2).sum()
        f = between / (len(means) - 1) / ((inside ** 2).sum() / (len(pdf) - len(means)))
        assert found["metrics"]["anova_f"] == pytest.approx(f, abs=2e-3)
    assert insights.group_means(scan, ["c0"], ["n0"]).count() == 60


def test_box_counts_and_lists_both_sides(spark):
    values = [float(50 + i % 10) for i in range(2000)] + [-1000.0 - i for i in range(120)] + [1000.0 + i for i in range(30)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = cw.chart_data(df, "box", "v").first()
    assert (row["low_outliers"], row["high_outliers"]) == (120, 30)
    sides = {r["side"]: r["count"] for r in charts.box_outliers(df, "v").groupBy("side").count().collect()}
    assert sides == {"low": 120, "high": 30}
    assert charts.box_outliers(df, "v", max_points=7).count() == 7


def test_grouped_median_keeps_null_and_hot_groups(spark):
    rows = ([("hot", float(i % 501)) for i in range(4001)] + [("one", 5.0), (None, 1.0), (None, 2.0)]
            + [("far", v) for v in (1.0, 1e9, 2e9, 3.0)])
    df = spark.createDataFrame(rows, "g string, y double")
    found = {r["g"]: r["value"] for r in cw.operators.stats.grouped_median(df, ["g"]).collect()}
    hot = sorted(float(i % 501) for i in range(4001))[2000]
    assert found == {"hot": hot, "one": 5.0, None: 1.5, "far": (3.0 + 1e9) / 2}


def test_ranked_insights(spark):
    rows = [(i, float(i * 2 + (i % 5)), "ab"[i % 2], f"2020-01-{i % 28 + 1:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, amount double, kind string, day string")
    found = cw.explain(cw.detect_insights(df))
    top = found.orderBy("insight_id").collect()
    assert [r["insight_id"] for r in top] == [f"ins_{i + 1:03d}" for i in range(len(top))]
    scores = [r["score"] for r in top]
    assert scores == sorted(scores, reverse=True)
    assert all(r["explanation"] and r["reliability_notes"] for r in top)
    detail, chart = cw.insight_details(df, found, "ins_001")
    assert detail.count() == 1 and (chart is None or chart.count() > 0)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 7, "v double")
    rows = cw.chart_data(df, "histogram", "v").collect()
    assert sum(r["count"] for r in rows) == 7 and len(rows) == 5
    assert rows[0]["bin_from"] == 2.5 and rows[-1]["bin_to"] == 3.5


def test_grouped_bar_fills_gaps_with_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "n string, g string")
    rows = [r.asDict() for r in cw.chart_data(df, "grouped_bar", "n", group_by="g").collect()]
    assert rows == [{"name": "a", "x": 2, "y": 0}, {"name": "b", "x": 0, "y": 1}]
    with pytest.raises(ValueError):
        cw.chart_data(df, "radar", "n")
    with pytest.raises(ValueError):
        cw.chart_data(df, "bar", "absent")


def test_short_line_keeps_its_points(spark):
    df = spark.createDataFrame([("2020-01-02", 2.0), ("2020-01-01", 1.0), ("2020-01-02", 4.0)],
                               "d string, v double")
    rows = [tuple(r) for r in cw.chart_data(df, "line", "d", "v", raw_points=True).collect()]
    assert rows == [("2020-01-01", 1.0), ("2020-01-02", 2.0), ("2020-01-02", 4.0)]


def test_domains(spark):
    catalog = spark.createDataFrame(
        [("s", 0, "order"), ("s", 1, "product price"), ("s", 2, "order_date"), ("o", 0, "foo")],
        "table_name string, position int, column_name string")
    found = {r["table_name"]: r for r in cw.detect_domains(catalog).collect()}
    assert found["o"]["dataset_type"] == "generic"
    assert found["s"]["dataset_type"] == "ecommerce"
    assert found["s"]["detected_signals"] == ["order", "product", "price"]
    assert found["s"]["confidence"] == 0.44
    advice = {r["column_name"]: r["template_action"]
              for r in cw.column_advice(catalog, cw.detect_domains(catalog)).collect()}
    assert advice == {"product price": "impute_median", "order_date": "parse_and_flag"}


def test_grouped_profile_matches_the_profile_of_each_group(spark):
    """Every group against the profile of its rows alone, under the types of the whole table."""
    rows = [(g, float(i * i % 17) if i % 5 else float("nan"), "x" if i == 3 else (None if i % 7 == 0 else str(i % 4)),
             ["a@b.com", "bad@@", None][i % 3], ["2024-01-0%d" % (i % 8 + 1), "never", None][i % 3], i)
            for g in ("a", "b", None) for i in range(24)] + [("a", 900.0, "7", None, None, 99)]
    df = spark.createDataFrame(rows, "g string, amount double, age string, email string, joined_date string, k int")
    types = {"amount": "numeric", "age": "age", "email": "email", "joined_date": "date", "k": "numeric"}
    found = {(r["group_key"], r["column_name"]): r for r in profile_groups(df, F.col("g"), types).collect()}
    assert len(found) == 3 * len(types)
    for g in ("a", "b", None):
        part = df.where(F.col("g").eqNullSafe(F.lit(g)))
        for one in profile_rows(part, list(types)):
            many = found[g, one["column_name"]]
            for field in ("total_rows", "missing_count", "missing_rate", "unique_count", "unique_ratio", "invalid_numeric_count",
                          "invalid_date_count", "invalid_email_count", "skewness"):
                assert many[field] == pytest.approx(one[field]), (g, one["column_name"], field)
    assert found["a", "amount"]["outlier_count_iqr"] == 1
    assert profile_groups(df.limit(0), F.col("g"), types).count() == 0


def _grouped(spark):
    return spark.range(0, 6000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE CAST(pmod(xxhash64(id), 40) AS STRING) END AS g",
        "CAST(pmod(xxhash64(id, 1), 700) AS DOUBLE) * IF(id % 50 = 0, 90, 1) AS amount",
        "IF(id % 9 = 0, NULL, CONCAT(CAST(pmod(xxhash64(id, 2), 60) AS STRING), IF(id % 13 = 0, 'x', ''))) AS age",
        "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'bad@@' ELSE CONCAT('a', CAST(id % 50 AS STRING), '@b.com') END AS email",
        "REPEAT(CONCAT('w', CAST(id % 30 AS STRING)), 40) AS words", "timestamp_seconds(CAST(id % 100 AS BIGINT)) AS at", "1882 / 7 AS one",
        "IF(id % 11 = 0, CAST('NaN' AS DOUBLE), IF(id % 2 = 0, 0.0D, -0.0D)) AS zero", "id % 4 = 0 AS is_it")


_GROUPED_TYPES = {"amount": "numeric", "age": "age", "email": "email", "words": "text", "at": "date", "one": "numeric",
                  "zero": "numeric", "is_it": "boolean"}


def test_large_groups_are_measured_like_others(spark, monkeypatch):
    """Side by side in one task, in small batches, or melted where a group has too many cells."""
    def found():
        return {(r.group_key, r.column_name): r.asDict() for r in profile_groups(_grouped(spark), F.col("g"), _GROUPED_TYPES).collect()}
    whole = found()
    assert len(whole) == 42 * len(_GROUPED_TYPES)
    hot = whole["hot", "zero"]
    assert (hot["total_rows"], hot["unique_count"], hot["missing_count"]) == (2000, 1, 182)
    assert whole["hot", "words"]["unique_count"] == 10 and whole["hot", "at"]["unique_count"] == 100
    assert whole["hot", "amount"]["outlier_count_iqr"] > 0 and whole["hot", "age"]["invalid_numeric_count"] > 0
    monkeypatch.setattr(groups, "ACCURACY", 50)  # a rough sketch must do
    for cells in (8 * 400, 8 * 2):  # one large group, then all of them
        monkeypatch.setattr(groups, "CELLS", cells)
        assert {k: r for k, r in found().items() if k[1] != "one"} == {k: r for k, r in whole.items() if k[1] != "one"}


def test_training_rows_are_profiled_once(spark):
    """Whoever reads the rows twice, as shares and splits do, reads the written profiles."""
    made = am.training_rows({"t": (_grouped(spark).drop("words"), F.col("g"))})
    for used in (made, am.distribution(made, am.LABEL), am.with_splits(made)):
        plan = used._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "Range" not in plan and "Generate" not in plan
    shares = am.distribution(made, am.LABEL).collect()
    assert sum(r.rows for r in shares) == 42 * 8 and sum(r.share for r in shares) == pytest.approx(1, abs=1e-3)


def _shuffled(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for f in folders for p in Path(str(f)).rglob("shuffle_*.data") if p.exists())


def test_training_leaves_no_cells_on_disk(spark):
    """What the profiles shuffled is gone when models are trained; a fold finds the rows of the splits only."""
    sf = "/root/testdata/sf0.01"
    given = sum(Path(sf, f"{t}.parquet").stat().st_size for t in ("customer", "lineitem", "events"))
    before = _shuffled(spark)
    rows = registry._training(spark, sf)
    deadline = time.time() + 10  # Spark removes files in the background
    while _shuffled(spark) - before > 2 * given and time.time() < deadline:
        time.sleep(0.2)
    assert _shuffled(spark) - before <= 2 * given
    assert rows.count() == 2042


def test_grouped_profile_shuffles_cells_once(spark):
    df = _grouped(spark)
    made = profile_groups(df, F.col("g"), _GROUPED_TYPES)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    # Many tasks hold parts of a constant column: no rounding may turn into shape.
    assert {r.skewness for r in made.where("column_name = 'one'").collect()} == {0.0}
    # Distinct cells decide no type here but that of words and of g.
    counted = []
    wanted = profiling.frequency_summary
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(profiling, "frequency_summary", lambda df, values, *a: counted.extend(values) or wanted(df, values, *a))
        found = {r["column_name"]: r["semantic_type"] for r in profiling.type_rows(df, "cleaning", False)}
    assert sorted(counted) == ["g", "words"]
    assert found == {r["column_name"]: r["semantic_type"] for r in profiling.type_rows(df, "cleaning")}


def test_action_model(spark, tmp_path):
    rows = QUERIES["training_profiles"](spark, SF).withColumn(
        "key", F.concat_ws("|", "table_name", "group_key", "column_name"))
    rows = stage(am.with_splits(rows, 3))
    total = rows.count()
    share = rows.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert share == pytest.approx(0.2, abs=0.05)
    model = am.train_action_model(rows.where(~F.col("is_test")))
    assert am.evaluate(model, rows).first()["train_accuracy"] > 0.95
    folds = am.cross_validate(rows, 3).collect()
    assert sum(r["scored_rows"] for r in folds) == total and all(r["accuracy"] > 0.8 for r in folds)
    curve = {r["share"]: r for r in am.learning_curve(rows, (0.5, 1.0)).collect()}
    assert curve[0.5]["train_rows"] < curve[1.0]["train_rows"]
    cw.save_model(model, str(tmp_path / "model"))
    again = cw.load_model(str(tmp_path / "model"))
    decided = cw.decide(cw.profile(dirty(spark, SF)), again).collect()
    assert {r["method"] for r in decided} <= {"ml", "fallback_low_confidence"}
    assert all(r["action"] in fixed.ACTIONS for r in decided)


def test_class_report_counts_by_hand(spark):
    pairs = [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "c", "a"), (1, "a", "a"), (1, "b", "a")]
    scored = spark.createDataFrame(pairs, f"fold int, {am.LABEL} string, predicted string")
    report = {(r["fold"], r["label"]): tuple(r[2:]) for r in am.class_report(scored, "fold").collect()}
    assert report == {(0, "a"): (2, 0.5, 0.5, 0.5), (0, "b"): (1, 0.5, 1.0, 0.6667), (0, "c"): (1, 0.0, 0.0, 0.0),
                      (1, "a"): (1, 0.5, 1.0, 0.6667), (1, "b"): (1, 0.0, 0.0, 0.0)}
    assert {r["fold"]: r["accuracy"] for r in am.quality_by(scored, "fold").collect()} == {0: 0.5, 1: 0.5}


def test_correlation_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0, None if i % 2 else float(-i))
                                for i in range(50)], "a double, b double, c double, d double")
    r = {(x["column_a"], x["column_b"]): x["r"] for x in cw.correlations(df).collect()}
    assert r["a", "d"] == -1.0 and r["a", "c"] is None and r["c", "c"] is None
    assert all(r[a, b] == r[b, a] for a, b in r) and math.isclose(r["a", "a"], 1.0)


def test_nan_counts_as_missing_everywhere(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, float("inf")), (4, 2.0)], "k int, x double")
    assert cw.dataset_summary(df).first()["complete_rows"] == 2
    clean = blanks_to_null(df)
    assert [r.x for r in clean.orderBy("k").collect()] == [None, 1.0, None, 2.0]


def test_equality_filter_takes_numbers_as_text(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    rows = lambda v: [r.n for r in charts.filter_rows(df, [{"column": "n", "operator": "==", "value": v}]).collect()]
    assert rows("1.0") == rows("1") == rows(1) == [1] and rows("1.5") == []


def test_long_zoned_timestamp(spark):
    df = spark.createDataFrame([("2020-01-05 10:20:30 America/Argentina/Buenos_Aires",)], "d string")
    assert df.select(X.to_datetime(F.col("d"), "string").alias("d")).first()["d"] is not None


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(tuple(r) for r in cw.read_table(spark, str(tmp_path / "t.csv")).collect()) == [(1, "x\ny"), (2, "z")]


def test_compare_keeps_unmatched_rows(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    clean = spark.createDataFrame([(1, "A"), (None, "c"), (4, "d")], "k int, v string")
    found = {r.k: r.change_type for r in cw.compare(raw, clean, "k").collect()}
    assert found == {1: "FIXED", 2: "REMOVED", None: "OK", 4: "ADDED"}
