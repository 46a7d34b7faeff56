"""Split CSV, positions, date orders, nested cells."""

import datetime as dt
import math
import os
import random
import re
import statistics

import pytest
from pyspark.sql import Row, functions as F

import colwright as cw
from colwright.functions import exprs as X, fixed
from colwright.operators.profiling import date_orders
from colwright.sources import csvsplit
from colwright.sources.tables import distinct_rows, sanitise


@pytest.fixture()
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


def _csv(rows, ends="\n"):
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    return "".join(",".join(quoted(c) if set(c) & set(',"\n\r') else c for c in r) + ends for r in rows)


@pytest.mark.parametrize("size", [50, 400, 1 << 20])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_split_csv_equals_whole_file_reader(spark, tmp_path, small_ranges, size, ends):
    draw = random.Random(size)
    words = ["a", "bc", 'say "hi"', "x,y", "two\nlines", 'end"\n"', '",\n",', "\n\n", "\r\ncarriage", "plain text", "5", "é"]
    rows = [[str(i), draw.choice(words) + draw.choice(words), draw.choice(words)] for i in range(60)]
    rows.insert(30, ["30000", "long " + 'cell "" \n' * 40, "after"])
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,left,right" + ends + _csv(rows, ends), newline="")
    (folder / "b.csv").write_text("id,left,right" + ends + _csv([["70", "last\nrow", "no end"]], "").rstrip(ends), newline="")
    small_ranges(size)
    lines = csvsplit._lines(spark, str(folder), ",")
    assert size > 400 or lines.rdd.getNumPartitions() > 2
    found = cw.read_csv(spark, str(folder))
    whole = cw.read_csv(spark, str(folder), multiLine=True)
    assert found.schema == whole.schema
    # Spark's own reader turns CRLF inside a cell to LF.
    texts = lambda df: sorted(tuple(str(c).replace("\r\n", "\n") for c in r) for r in df.collect())
    assert texts(found) == texts(whole)


def test_split_csv_stray_quotes(spark, tmp_path, small_ranges):
    text = 'id,size,note\n1,5" pipe,x\n2,a"b"c,"1,5"" x"\n3,"open\n5"" end",it"s\n4,,"q" rest\n5,z,""\n'
    (tmp_path / "t.csv").write_text(text)
    small_ranges(9)
    found = {r.id: (r["size"], r.note) for r in cw.read_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert found == {1: ('5" pipe', "x"), 2: ('a"b"c', '1,5" x'), 3: ('open\n5" end', 'it"s'), 4: (None, found[4][1]), 5: ("z", None)}
    whole = {r.id: (r["size"], r.note) for r in cw.read_csv(spark, str(tmp_path / "t.csv"), multiLine=True).collect()}
    assert found == whole


def test_positions_follow_the_file(spark, tmp_path, small_ranges):
    spark.range(0, 1000, 1, 1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "t"))
    small_ranges(500)
    found = cw.positioned(spark.read.parquet(str(tmp_path / "t")))
    assert found.where("id <> row_position").count() == 0 and found.count() == 1000
    made = cw.positioned(spark.range(100).repartition(7))  # no files: positions are unique and gapless
    assert sorted(r.row_position for r in made.collect()) == list(range(100))
    assert cw.positioned(spark.range(0)).count() == 0


def test_compare_by_position(spark):
    rows = [("a", 1.0), ("a", 1.0), (" ", None), ("b", float("nan")), (None, 4.0)]
    raw, cleaned, _ = cw.clean_by_position(spark.createDataFrame(rows, "name string, x double").coalesce(1),
                                           overrides={"name": "fill_unknown", "x": "impute_mean"})
    diff = cw.compare_by_position(raw, cleaned, ["name", "x"])
    found = {(r.row_position, r.column_name): (r.raw_value, r.clean_value, r.change_type) for r in diff.collect()}
    assert found[1, "name"] == ("a", "", "REMOVED") and found[2, "x"][2] == "REMOVED"
    assert found[3, "x"][2] == "FIXED" or found[3, "x"][2] == "FILLED"
    assert found[4, "name"] == ("", "Unknown", "FILLED") and found[0, "name"][2] == "OK"
    assert len(found) == 10
    with pytest.raises(ValueError):
        cw.compare(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), spark.createDataFrame([(1, 2)], "k int, v int"), "k")


def test_inferred_dates(spark):
    day = dt.datetime
    cells = {"05/03/2020 14:30": day(2020, 3, 5, 14, 30), "13/05/2020 01:02:03": day(2020, 5, 13, 1, 2, 3),
             "05/13/2020 3:05 PM": day(2020, 5, 13, 15, 5), "12/01/2020 12:00 am": day(2020, 1, 12),
             "2020.1.5": day(2020, 1, 5), "5-Jan-2020": day(2020, 1, 5), "Mon, 6 January 2020": day(2020, 1, 6),
             "January 5th, 2020": day(2020, 1, 5), "Sept. 5 2019 10:00 UTC": day(2019, 9, 5, 10), "5 Jan 70": day(1970, 1, 5),
             "31/02/2020 10:00": None, "12 monkeys 2020": None, "1.2.3.4": None, "room 5 2020": None, "13/13/2020 10:00": None,
             "5/5/2020 25:00": None, "": None, "text only": None, "2020/01/05T10:11:12Z": day(2020, 1, 5, 10, 11, 12)}
    frame = spark.createDataFrame([(c,) for c in cells], "c string").select("c", X.to_datetime(F.col("c"), "string", True).alias("t"))
    assert {r.c: r.t for r in frame.collect()} == cells


def test_known_shapes_pass_the_common_one():
    samples = ("2020-1-5", "2020-12-31", "2020/1/5", "20200105", "5-1-2020", "05/11/2020", "5.1.2020", "5-1-20", "15/01/20",
               "January 5 2020", "Jan 15 2020", "Jan 15, 2020", "5 January 2020", "15 Jan 2020", "2020-1-5T1:02", "2020-01-05 10:11:12")
    shapes = [*(shape for shape, _ in fixed.DATE_FORMATS), fixed.ISO_DATETIME]
    assert all(any(re.search(shape, c) for c in samples) for shape in shapes)
    assert all(re.search(X._KNOWN, c) for c in samples)
    assert not any(re.search(X._KNOWN, c) for c in ("5/1/2020 10:00", "5-Jan-2020", "1.2.20", "text", ""))


def test_date_inference_parses_nothing_that_fails(spark):
    """A cell is taken apart once for both orders; casts and parsers that throw on odd cells are not reached."""
    df = spark.createDataFrame([("31/04/2020 10:00",)], "c string")
    for used in (X.order_votes(F.col("c")), X._inferred(F.col("c"), lambda n: X._from_numbers(n, True))):
        plan = df.select(used.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
        inferred = plan[plan.index("transform("):]
        assert not re.search(r"try_cast|try_to|gettimestamp", inferred, re.IGNORECASE)
    rows = [(c,) for c in ("31/04/2020 10:00", "29/02/2023 10:00", "02/29/2024 10:00", "30/02/2024 1:00", "00/01/2020 1:00", "13/05/2020 24:00")]
    read = spark.createDataFrame(rows, "c string").select(X.order_votes(F.col("c")).alias("v"), X.to_datetime(F.col("c"), "string", True).alias("t"))
    assert [tuple(r) for r in read.collect()] == [
        (None, None), (None, None), (-1, dt.datetime(2024, 2, 29, 10)), (None, None), (None, None), (None, None)]


def test_date_order_by_vote(spark):
    rows = [("05/03/2020 10:00", "05/03/2020 10:00", "x")] * 5 + [("25/03/2020 10:00", "03/25/2020 10:00", "2020-01-05")] * 2
    rows += [("03/25/2020 10:00", None, None)]
    df = spark.createDataFrame(rows, "day_date string, month_date string, other_date string")
    assert date_orders(df, df.columns) == {"day_date": True, "month_date": False}
    overrides = dict.fromkeys(df.columns, "parse_and_flag")
    cleaned = cw.CleaningPlan.fit(df, overrides=overrides, preflighted=True).cleaned()
    assert {(r.day_date, r.month_date) for r in cleaned.collect()} == {
        ("2020-03-05", "2020-05-03"), ("2020-03-25", "2020-03-25"), ("2020-03-25", None)}


NESTED = "id int, s struct<x:double,y:array<float>>, m map<string,double>, a array<struct<z:double>>"


def test_nested_cells(spark):
    nan, inf = float("nan"), float("inf")
    rows = [Row(1, (nan, [1.0, inf]), {"a": nan, "b": 2.0}, [(nan,), None]), Row(2, None, None, None),
            Row(3, (1.0, None), {}, [])]
    got = sanitise(spark.createDataFrame(rows, NESTED))
    assert got.schema.simpleString() == spark.createDataFrame(rows, NESTED).schema.simpleString()
    out = {r.id: r.asDict(recursive=True) for r in got.collect()}
    assert out[1] == {"id": 1, "s": {"x": None, "y": [1.0, None]}, "m": {"a": None, "b": 2.0}, "a": [{"z": None}, None]}
    assert out[2] == {"id": 2, "s": None, "m": None, "a": None} and out[3]["s"] == {"x": 1.0, "y": None}


def test_duplicates_with_nested_columns(spark):
    rows = [(1, {"a": 1, "b": 2}, [1]), (1, {"b": 2, "a": 1}, [1]), (1, {"a": 1}, [1]), (1, {"a": 1, "b": 2}, [2]), (1, None, None)]
    df = spark.createDataFrame(rows, "id int, m map<string,int>, a array<int>")
    assert cw.dataset_summary(df).first().duplicate_rows == 1
    assert distinct_rows(df).count() == 4 and cw.preflight(df).count() == 4


def test_missing_numbers_on_the_single_column_route(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (1.0,), (None,), (7.0,)], "x double")
    values = lambda action: [r.x for r in cw.CleaningPlan.fit_column(df, "x", action).transform(df).collect()]
    assert values("fill_mode") == [1.0, 1.0, 1.0, 1.0, 7.0]
    assert values("fill_unknown") == ["1.0", "Unknown", "1.0", "Unknown", "7.0"]
    assert values("impute_mean") == [1, 3, 1, 3, 7]
    flagged = cw.CleaningPlan.fit_column(df, "x", "convert_and_flag").transform(df)
    assert not any(r.review_required for r in flagged.collect())


def test_mode_survives_approximate_distinct(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 20 + [(None,)] * 10, "colour string")
    found = [[(r.column_name, r.action) for r in cw.decide(cw.profile(df, approximate_distinct=a)).collect()] for a in (False, True)]
    assert found[0] == found[1] == [("colour", "fill_mode")]


def test_chart_notes(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "v double, g string")
    chart = cw.build_chart(df, "box", "v")
    assert chart.data is None and [(r.kind, r.rows) for r in chart.notes.collect()] == [("unusable", 1), ("too_few", 2)]
    assert cw.build_chart(df, "bar", "g", title="own").title == "own"
    assert cw.build_chart(df.limit(0), "bar", "g").notes.first().kind == "no_rows"
    with pytest.raises(ValueError):
        cw.build_chart(df, "bar", "absent")


def test_more_groups_than_columns(spark):
    df = spark.range(1500).selectExpr("id % 3 AS x", "CAST(id AS STRING) AS g")
    found = cw.chart_data(df, "bar", "x", group_by="g")
    assert found.columns == ["name", "series", "value"] and found.count() == 1500
    few = cw.chart_data(df.where("id < 9"), "bar", "x", group_by="g")
    assert len(few.columns) == 10


@pytest.mark.parametrize("error", [0.05, 0.002])
def test_rank_error_of_sketched_quartiles(spark, error):
    df = spark.range(0, 40_000, 1, 16).selectExpr(
        "CAST(pmod(xxhash64(id), 1000) AS DOUBLE) * IF(id % 3 = 0, 1, -7) AS x", "CAST(NULL AS DOUBLE) AS nothing")
    data = sorted(r.x for r in df.select("x").collect())
    row = cw.describe_numeric(df, ["x", "nothing"], rank_error=error).where("column_name = 'x'").first()
    box = cw.chart_data(df, "box", "x", rank_error=error).first()
    assert (row.q1, row.median, row.q3) == (box.q1, box.median, box.q3)
    for value, p in ((row.q1, .25), (row.median, .5), (row.q3, .75)):
        low, high = sum(x < value for x in data) / len(data), sum(x <= value for x in data) / len(data)
        assert low - error <= p <= high + error
    profiled = cw.profile(df, ["x"], rank_error=error).first()
    assert profiled["median"] == pytest.approx(row.median, abs=1e-3)
    with pytest.raises(ValueError):
        cw.describe_numeric(df, ["x"], rank_error=0)


def test_staged_copy_is_removed(spark):
    _, plan = cw.clean(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    assert os.path.isdir(plan.source.staged_at) and plan.cleaned().count() == 2
    plan.release()
    assert not os.path.exists(plan.source.staged_at)


def test_kolmogorov_smirnov(spark):
    draw = random.Random(3)
    rows = [(draw.gauss(5, 2), draw.random() ** 4, 1.0, None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "bell double, bent double, flat double, nothing double").repartition(6)
    found = {r.column_name: r for r in cw.normality_ks(df).collect()}
    for name, i in (("bell", 0), ("bent", 1)):
        data = sorted(r[i] for r in rows)
        n, mean, std = len(data), statistics.mean(data), statistics.stdev(data)
        share = [.5 * (1 + math.erf((x - mean) / std / math.sqrt(2))) for x in data]
        want = max(max((k + 1) / n - s, s - k / n) for k, s in enumerate(share))
        assert found[name].ks_statistic == pytest.approx(want, abs=1e-6)
    assert found["bell"].is_normal and not found["bent"].is_normal
    assert found["flat"].ks_statistic is None and found["nothing"].n == 0


def test_columns_that_cannot_be_computed(spark):
    df = spark.range(50).selectExpr("id", "1 / (id - 7) AS a", "id % 3 AS b", "CAST(CONCAT('x', id) AS INT) AS c", "id % 2 = 0 AS d")
    assert cw.failing_columns(df) == {"a": "DIVIDE_BY_ZERO", "c": "CAST_INVALID_INPUT"}
    found = cw.analyze_table(df)
    assert {r.column_name for r in found["errors"].collect()} == {"a", "c"}
    assert {r.column_name for r in found["numerical"].collect()} == {"id", "b"} and found["summary"].first().total_columns == 3
    assert cw.analyze_table(df.select("id", "b"))["errors"].count() == 0
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        cw.analyze_table(df.select("a"))
