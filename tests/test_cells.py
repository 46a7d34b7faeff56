"""Cell expressions against hand-written values."""

import pytest
from pyspark.sql import functions as F

from colwright.functions import exprs as X
from colwright.functions.tails import chi2_tail, correlation_p, f_tail, t_two_sided


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def test_numbers(spark):
    cells = [" 12 ", "1e3", "-5", ".5", "5.", "1d", "1_000", "1,200", "inf", "nan", "", None, "1e999"]
    got = apply(spark, cells, lambda c: X.to_number(c, "string"))
    assert got == [12.0, 1000.0, -5.0, 0.5, 5.0] + [None] * 8


def test_money(spark):
    got = apply(spark, ["$1,200", "£5 GBP", "inr 7", "-3", "abc"], lambda c: X.to_money(c, "string"))
    assert got == [1200.0, 5.0, 7.0, -3.0, None]
    got = apply(spark, ["€ 1 200", "12 usd"], lambda c: X.to_profile_number(c, "string"))
    assert got == [1200.0, 12.0]


def test_words(spark):
    got = apply(spark, ["Thirty-five", "forty  nine", "about 12.5 years", "hundred", "many"],
                X.word_to_number)
    assert got == [35.0, 49.0, 12.5, 100.0, None]


def test_dates(spark):
    cells = {
        "2020-1-5": "2020-01-05", "2020/01/05": "2020-01-05", "20200105": "2020-01-05",
        "5-1-2020": "2020-01-05", "31/12/2020": "2020-12-31", "12/31/2020": "2020-12-31",
        "5.1.2020": "2020-01-05", "1/2/68": "2068-02-01", "1/2/69": "1969-02-01",
        "31/02/2020": None, "January 5, 2020": "2020-01-05", "Jan 5 2020": "2020-01-05",
        "5 sep 2021": "2021-09-05", "2020-01-05T10:20:30": "2020-01-05", "not-a-date": None,
        "": None, " 2020-01-05 ": "2020-01-05",
    }
    got = apply(spark, list(cells), lambda c: X.iso_date(X.to_datetime(c, "string")))
    assert dict(zip(cells, got)) == cells


def test_text(spark):
    got = apply(spark, ["o'neil", "abc1def", "  ", "ÉCOLE d'été", "123"], X.title_cell)
    assert got == ["O'Neil", "Abc1Def", "  ", "École D'Été", "123"]
    got = apply(spark, [" A B@X.com.. ", "no"], X.normalize_email)
    assert got == ["ab@x.com", "no"]
    got = apply(spark, ["Yes", "1.0", "0", " off ", "maybe", "2", None], X.to_bit)
    assert got == [1, 1, 0, 0, None, None, None]


@pytest.mark.parametrize("value, expected", [
    (t_two_sided(2.2281, 10), 0.05), (t_two_sided(2.7638, 10), 0.02), (t_two_sided(0, 5), 1.0),
    (f_tail(4.9646, 1, 10), 0.05), (f_tail(2.8661, 4, 20), 0.05), (f_tail(4.4307, 4, 20), 0.01),
    (chi2_tail(3.8415, 1), 0.05), (chi2_tail(18.307, 10), 0.05), (chi2_tail(2.5582, 10), 0.99),
    (correlation_p(0.576, 12), 0.05),
])
def test_tails_against_published_tables(value, expected):
    assert value == pytest.approx(expected, rel=2e-3)
