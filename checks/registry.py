"""Registered queries and, where SQL can express them, the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import colwright as cw
from colwright.functions import exprs as X, fixed
from colwright.operators import charts, insights, stats
from colwright.operators.profiling import date_orders
from colwright.plans import action_model as am
from colwright.sources.staging import scratch_path, stage
from colwright.sources.tables import sanitise
from . import sqlparts as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.DIRTY.replace("FROM customer", "FROM {customer}")
    return spark.sql(text, customer=table(spark, sf_dir, "customer"))


def query(sql: str | None = None):
    """Register a query under the name of its function."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(X.ref(c), digits) for c in columns})


# -- profiles and types ----------------------------------------------------------

PROFILE_COLUMNS = (
    "column_name", "col_type", "total_rows", "missing_count", "missing_rate", "unique_count",
    "unique_ratio", "invalid_numeric_count", "outlier_count_iqr", "invalid_date_count",
    "invalid_email_count", "skewness", "min_value", "max_value", "mean", "median", "std",
    "bool_true_count", "bool_false_count", "bool_invalid_count", "most_common",
)
CUSTOMER_COLUMNS = (
    ("c_custkey", "numeric", "number"), ("c_name", None, "string"),
    ("c_nationkey", "numeric", "number"), ("c_acctbal", "numeric", "number"),
    ("c_mktsegment", None, "string"),
)


def _profile(df):
    found = cw.profile(df, evidence=False).select(*PROFILE_COLUMNS)
    return rounded(found, "min_value", "max_value", "mean", "median", "std")


@query(S.profile(CUSTOMER_COLUMNS, "customer"))
def profile_table(spark, sf_dir):
    return _profile(table(spark, sf_dir, "customer"))


@query(S.with_dirty(S.profile(S.DIRTY_COLUMNS, "dirty")))
def profile_dirty(spark, sf_dir):
    return _profile(dirty(spark, sf_dir))


def _rate(cond, c):
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL)"


def _types_sql(columns, t, mode):
    shapes = fixed.STAT_DATE_SHAPES if mode == "statistics" else fixed.INSIGHT_DATE_SHAPES
    shape = "|".join(f"(?:{p})" for p in shapes)
    parts = []
    for c, kind in columns:
        filled = f"count({c})"
        if kind == "date":
            label = "'date'"
        elif kind == "number":
            label = "'numerical'"
            if mode == "insight" and c.endswith("_id"):
                label = (f"CASE WHEN {filled} < 5 OR count(DISTINCT {c}) / {filled} > 0.95 "
                         "THEN 'id' ELSE 'numerical' END")
        else:
            dates = _rate(f"regexp_matches({S.strip(c)}, '{shape}')", c)
            parsed = _rate(f"{S.day(c)} IS NOT NULL", c)
            numbers = _rate(f"({S.num(c)}) IS NOT NULL", c)
            more = f" OR {parsed} >= 0.75" if mode == "insight" else ""
            free = (f"WHEN count(DISTINCT {c}) / {filled} > 0.9 AND count(DISTINCT {c}) > 100 "
                    "THEN 'text' ") if mode == "insight" else ""
            label = (f"CASE WHEN {filled} = 0 THEN 'categorical' WHEN {dates} >= 0.6{more} "
                     f"THEN 'date' WHEN {numbers} >= 0.8 THEN 'numerical' {free}"
                     "ELSE 'categorical' END")
        parts.append(
            f"SELECT '{c}' AS column_name, {label} AS semantic_type, "
            f"round((count(*) - {filled}) / count(*) * 100, 1) AS missing_pct, "
            f"count(DISTINCT {c}) AS unique_count FROM {t}")
    return " UNION ALL ".join(parts)


DIRTY_KINDS = tuple((c, k) for c, _, k in S.DIRTY_COLUMNS)


def _types(df, mode):
    return cw.semantic_types(df, mode).drop("position")


@query(S.with_dirty(
    "SELECT column_name, col_type AS semantic_type, round(missing_count / total_rows * 100, 1) "
    f"AS missing_pct, unique_count FROM ({S.profile(S.DIRTY_COLUMNS, 'dirty')})"))
def semantic_types_cleaning(spark, sf_dir):
    return _types(dirty(spark, sf_dir), "cleaning")


@query(S.with_dirty(_types_sql(DIRTY_KINDS, "dirty", "statistics")))
def semantic_types_statistics(spark, sf_dir):
    return _types(dirty(spark, sf_dir), "statistics")


@query(S.with_dirty(_types_sql(DIRTY_KINDS, "dirty", "insight")))
def semantic_types_insight(spark, sf_dir):
    return _types(dirty(spark, sf_dir), "insight")


EVENT_KINDS = (("event_id", "number"), ("ts", "date"), ("user_id", "number"),
               ("event_type", "string"), ("value", "number"), ("props", "string"))


@query(_types_sql(EVENT_KINDS, "events", "insight"))
def column_info(spark, sf_dir):
    return _types(table(spark, sf_dir, "events"), "insight")


# -- statistics --------------------------------------------------------------------

LINE_NUMBERS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numeric_sql(columns, t):
    parts = []
    for c in columns:
        mode = (f"(SELECT x FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) AS n FROM {t} "
                f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, x LIMIT 1)")
        parts.append(f"""SELECT * FROM (
          WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {t}),
          m AS (SELECT count(*) AS total, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std,
            var_samp(x) AS variance, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1,
            quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3,
            coalesce(skewness(x), 0) AS skew, coalesce(kurtosis(x), 0) AS kurt,
            count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives FROM v),
          p AS (SELECT avg(power(x - mean, 2)) AS m2, avg(power(x - mean, 3)) AS m3,
            avg(power(x - mean, 4)) AS m4 FROM v, m),
          j AS (SELECT n / 6 * (power(m3 / power(m2, 1.5), 2)
            + power(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m, p),
          o AS (SELECT count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n
            FROM v, m)
          SELECT '{c}' AS column_name, m.n AS count, m.total - m.n AS missing,
            round((m.total - m.n) / m.total * 100, 2) AS missing_pct, CAST(printf('%.4f', mean) AS DOUBLE) AS mean,
            CAST(printf('%.4f', q2) AS DOUBLE) AS median, {mode} AS mode, CAST(printf('%.4f', std) AS DOUBLE) AS std,
            CAST(printf('%.4f', variance) AS DOUBLE) AS variance, CAST(printf('%.4f', lo) AS DOUBLE) AS min_value, CAST(printf('%.4f', hi) AS DOUBLE) AS max_value,
            CAST(printf('%.4f', hi - lo) AS DOUBLE) AS value_range, CAST(printf('%.4f', q1) AS DOUBLE) AS q1, CAST(printf('%.4f', q2) AS DOUBLE) AS q2,
            CAST(printf('%.4f', q3) AS DOUBLE) AS q3, CAST(printf('%.4f', q3 - q1) AS DOUBLE) AS iqr,
            CAST(printf('%.4f', q1 - 1.5 * (q3 - q1)) AS DOUBLE) AS lower_fence,
            CAST(printf('%.4f', q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS upper_fence, round(skew, 4) AS skewness,
            CASE WHEN abs(round(skew, 4)) < 0.5 THEN 'approximately symmetric'
              WHEN abs(round(skew, 4)) < 1 THEN concat('moderately skewed ',
                CASE WHEN skew > 0 THEN 'right' ELSE 'left' END)
              ELSE concat('highly skewed ', CASE WHEN skew > 0 THEN 'right' ELSE 'left' END)
              END AS skewness_label,
            round(kurt, 4) AS kurtosis, o.n AS outlier_count,
            round(o.n / m.n * 100, 2) AS outlier_pct, zeros, negatives AS negative_count,
            round(jb, 2) AS normality_statistic, round(exp(-jb / 2), 6) AS normality_p_value,
            exp(-jb / 2) > 0.05 AS is_normal,
            concat_ws(' | ',
              CASE WHEN round((m.total - m.n) / m.total * 100, 2) > 30 THEN
                concat('missing ', round((m.total - m.n) / m.total * 100, 2), '%') END,
              CASE WHEN abs(round(skew, 4)) > 2 THEN concat('skewness ', printf('%.2f', round(skew, 4))) END,
              CASE WHEN round(o.n / m.n * 100, 2) > 10 THEN
                concat('outliers ', o.n, ' (', round(o.n / m.n * 100, 2), '%)') END,
              CASE WHEN m.n < 30 THEN concat('values ', m.n) END) AS warnings
          FROM m, j, o)""")
    return " UNION ALL ".join(parts)


def _numeric(df, columns):
    found = cw.describe_numeric(df, columns)
    found = found.withColumn("warnings", F.array_join("warnings", " | "))
    return rounded(found, "normality_statistic", digits=2)


@query(_numeric_sql(LINE_NUMBERS, "lineitem"))
def numeric_stats(spark, sf_dir):
    return _numeric(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)


@query(_numeric_sql(("value",), "events"))
def numeric_stats_events(spark, sf_dir):
    return _numeric(table(spark, sf_dir, "events"), ("value",))


def _categorical_sql(columns, t, label="categorical"):
    parts = []
    for c in columns:
        x = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT * FROM (
          WITH f AS (SELECT {S.strip(x)} AS x, count(*) AS k FROM {t} WHERE {c} IS NOT NULL
            GROUP BY 1),
          m AS (SELECT count(*) AS total, count({c}) AS n, count(DISTINCT {c}) AS u FROM {t}),
          e AS (SELECT sum(-(k / m.n) * log2(k / m.n + 1e-12)) AS h FROM f, m),
          t AS (SELECT x, k FROM f ORDER BY k DESC, x LIMIT 1)
          SELECT '{c}' AS column_name, '{label}' AS semantic_type, total, n AS count,
            total - n AS missing, round((total - n) / total * 100, 2) AS missing_pct,
            u AS unique_count, round(u / n * 100, 2) AS cardinality_pct, t.x AS mode,
            t.k AS mode_count, round(t.k / n * 100, 2) AS mode_pct, round(h, 4) AS entropy,
            concat_ws(' | ',
              CASE WHEN round((total - n) / total * 100, 2) > 30 THEN
                concat('missing ', round((total - n) / total * 100, 2), '%') END,
              CASE WHEN round(u / n * 100, 2) > 90 AND u > 10 THEN
                concat('distinct ', u, ' (', round(u / n * 100, 2), '%)') END,
              CASE WHEN round(t.k / n * 100, 2) > 80 AND u > 1 THEN
                concat('mode ', t.x, ' (', round(t.k / n * 100, 2), '%)') END) AS warnings
          FROM m, e, t)""")
    return " UNION ALL ".join(parts)


def _categorical(df, columns, types=None):
    found = cw.describe_categorical(df, columns, types)
    return found.withColumn("warnings", F.array_join("warnings", " | "))


@query(_categorical_sql(("o_orderstatus", "o_orderpriority"), "orders"))
def categorical_stats(spark, sf_dir):
    return _categorical(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(S.with_dirty(_categorical_sql(("full_name", "gender", "segment", "notes"), "dirty")))
def categorical_stats_dirty(spark, sf_dir):
    return _categorical(dirty(spark, sf_dir), ["full_name", "gender", "segment", "notes"])


@query(_categorical_sql(("l_shipdate",), "lineitem", "date"))
def column_analysis(spark, sf_dir):
    found = cw.analyze_column(table(spark, sf_dir, "lineitem"), "l_shipdate")
    return found.withColumn("warnings", F.array_join("warnings", " | "))


def _top_sql(columns, t, k):
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name,
          row_number() OVER (ORDER BY count(*) DESC, {S.strip(c)}) AS rank, {S.strip(c)} AS value,
          count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
          FROM {t} WHERE {c} IS NOT NULL GROUP BY {S.strip(c)}) WHERE rank <= {k}"""
        for c in columns)


@query(_top_sql(("p_brand", "p_type"), "part", 10))
def top_values(spark, sf_dir):
    return cw.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 10)


def _correlation_sql(columns, t):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        + ("1.0 AS r" if a == b else f"round(corr({a}, {b}), 4) AS r FROM {t}")
        for a in columns for b in columns)


LINE_ALL_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey") + LINE_NUMBERS


@query(_correlation_sql(LINE_ALL_NUMBERS, "lineitem"))
def correlation_matrix(spark, sf_dir):
    return cw.correlations(table(spark, sf_dir, "lineitem"))


@query(S.with_dirty(
    "SELECT a AS column_a, b AS column_b, CASE WHEN a = b THEN 1.0 ELSE round(r, 4) END AS r "
    "FROM (SELECT unnest(['customer_id', 'customer_id', 'customer_id', 'loyalty_score', "
    "'loyalty_score', 'loyalty_score', 'credit_score', 'credit_score', 'credit_score']) AS a, "
    "unnest(['customer_id', 'loyalty_score', 'credit_score', 'customer_id', 'loyalty_score', "
    "'credit_score', 'customer_id', 'loyalty_score', 'credit_score']) AS b, "
    "unnest([1.0, kl, kc, kl, 1.0, lc, kc, lc, 1.0]) AS r FROM (SELECT "
    "corr(customer_id, loyalty_score) AS kl, corr(customer_id, credit_score) AS kc, "
    "corr(loyalty_score, credit_score) AS lc FROM dirty))"))
def correlation_with_gaps(spark, sf_dir):
    return cw.correlations(dirty(spark, sf_dir), ["customer_id", "loyalty_score", "credit_score"])


_MISSING = " + ".join(f"count(*) - count({c})" for c, _, _ in S.DIRTY_COLUMNS)
_FULL = " AND ".join(f"{c} IS NOT NULL" for c, _, _ in S.DIRTY_COLUMNS)


@query(S.with_dirty(f"""
  SELECT count(*) AS total_rows, 12 AS total_columns,
    (SELECT count(*) FROM ({_types_sql(DIRTY_KINDS, 'dirty', 'statistics')})
      WHERE semantic_type = 'numerical') AS numerical_columns,
    (SELECT count(*) FROM ({_types_sql(DIRTY_KINDS, 'dirty', 'statistics')})
      WHERE semantic_type <> 'numerical') AS categorical_columns,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
    count(*) FILTER ({_FULL}) AS complete_rows, {_MISSING} AS total_missing_cells,
    round(({_MISSING}) / (count(*) * 12) * 100, 2) AS missing_rate_pct,
    count(*) - count(age) AS missing_age FROM dirty"""))
def dataset_summary(spark, sf_dir):
    found = cw.dataset_summary(dirty(spark, sf_dir))
    return found.withColumn("missing_age", F.col("missing_per_column")["age"]).drop(
        "missing_per_column")


@query("""
  SELECT 'summary' AS section, 'total_rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM orders
  UNION ALL SELECT 'summary', 'duplicate_rows', CAST(count(*) AS DOUBLE)
    - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) FROM orders
  UNION ALL SELECT 'mean', 'o_orderkey', round(avg(o_orderkey), 4) FROM orders
  UNION ALL SELECT 'mean', 'o_custkey', round(avg(o_custkey), 4) FROM orders
  UNION ALL SELECT 'mean', 'o_totalprice', round(avg(o_totalprice), 4) FROM orders
  UNION ALL SELECT 'correlation', 'o_custkey~o_totalprice',
    round(corr(o_custkey, o_totalprice), 4) FROM orders
  UNION ALL SELECT 'unique', 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'unique', 'o_orderdate', count(DISTINCT o_orderdate) FROM orders
  UNION ALL SELECT 'unique', 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'top', 'o_orderstatus', max(n) FROM
    (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
  UNION ALL SELECT 'top', 'o_orderpriority', max(n) FROM
    (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)
  UNION ALL SELECT 'top', 'o_orderdate', max(n) FROM
    (SELECT count(*) AS n FROM orders GROUP BY o_orderdate)""")
def table_analysis(spark, sf_dir):
    found = cw.analyze_table(table(spark, sf_dir, "orders"))
    summary = found["summary"].select(F.lit("summary").alias("section"), F.inline(F.array(
        F.struct(F.lit("total_rows").alias("item"), F.col("total_rows").cast("double").alias("value")),
        F.struct(F.lit("duplicate_rows").alias("item"),
                 F.col("duplicate_rows").cast("double").alias("value")))))
    means = found["numerical"].select(
        F.lit("mean").alias("section"), F.col("column_name").alias("item"), F.col("mean").alias("value"))
    pair = found["correlations"].where("column_a = 'o_custkey' and column_b = 'o_totalprice'").select(
        F.lit("correlation").alias("section"),
        F.concat_ws("~", "column_a", "column_b").alias("item"), F.col("r").alias("value"))
    unique = found["categorical"].select(
        F.lit("unique").alias("section"), F.col("column_name").alias("item"),
        F.col("unique_count").cast("double").alias("value"))
    top = found["top_values"].where("rank = 1").select(
        F.lit("top").alias("section"), F.col("column_name").alias("item"),
        F.col("count").cast("double").alias("value"))
    return summary.unionByName(means).unionByName(pair).unionByName(unique).unionByName(top)


# -- sources -----------------------------------------------------------------------


@query(S.with_dirty("SELECT * FROM (" + S.preflighted() + ")"))
def preflight(spark, sf_dir):
    return cw.preflight(dirty(spark, sf_dir))


_CSV_TYPES = {"customer_id": "bigint", "loyalty_score": "bigint", "credit_score": "bigint"}


@query(S.with_dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{_CSV_TYPES.get(c, 'string')}' AS data_type, "
    f"count(*) AS total_rows, count({c}) AS filled, min(CAST({c} AS VARCHAR)) AS smallest FROM dirty"
    for c, _, _ in S.DIRTY_COLUMNS)))
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv") + ".csv"
    cw.write_csv(dirty(spark, sf_dir), path)
    back = cw.read_table(spark, path, min_columns=2)
    types = {f.name: f.dataType.simpleString() for f in back.schema.fields}
    return back.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                 X.text(X.ref(c)).alias("cell")) for c in back.columns
    ]))).groupBy("column_name", "data_type").agg(
        F.count("*").alias("total_rows"), F.count("cell").alias("filled"),
        F.min("cell").alias("smallest"))


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 50")
def preview(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return cw.preview(events.orderBy("event_id"))


# -- grouped aggregates ----------------------------------------------------------------

FUNCTIONS = {"mean": "avg", "sum": "sum", "count": "count", "median": "median", "min": "min",
             "max": "max"}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS aggregation, o_orderpriority AS name, "
    f"round(CAST({sql}(o_totalprice) AS DOUBLE), 2) AS value FROM orders GROUP BY o_orderpriority"
    for name, sql in FUNCTIONS.items()))
def grouped_aggregates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [
        stats.grouped(orders, ["o_orderpriority"], "o_totalprice", name).select(
            F.lit(name).alias("aggregation"), F.col("o_orderpriority").alias("name"),
            F.round(F.col("value").cast("double"), 2).alias("value"))
        for name in FUNCTIONS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""WITH c AS (
    SELECT unnest(['l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax',
        'l_orderkey', 'l_partkey', 'l_suppkey']) AS column_name,
      unnest([stddev_samp(l_linenumber) / avg(l_linenumber), stddev_samp(l_quantity)
        / avg(l_quantity), stddev_samp(l_extendedprice) / avg(l_extendedprice),
        stddev_samp(l_discount) / avg(l_discount), stddev_samp(l_tax) / avg(l_tax),
        stddev_samp(l_orderkey) / avg(l_orderkey), stddev_samp(l_partkey) / avg(l_partkey),
        stddev_samp(l_suppkey) / avg(l_suppkey)]) AS cv FROM lineitem)
  SELECT 'numerical' AS role, row_number() OVER (ORDER BY cv DESC) AS place, column_name FROM c
  UNION ALL SELECT 'categorical', 1, 'l_returnflag' UNION ALL SELECT 'categorical', 2, 'l_linestatus'
  UNION ALL SELECT 'date', 1, 'l_shipdate'""")
def usable_columns(spark, sf_dir):
    scan = insights.TableScan(table(spark, sf_dir, "lineitem"))
    rows = [
        (role, place, c)
        for role, names in (("numerical", scan.numeric()), ("categorical", scan.categorical()),
                            ("date", scan.dates()))
        for place, c in enumerate(names, 1)
    ]
    return spark.createDataFrame(rows, "role string, place long, column_name string")


# -- decisions and cleaning ------------------------------------------------------------


@query(S.with_dirty(
    f"SELECT column_name, col_type, {S.rule()} AS rule_action FROM "
    f"({S.profile(S.DIRTY_COLUMNS, 'dirty')})"))
def rule_actions(spark, sf_dir):
    profile = cw.profile(dirty(spark, sf_dir), evidence=False)
    return cw.predict(profile).select("column_name", "col_type", "rule_action")


_RULED = f"ruled AS (SELECT column_name, {S.rule()} AS action FROM pr)"


@query(S.with_dirty(
    f", pr AS ({S.profile(S.DIRTY_COLUMNS, 'dirty')}), {_RULED} ".lstrip() + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {S.refined(c, 'dirty', 'r.action')} AS action "
        f"FROM (SELECT action FROM ruled WHERE column_name = '{c}') r"
        for c, _, _ in S.DIRTY_COLUMNS)))
def refined_actions(spark, sf_dir):
    return cw.decide(cw.profile(dirty(spark, sf_dir))).select("column_name", "action")


def _cleaned(column, action, *round_columns, **options):
    def run(spark, sf_dir):
        plan = cw.CleaningPlan.fit_column(dirty(spark, sf_dir), column, action)
        out = plan.cleaned()
        keep = ["customer_id", column] + [c for c in ("review_required", "review_notes")
                                          if c in out.columns]
        return rounded(out.select(*keep), *round_columns)
    return run


def _cleaning(name, column, action, sql, *round_columns):
    QUERIES[name] = _cleaned(column, action, *round_columns)
    SQL[name] = S.with_dirty(sql)


def _review(note):
    return f"({note}) <> '' AS review_required, ({note}) AS review_notes"


def _note(cond, c, words):
    return f"CASE WHEN {cond} THEN '{c}: {words}' ELSE '' END"


for _action, _fill in (("mean", "avg(v)"), ("median", "median(v)")):
    _cleaning(
        f"clean_impute_{_action}", "annual_income", f"impute_{_action}",
        f"SELECT customer_id, round(coalesce(v, f), 4) AS annual_income FROM (SELECT customer_id, "
        f"{S.money('annual_income')} AS v FROM dirty), (SELECT {_fill} AS f FROM (SELECT "
        f"{S.money('annual_income')} AS v FROM dirty))", "annual_income")
_cleaning(
    "clean_impute_whole", "loyalty_score", "impute_mean",
    "SELECT customer_id, CAST(round_even(coalesce(loyalty_score, f), 0) AS BIGINT) AS loyalty_score "
    "FROM dirty, (SELECT avg(loyalty_score) AS f FROM dirty)")
for _column, _kind in (("annual_income", "DOUBLE"), ("age", "BIGINT"), ("loyalty_score", "BIGINT"),
                       ("credit_score", "BIGINT")):
    _cleaning(
        f"clean_convert_{_column}", _column, "convert_and_flag",
        f"SELECT customer_id, CAST(x AS {_kind}) AS {_column}, {_review('note')} FROM "
        f"{S.conversion(_column, 'dirty')}", *(["annual_income"] if _kind == "DOUBLE" else []))
_cleaning(
    "clean_dates", "account_created", "parse_and_flag",
    f"SELECT customer_id, {S.iso('account_created')} AS account_created, "
    + _review(_note(f"account_created IS NOT NULL AND {S.day('account_created')} IS NULL",
                    "account_created", "unparseable date")) + " FROM dirty")
_VALID = f"regexp_matches({S.email('email')}, '{S.EMAIL}')"
_cleaning(
    "clean_email", "email", "normalize_and_flag",
    f"SELECT customer_id, CASE WHEN {_VALID} THEN {S.email('email')} END AS email, "
    + _review(_note(f"email IS NOT NULL AND NOT {_VALID}", "email", "invalid email")) + " FROM dirty")


def _boolean_sql(t):
    return (f"(SELECT *, {S.bit('is_active')} AS bit FROM {t}), (SELECT CASE WHEN "
            f"count(*) FILTER (({S.bit('is_active')}) = 1) > count(*) FILTER "
            f"(({S.bit('is_active')}) = 0) THEN 1 ELSE 0 END AS mode FROM {t})")


_cleaning(
    "clean_boolean", "is_active", "normalize_boolean",
    "SELECT customer_id, CAST(coalesce(bit, mode) AS BIGINT) AS is_active, "
    + _review(_note("bit IS NULL AND is_active IS NOT NULL", "is_active",
                    "unrecognised boolean value")) + f" FROM {_boolean_sql('dirty')}")
_cleaning(
    "clean_outliers", "annual_income", "flag_outliers",
    f"""SELECT customer_id, annual_income, {_review("CASE WHEN v < lo OR v > hi THEN concat("
      "'annual_income: IQR outlier [bounds ', printf('%.2f', lo), '–', printf('%.2f', hi), ']') "
      "ELSE '' END")}
    FROM (SELECT customer_id, annual_income, {S.money('annual_income')} AS v FROM dirty),
      (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT
        quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM (SELECT
          {S.money('annual_income')} AS v FROM dirty)))""")
_cleaning("clean_mode", "segment", "fill_mode",
          f"SELECT customer_id, coalesce(segment, {S.mode_of('segment', 'dirty')}) AS segment "
          "FROM dirty")
_cleaning("clean_unknown", "segment", "fill_unknown",
          "SELECT customer_id, coalesce(nullif(segment, 'nan'), 'Unknown') AS segment FROM dirty")
_cleaning("clean_title", "full_name", "title_case",
          f"SELECT customer_id, {S.title(S.strip('full_name'))} AS full_name FROM dirty")
_cleaning("column_override", "gender", "date_manual_review",
          "SELECT customer_id, gender FROM dirty")
_cleaning("clean_column_default", "gender", None,
          f"SELECT customer_id, CASE WHEN {S.dominance('gender', 'dirty')} >= 0.3 THEN "
          f"coalesce(gender, {S.mode_of('gender', 'dirty')}) ELSE coalesce(gender, 'Unknown') END "
          "AS gender FROM dirty")


def _full_sql():
    """Every cleaned column of the preflighted table, and the review notes."""
    pf = "pf"
    fill = lambda c: (
        f"CASE WHEN {S.dominance(c, pf)} >= 0.3 THEN coalesce(p.{c}, {S.mode_of(c, pf)}) "
        f"ELSE coalesce(nullif(p.{c}, 'nan'), 'Unknown') END AS {c}")
    bad_day = _note(f"p.account_created IS NOT NULL AND {S.day('p.account_created')} IS NULL",
                    "account_created", "unparseable date")
    valid = f"regexp_matches({S.email('p.email')}, '{S.EMAIL}')"
    bad_mail = _note(f"p.email IS NOT NULL AND NOT {valid}", "email", "invalid email")
    bad_bit = _note(f"p.is_active IS NOT NULL AND ({S.bit('p.is_active')}) IS NULL", "is_active",
                    "unrecognised boolean value")
    joins = " ".join(
        f"JOIN {S.conversion(c, pf)} {a} ON {a}.customer_id = p.customer_id"
        for c, a in (("age", "ca"), ("annual_income", "ci"), ("loyalty_score", "cl"),
                     ("credit_score", "cc")))
    body = f"""SELECT p.customer_id, {S.title(S.strip('p.full_name'))} AS full_name,
        CAST(ca.x AS BIGINT) AS age, {fill('gender')},
        CASE WHEN {valid} THEN {S.email('p.email')} END AS email, ci.x AS annual_income,
        {S.iso('p.account_created')} AS account_created, CAST(cl.x AS BIGINT) AS loyalty_score,
        CAST(cc.x AS BIGINT) AS credit_score,
        CAST(coalesce({S.bit('p.is_active')}, mode) AS BIGINT) AS is_active,
        {fill('segment')}, {fill('notes')},
        concat_ws('; ', nullif(ca.note, ''), nullif({bad_mail}, ''), nullif(ci.note, ''),
          nullif({bad_day}, ''), nullif(cl.note, ''), nullif(cc.note, ''), nullif({bad_bit}, ''))
          AS review_notes
      FROM pf p {joins}, (SELECT CASE WHEN count(*) FILTER (({S.bit('is_active')}) = 1) >
        count(*) FILTER (({S.bit('is_active')}) = 0) THEN 1 ELSE 0 END AS mode FROM pf) bm"""
    return f"SELECT *, review_notes <> '' AS review_required FROM ({body})"


@query(S.with_dirty(_full_sql(), pf=True))
def clean_full(spark, sf_dir):
    cleaned, _ = cw.clean(dirty(spark, sf_dir))
    return rounded(cleaned, "annual_income")


@query(S.with_dirty(
    f"SELECT customer_id, full_name, review_notes FROM ({_full_sql()}) WHERE review_required AND "
    "regexp_matches(review_notes, 'email|income|date|could not', 'i')", pf=True))
def review_rows(spark, sf_dir):
    cleaned, _ = cw.clean(dirty(spark, sf_dir))
    return cw.review_rows(cleaned, "email|income|date|could not").select(
        "customer_id", "full_name", "review_notes")


_AGE = S.conversion("age", "pf")


@query(S.with_dirty(
    "SELECT p.customer_id, p.full_name, CAST(a.x AS BIGINT) AS age, p.gender, p.email, "
    "p.annual_income, p.account_created, p.loyalty_score, p.credit_score, p.is_active, p.segment, "
    "p.notes, a.note AS review_notes, a.note <> '' AS review_required FROM pf p "
    f"JOIN {_AGE} a ON a.customer_id = p.customer_id", pf=True))
def column_subset(spark, sf_dir):
    cleaned, _ = cw.clean(dirty(spark, sf_dir), ["age"])
    return cleaned


def _flags(c):
    return f"(SELECT count(*) FROM ({_full_sql()}) WHERE contains(review_notes, '{c}: '))"


_CHANGED = {
    "customer_id": "count(*) FILTER (false)", "full_name": f"count(*) FILTER ({S.strip('full_name')} <> "
                                     f"{S.title(S.strip('full_name'))})",
    "age": f"count(*) FILTER (age IS NOT NULL AND coalesce({S.money('age')}, {S.word('age')}) IS NULL)",
    "gender": "count(*) - count(gender)", "email": f"count(*) FILTER ({_VALID})",
    "annual_income": f"count(*) FILTER (annual_income IS NOT NULL AND {S.money('annual_income')} "
                     "IS NULL)",
    "account_created": f"count({S.day('account_created')})", "loyalty_score": "count(*) FILTER (false)",
    "credit_score": "count(*) FILTER (false)", "is_active": f"count({S.bit('is_active')})",
    "segment": "count(*) - count(segment)", "notes": "count(*) - count(notes)",
}
_FLAGGING = ("age", "email", "annual_income", "account_created", "loyalty_score", "credit_score",
             "is_active")
_REPORT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({_CHANGED[c]} AS BIGINT) AS cells_changed, "
    f"CAST({_flags(c) if c in _FLAGGING else 0} AS BIGINT) AS cells_flagged FROM pf"
    for c, _, _ in S.DIRTY_COLUMNS)


@query(S.with_dirty(_REPORT, pf=True))
def cleaning_report(spark, sf_dir):
    _, plan = cw.clean(dirty(spark, sf_dir))
    return plan.report().select("column_name", "cells_changed", "cells_flagged")


@query(S.with_dirty(f"""
  SELECT 12 AS columns_processed, 1 AS columns_skipped,
    CAST(sum(cells_changed) AS BIGINT) AS total_cells_changed,
    CAST(sum(cells_flagged) AS BIGINT) AS total_cells_flagged,
    (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM pf) AS rows_after,
    (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))
      AS duplicate_rows_dropped,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) - (SELECT count(*) FROM pf)
      AS empty_rows_dropped, 0 AS ml_used_count, 11 AS rule_used_count
  FROM ({_REPORT})""", pf=True))
def cleaning_summary(spark, sf_dir):
    _, plan = cw.clean(dirty(spark, sf_dir))
    return plan.summary()


# -- raw against cleaned ---------------------------------------------------------------

# Columns whose cleaned text is the same in both engines (no computed decimals).
_COMPARED = ("full_name", "age", "gender", "email", "account_created", "is_active", "segment")


def _changes_sql():
    parts = []
    for c in _COMPARED:
        raw = f"coalesce({S.strip(f'CAST(p.{c} AS VARCHAR)')}, '')"
        new = f"coalesce({S.strip(f'CAST(f.{c} AS VARCHAR)')}, '')"
        parts.append(
            f"SELECT p.customer_id, '{c}' AS column_name, {raw} AS raw_value, {new} AS clean_value, "
            f"CASE WHEN {raw} = '' AND {new} = '' THEN 'MISSING' WHEN {raw} = '' THEN 'FILLED' "
            f"WHEN {new} = '' THEN 'FLAGGED' WHEN {raw} <> {new} THEN 'FIXED' ELSE 'OK' END "
            "AS change_type FROM pf p JOIN full_clean f ON f.customer_id = p.customer_id")
    return " UNION ALL ".join(parts)


def _with_full(body):
    return S.with_dirty(f", full_clean AS ({_full_sql()}), ch AS ({_changes_sql()}) {body}", pf=True)


@query(_with_full("SELECT * FROM ch WHERE change_type IN ('FILLED', 'FIXED', 'FLAGGED')"))
def change_log(spark, sf_dir):
    _, plan = cw.clean(dirty(spark, sf_dir))
    return cw.change_log(plan.changes("customer_id", _COMPARED))


@query(_with_full("SELECT change_type, count(*) AS cells FROM ch GROUP BY change_type"))
def change_totals(spark, sf_dir):
    cleaned, plan = cw.clean(dirty(spark, sf_dir))
    return cw.change_totals(cw.compare(plan.source, cleaned, "customer_id", _COMPARED))


@query(_with_full("SELECT *, before - after AS fixed, CASE WHEN after = 0 AND before > 0 THEN "
                  "concat('All ', before, ' filled') WHEN after > 0 AND before = 0 THEN "
                  "concat(after, ' nulled (invalid data)') WHEN after > 0 THEN concat(before - after, "
                  "' filled, ', after, ' unparseable remain') ELSE 'No missing' END AS result FROM ("
                  + " UNION ALL ".join(
                      f"SELECT '{c}' AS column_name, (SELECT count(*) - count({c}) FROM pf) "
                      f"AS before, (SELECT count(*) - count({c}) FROM full_clean) AS after"
                      for c, _, _ in S.DIRTY_COLUMNS) + ")"))
def missing_scorecard(spark, sf_dir):
    cleaned, plan = cw.clean(dirty(spark, sf_dir))
    return cw.missing_scorecard(plan.source, cleaned)


@query(S.with_dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS missing_count, "
    f"CAST(round((count(*) - count({c})) / count(*) * 100) AS BIGINT) AS missing_pct, "
    f"coalesce(array_to_string((list_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER "
    f"(lower(CAST({c} AS VARCHAR)) IN {S.BAD}))), ', '), '') AS sample_issues FROM dirty"
    for c, _, _ in S.DIRTY_COLUMNS)))
def raw_snapshot(spark, sf_dir):
    return cw.raw_snapshot(dirty(spark, sf_dir))


@query(S.with_dirty(" UNION ALL ".join(
    f"SELECT customer_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CASE WHEN {c} IS NULL "
    f"THEN 'missing' ELSE 'invalid' END AS problem FROM dirty WHERE {c} IS NULL OR "
    f"lower({S.strip(f'CAST({c} AS VARCHAR)')}) IN {S.BAD}"
    for c, _, _ in S.DIRTY_COLUMNS if c != "customer_id")))
def problem_cells(spark, sf_dir):
    return cw.problem_cells(dirty(spark, sf_dir), "customer_id")


# -- insights --------------------------------------------------------------------------


_LABELS = ("top_category", "top_a", "top_b", "trend")


def _metrics(spark, rows, *fields):
    """Two column names, the given metrics and labels, strength."""
    schema = "column_a string, column_b string, strength string, " + ", ".join(
        f"{f} {'string' if f in _LABELS else 'double'}" for f in fields)
    data = []
    for r in rows:
        pool = r["metrics"] | r["labels"] | {"trend": r["labels"].get("trend_direction")}
        names = r["columns"] + [None]
        data.append((names[0], names[1], r["strength"], *[pool.get(f) for f in fields]))
    return spark.createDataFrame(data, schema)


_PAIR_LIST = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]]


@query("SELECT *, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN "
       "abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END AS strength FROM ("
       + " UNION ALL ".join(
           f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 3) AS r, "
           f"CAST(count(*) AS DOUBLE) AS sample_size FROM lineitem" for a, b in _PAIR_LIST) + ")")
def insight_num_num(spark, sf_dir):
    scan = insights.TableScan(table(spark, sf_dir, "lineitem").select(*LINE_NUMBERS))
    rows = insights.detect_num_num(scan, list(LINE_NUMBERS))
    return _metrics(spark, rows, "correlation", "sample_size").withColumnRenamed("correlation", "r")


def _cat_num_sql(cat, num, t):
    return f"""SELECT * FROM (WITH g AS (SELECT {cat} AS g, avg({num}) AS m, count(*) AS n,
        var_pop({num}) * count(*) AS w FROM {t} GROUP BY 1),
      o AS (SELECT avg({num}) AS mean, stddev_samp({num}) AS std, count(*) AS n FROM {t}),
      a AS (SELECT sum(g.n * power(m - o.mean, 2)) AS ssb, sum(w) AS ssw, count(*) AS k FROM g, o),
      top AS (SELECT * FROM g ORDER BY m DESC, g LIMIT 1),
      low AS (SELECT * FROM g ORDER BY m, g DESC LIMIT 1)
      SELECT '{cat}' AS column_a, '{num}' AS column_b, top.g AS top_category,
        round(top.m, 2) AS top_value, round(low.m, 2) AS low_value, round(o.mean, 2) AS overall_mean,
        round((top.m - o.mean) / o.std, 3) AS diff_z,
        round(abs(top.m - low.m) / abs(o.mean) * 100, 1) AS diff_pct,
        round((ssb / (k - 1)) / (ssw / (o.n - k)), 3) AS anova_f, CAST(k AS DOUBLE) AS group_count,
        CAST(o.n AS DOUBLE) AS sample_size,
        CASE WHEN abs((top.m - o.mean) / o.std) >= 1 THEN 'strong' WHEN
          abs((top.m - o.mean) / o.std) >= 0.5 THEN 'moderate' WHEN
          abs((top.m - o.mean) / o.std) >= 0.2 THEN 'weak' ELSE 'very weak' END AS strength
      FROM top, low, o, a)"""


@query(" UNION ALL ".join(
    _cat_num_sql(c, n, "lineitem") for c in ("l_returnflag", "l_linestatus")
    for n in ("l_quantity", "l_extendedprice")))
def insight_cat_num(spark, sf_dir):
    names = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]
    scan = insights.TableScan(table(spark, sf_dir, "lineitem").select(*names))
    rows = insights.detect_cat_num(scan, names[:2], names[2:])
    return _metrics(spark, rows, "top_category", "top_value", "low_value", "overall_mean", "diff_z",
                    "diff_pct", "anova_f", "group_count", "sample_size")


def _trend_sql(d, c, t):
    return f"""SELECT '{d}' AS column_a, '{c}' AS column_b, CASE WHEN cov > 0 THEN 'increasing' ELSE
        'decreasing' END AS trend, round(cov * cov / (vx * vy), 3) AS r_squared,
        round(cov / sqrt(vx), 4) AS slope, CAST(n AS DOUBLE) AS sample_size,
        CASE WHEN cov * cov / (vx * vy) >= 0.5 THEN 'strong' WHEN cov * cov / (vx * vy) >= 0.2 THEN
        'moderate' WHEN cov * cov / (vx * vy) >= 0.05 THEN 'weak' ELSE 'very weak' END AS strength
      FROM (SELECT covar_pop({c}, x) AS cov, var_pop(x) AS vx, var_pop({c}) AS vy, count(*) AS n
        FROM (SELECT CAST({c} AS DOUBLE) AS {c},
          CAST(date_diff('day', DATE '1970-01-01', CAST({d} AS DATE)) AS DOUBLE) AS x FROM {t}))"""


@query(" UNION ALL ".join([_trend_sql("o_orderdate", c, "orders")
                           for c in ("o_totalprice", "o_custkey", "o_orderkey")]))
def insight_trend(spark, sf_dir):
    scan = insights.TableScan(table(spark, sf_dir, "orders"))
    rows = insights.detect_date_num(scan, ["o_orderdate"], ["o_totalprice", "o_custkey", "o_orderkey"])
    return rounded(_metrics(spark, rows, "trend", "r_squared", "slope", "sample_size"), "slope")


def _cat_cat_sql(a, b, t):
    return f"""SELECT * FROM (WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t}
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
      n AS (SELECT CAST(sum(o) AS DOUBLE) AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM o),
      ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1),
      e AS (SELECT ra.a, rb.b, coalesce(o.o, 0) AS o, ra * rb / n AS e FROM n, ra CROSS JOIN rb
        LEFT JOIN o ON o.a = ra.a AND o.b = rb.b),
      x AS (SELECT sum(CASE WHEN ka = 2 AND kb = 2
          THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2
        FROM e, n),
      v AS (SELECT chi2, sqrt(chi2 / (n * (least(ka, kb) - 1))) AS v FROM x, n),
      top AS (SELECT a, b FROM o ORDER BY o DESC, a, b LIMIT 1)
      SELECT '{a}' AS column_a, '{b}' AS column_b, round(v, 3) AS cramers_v, round(chi2, 3) AS chi2,
        CAST((ka - 1) * (kb - 1) AS DOUBLE) AS dof, n AS sample_size, top.a AS top_a, top.b AS top_b,
        CASE WHEN v >= 0.5 THEN 'strong' WHEN v >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength
      FROM v, n, top WHERE v >= 0.1)"""


_DOCS = ("SELECT d.lang, d.source, CAST(l.quality AS VARCHAR(20)) AS quality, CAST(l.toxic AS VARCHAR(20)) "
         "AS toxic, CASE WHEN d.n_chars > 1000 THEN 'long' ELSE 'short' END AS size, CASE WHEN "
         "d.n_chars > 2000 THEN 'big' WHEN d.n_chars > 500 THEN 'mid' ELSE 'small' END AS grade "
         "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_DOC_COLUMNS = ("lang", "source", "quality", "toxic", "size", "grade")


@query(f"WITH docs AS ({_DOCS}) " + " UNION ALL ".join(
    _cat_cat_sql(a, b, "docs") for i, a in enumerate(_DOC_COLUMNS) for b in _DOC_COLUMNS[i + 1:]))
def insight_cat_cat(spark, sf_dir):
    docs = spark.sql(
        _DOCS.replace("FROM documents d", "FROM {documents} d").replace("JOIN labels l", "JOIN {labels} l"),
        documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    scan = insights.TableScan(docs)
    rows = insights.detect_cat_cat(scan, list(_DOC_COLUMNS))
    return _metrics(spark, rows, "cramers_v", "chi2", "dof", "sample_size", "top_a", "top_b")


def _quality_sql(c, kind, t, text=False):
    value = c if not text else S.num(c)
    parts = [f"""SELECT '{c}' AS column_a, 'missing' AS finding, round((count(*) - count({c}))
        / count(*) * 100, 1) AS value FROM {t} HAVING (count(*) - count({c})) / count(*) * 100 > 30"""]
    if kind == "numerical":
        parts.append(f"""SELECT '{c}', 'skewness', round(m3 / power(m2, 1.5), 3) FROM (SELECT
          avg(power(x - m, 2)) AS m2, avg(power(x - m, 3)) AS m3, count(x) AS n FROM (SELECT {value}
          AS x FROM {t}), (SELECT avg({value}) AS m FROM {t})) WHERE n >= 5 AND m2 > 0 AND
          abs(m3 / power(m2, 1.5)) >= 1.5""")
        parts.append(f"""SELECT '{c}', 'outlier_pct', round(p, 1) FROM (SELECT count(*) FILTER (x < q1
          - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(x) * 100 AS p FROM (SELECT {value} AS x
          FROM {t}), (SELECT quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3
          FROM {t}) WHERE q3 > q1) WHERE p >= 5""")
    if kind == "id":
        parts.append(f"SELECT '{c}', 'unique_count', CAST(count(DISTINCT {c}) AS DOUBLE) FROM {t}")
    return " UNION ALL ".join(parts)


def _quality(spark, df):
    rows = insights.detect_quality(insights.TableScan(df))
    names = {"missing_pct": "missing", "skewness": "skewness", "outlier_pct": "outlier_pct",
             "unique_count": "unique_count"}
    data = [
        (r["columns"][0], names[m], r["metrics"][m]) for r in rows for m in names if m in r["metrics"]
    ]
    return spark.createDataFrame(data, "column_a string, finding string, value double")


@query(S.with_dirty(" UNION ALL ".join(
    _quality_sql(c, k, "dirty", text) for c, k, text in (
        ("customer_id", "id", False), ("full_name", "text", True), ("age", "numerical", True),
        ("gender", "categorical", True), ("email", "categorical", True),
        ("annual_income", "numerical", True), ("account_created", "date", True),
        ("loyalty_score", "numerical", False), ("credit_score", "numerical", False),
        ("is_active", "categorical", True), ("segment", "categorical", True),
        ("notes", "categorical", True)))))
def insight_quality(spark, sf_dir):
    return _quality(spark, dirty(spark, sf_dir))


@query(" UNION ALL ".join(_quality_sql(c, k, "events") for c, k in (
    ("event_id", "id"), ("ts", "date"), ("user_id", "numerical"), ("event_type", "categorical"),
    ("value", "numerical"), ("props", "text"))))
def insight_quality_events(spark, sf_dir):
    return _quality(spark, table(spark, sf_dir, "events"))


def _flat_insights(found):
    return found.select(
        "insight_id", "type", F.array_join("columns", ",").alias("columns"), "title", "summary",
        "strength", "confidence", "score", "total_found")


@query()
def insight_rank(spark, sf_dir):
    return _flat_insights(cw.detect_insights(table(spark, sf_dir, "orders")))


@query()
def insight_rank_dirty(spark, sf_dir):
    return _flat_insights(cw.detect_insights(dirty(spark, sf_dir)))


@query()
def insight_explanations(spark, sf_dir):
    found = cw.explain(cw.detect_insights(table(spark, sf_dir, "lineitem")))
    return found.select("insight_id", "title", "explanation",
                        F.array_join("reliability_notes", " ").alias("notes"))


# -- charts ----------------------------------------------------------------------------


@query("""SELECT o_totalprice AS x, o_custkey AS y, o_orderpriority AS "group" FROM orders""")
def chart_scatter(spark, sf_dir):
    return cw.chart_data(table(spark, sf_dir, "orders"), "scatter", "o_totalprice", "o_custkey",
                         group_by="o_orderpriority", key=["o_orderkey"])


@query("SELECT o_orderpriority AS name, count(*) AS value FROM orders GROUP BY 1")
def chart_bar_count(spark, sf_dir):
    return cw.chart_data(table(spark, sf_dir, "orders"), "bar", "o_orderpriority")


@query("SELECT p_brand AS name, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1 "
       "ORDER BY avg(p_retailprice) DESC, 1 LIMIT 10")
def chart_bar(spark, sf_dir):
    found = cw.chart_data(table(spark, sf_dir, "part"), "bar", "p_brand", "p_retailprice",
                          aggregation="mean", top_n=10)
    return rounded(found, "value")


@query("SELECT p_type AS name, round(median(p_retailprice), 4) AS value FROM part GROUP BY 1")
def chart_bar_median(spark, sf_dir):
    found = cw.chart_data(table(spark, sf_dir, "part"), "bar", "p_type", "p_retailprice",
                          aggregation="median", sort_by="value")
    return rounded(found, "value")


@query("SELECT CAST(l_linenumber AS VARCHAR) AS name, count(*) FILTER (l_returnflag = 'A') AS \"A\", "
       "count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" "
       "FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber LIMIT 5")
def chart_grouped_count(spark, sf_dir):
    return cw.chart_data(table(spark, sf_dir, "lineitem"), "grouped_bar", "l_linenumber",
                         group_by="l_returnflag", top_n=5)


@query("SELECT l_returnflag AS name, l_linestatus AS series, round(sum(l_extendedprice), 1) AS value "
       "FROM lineitem GROUP BY ALL")
def chart_grouped(spark, sf_dir):
    found = charts.grouped_bar(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus",
                               "l_extendedprice", "sum", wide=False)
    return rounded(found, "value", digits=1)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, round(avg(o_totalprice), 6) AS value "
       "FROM orders GROUP BY o_orderdate")
def chart_line(spark, sf_dir):
    found = cw.chart_data(table(spark, sf_dir, "orders"), "line", "o_orderdate", "o_totalprice",
                          aggregation="mean")
    return rounded(found, "value", digits=6)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS series, "
       "round(max(o_totalprice), 4) AS value FROM orders GROUP BY o_orderdate, o_orderpriority")
def chart_line_series(spark, sf_dir):
    found = charts.line(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "max",
                        "o_orderpriority", wide=False)
    return rounded(found, "value")


def _hist_sql(c, t):
    return f"""WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {t}),
      m AS (SELECT min(x) AS lo, max(x) AS hi, least(30, greatest(5, count(x) // 20)) AS k FROM v),
      w AS (SELECT *, (hi - lo) / k AS step FROM m),
      b AS (SELECT i, lo + i * step AS a, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * step END AS z,
        i = k - 1 AS last FROM w, range(30) r(i) WHERE i < k)
      SELECT concat(printf('%.2f', a), '–', printf('%.2f', z)) AS bin, round(a, 4) AS bin_from,
        round(z, 4) AS bin_to, (SELECT count(*) FROM v WHERE x >= a AND (x < z OR (last AND x <= z)))
        AS count FROM b"""


@query(_hist_sql("l_extendedprice", "lineitem"))
def chart_histogram(spark, sf_dir):
    return cw.chart_data(table(spark, sf_dir, "lineitem"), "histogram", "l_extendedprice")


@query("SELECT p_brand AS bin, CAST(NULL AS DOUBLE) AS bin_from, CAST(NULL AS DOUBLE) AS bin_to, "
       "count(*) AS count FROM part GROUP BY 1")
def chart_histogram_text(spark, sf_dir):
    return cw.chart_data(table(spark, sf_dir, "part"), "histogram", "p_brand")


@query("""WITH q AS (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q),
  o AS (SELECT count(*) FILTER (value < lf) AS low, count(*) FILTER (value > uf) AS high FROM events, f)
  SELECT 'value' AS name, round(lo, 4) AS min_value, round(q1, 4) AS q1, round(q2, 4) AS median,
    round(q3, 4) AS q3, round(hi, 4) AS max_value, round(lf, 4) AS lower_fence,
    round(uf, 4) AS upper_fence, low AS low_outliers, high AS high_outliers FROM f, o""")
def chart_box(spark, sf_dir):
    found = cw.chart_data(table(spark, sf_dir, "events"), "box", "value")
    return rounded(found, "min_value", "q1", "median", "q3", "max_value", "lower_fence", "upper_fence")


@query("""WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
  SELECT 'value' AS name, round(value, 4) AS value, CASE WHEN value < q1 THEN 'low' ELSE 'high' END AS side
  FROM events, f WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def chart_box_outliers(spark, sf_dir):
    return rounded(charts.box_outliers(table(spark, sf_dir, "events"), "value"), "value")


@query("""SELECT o_orderstatus AS category, column_name, round(avg(v), 2) AS mean, count(*) AS rows,
    o_orderstatus AS value FROM (UNPIVOT (SELECT o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
    CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders) ON o_totalprice, o_custkey
    INTO NAME column_name VALUE v) GROUP BY ALL""".replace("o_orderstatus AS category", "'o_orderstatus' AS category"))
def insight_group_means(spark, sf_dir):
    scan = insights.TableScan(table(spark, sf_dir, "orders"))
    found = insights.group_means(scan, ["o_orderstatus"], ["o_totalprice", "o_custkey"])
    return rounded(found, "mean", digits=2)


@query("""SELECT name, round(value, 2) AS value, round(value / sum(value) OVER () * 100, 1) AS pct FROM (
    SELECT l_linenumber::VARCHAR AS name, sum(l_quantity) AS value FROM lineitem
    GROUP BY l_linenumber ORDER BY 2 DESC, l_linenumber LIMIT 4)""")
def chart_pie(spark, sf_dir):
    found = cw.chart_data(table(spark, sf_dir, "lineitem"), "pie", "l_linenumber", "l_quantity",
                          top_n=4)
    return rounded(found, "value", digits=2)


@query("SELECT event_type AS name, count(*) AS value, "
       "round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct FROM events GROUP BY 1")
def chart_pie_count(spark, sf_dir):
    return cw.chart_data(table(spark, sf_dir, "events"), "pie", "event_type")


@query("SELECT o_orderstatus AS name, count(*) AS value FROM orders WHERE o_totalprice >= 50000 AND "
       "o_orderpriority <> '1-URGENT' AND regexp_matches(o_orderpriority, '(?i)low|medium|high') "
       "AND o_custkey < 1000 GROUP BY 1")
def chart_filtered(spark, sf_dir):
    return cw.chart_data(
        table(spark, sf_dir, "orders"), "bar", "o_orderstatus", filters=[
            {"column": "o_totalprice", "operator": ">=", "value": 50000},
            {"column": "o_orderpriority", "operator": "!=", "value": "1-URGENT"},
            {"column": "o_orderpriority", "operator": "contains", "value": "LOW|medium|high"},
            {"column": "o_custkey", "operator": "<", "value": "1000"},
            {"column": "no_such_column", "operator": "==", "value": 1}])


@query(S.with_dirty("SELECT customer_id, segment FROM dirty WHERE segment IS DISTINCT FROM 'BUILDING' "
                    f"AND ({S.num('age')}) <= 40"))
def filtered_rows(spark, sf_dir):
    return cw.filter_rows(dirty(spark, sf_dir), [
        {"column": "segment", "operator": "!=", "value": "BUILDING"},
        {"column": "age", "operator": "<=", "value": 40}]).select("customer_id", "segment")


# -- domains and the action model --------------------------------------------------------


@query(S.with_dirty(
    f", pr AS ({S.profile(S.DIRTY_COLUMNS, 'dirty')}), {_RULED} ".lstrip() + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {S.refined(c, 'dirty', 'r.action')} AS action, "
        f"{template} AS template_action FROM (SELECT action FROM ruled WHERE column_name = '{c}') r"
        for (c, _, _), template in zip(S.DIRTY_COLUMNS, (
            "CAST(NULL AS VARCHAR)", "NULL", "NULL", "NULL", "NULL", "NULL", "'fill_mode'", "NULL",
            "'impute_median'", "NULL", "NULL", "NULL")))))
def template_predictions(spark, sf_dir):
    found = cw.predict_with_template("customers", dirty(spark, sf_dir), split_names=True)
    return found.select("column_name", "action", "template_action")


def _profiled(spark, sf_dir):
    """Profiles of blocks of customers, of the lines of each supplier and of the kinds of events."""
    return am.training_rows({
        "customers": (dirty(spark, sf_dir), F.floor(F.col("customer_id") / 20)),
        "lineitem": (table(spark, sf_dir, "lineitem"), F.col("l_suppkey")),
        "events": (table(spark, sf_dir, "events"), F.col("event_type"))})


def _training(spark, sf_dir):
    return stage(am.with_splits(_profiled(spark, sf_dir)), "training")


_LINEITEM_COLUMNS = tuple(
    (f"l_{c}", "numeric", "number") for c in (
        "orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax")) + (
    ("l_returnflag", "boolean", "string"), ("l_linestatus", None, "string"), ("l_shipdate", "date", "datetime"))
_EVENT_COLUMNS = (
    ("event_id", "id", "number"), ("ts", "date", "datetime"), ("user_id", "id", "number"),
    ("event_type", None, "string"), ("value", "numeric", "number"), ("props", None, "string"))
_GROUPED = "profiled AS (" + "\nUNION ALL ".join((
    S.grouped_profile("customers", S.DIRTY_COLUMNS, "dirty", "customer_id // 20"),
    S.grouped_profile("lineitem", _LINEITEM_COLUMNS, "lineitem", "l_suppkey"),
    S.grouped_profile("events", _EVENT_COLUMNS, "events", "event_type"))) + ")"


@query(S.with_dirty(f", {_GROUPED} SELECT *, {S.rule()} AS recommended_action FROM profiled"))
def training_profiles(spark, sf_dir):
    return _profiled(spark, sf_dir).drop("key")


@query(S.with_dirty(
    f", {_GROUPED} SELECT value, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 4) AS share "
    f"FROM (SELECT {S.rule()} AS value FROM profiled) GROUP BY value"))
def training_distribution(spark, sf_dir):
    return am.distribution(_profiled(spark, sf_dir), am.LABEL)


@query()
def action_model_eval(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return am.evaluate(am.train_action_model(rows.where(~F.col("is_test"))), rows)


@query()
def action_model_report(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = am.train_action_model(rows.where(~F.col("is_test")))
    return am.class_report(am.score_rows(model, rows.where("is_test")))


@query()
def action_model_confusion(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = am.train_action_model(rows.where(~F.col("is_test")))
    return am.confusion(am.score_rows(model, rows), "is_test")


@query()
def action_model_folds(spark, sf_dir):
    return am.cross_validate(_training(spark, sf_dir))


@query()
def action_model_curve(spark, sf_dir):
    return am.learning_curve(_training(spark, sf_dir))


@query()
def action_predict(spark, sf_dir):
    model = am.train_action_model(_training(spark, sf_dir))
    found = cw.decide(cw.profile(dirty(spark, sf_dir)), model)
    return found.select("column_name", "col_type", "rule_action", "predicted_action", "confidence",
                        "method", "action", "refined", "reason")


# -- files without splittable lines, rows without keys, dates without an order, nested cells ------

@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def csv_quoted_lines(spark, sf_dir):
    """Whole texts with line ends, commas and quotes, written as CSV and read by byte ranges."""
    path = scratch_path(spark, "csv") + ".csv"
    cw.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"), path)
    back = cw.read_csv(spark, path)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(_with_full(
    "SELECT column_name, change_type, count(*) AS cells FROM ch GROUP BY ALL UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', 'REMOVED', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM pf)" for c in _COMPARED)))
def change_by_position(spark, sf_dir):
    """Raw against cleaned, row by row, on a table without its key; dropped rows are removed ones."""
    raw, cleaned, _ = cw.clean_by_position(dirty(spark, sf_dir).drop("customer_id"))
    diff = cw.compare_by_position(raw, cleaned, _COMPARED)
    return diff.groupBy("column_name", "change_type").agg(F.count("*").alias("cells"))


_ORDERED = (("mostly_day", "o_orderkey % 3 <> 0"), ("mostly_month", "o_orderkey % 3 = 0"), ("named", None))


def _dates_sql():
    parts = []
    for name, day in _ORDERED:
        cell = (f"CASE WHEN {day} THEN strftime(o_orderdate, '%d/%m/%Y %H:%M') ELSE strftime(o_orderdate, '%m/%d/%Y %H:%M') END"
                if day else "strftime(o_orderdate, '%d-%b-%Y')")
        forms = ["'%d/%m/%Y %H:%M'", "'%m/%d/%Y %H:%M'"] if day else ["'%d-%b-%Y'"] * 2
        parts.append(
            f"SELECT column_name, day_first, strftime(CASE WHEN day_first THEN coalesce(d, m) ELSE coalesce(m, d) END, '%Y-%m-%d') "
            f"AS day, count(*) AS cells FROM (SELECT '{name}' AS column_name, d, m, "
            "sum((d IS NOT NULL)::INT - (m IS NOT NULL)::INT) OVER () >= 0 AS day_first FROM "
            f"(SELECT try_strptime(c, {forms[0]}) AS d, try_strptime(c, {forms[1]}) AS m FROM (SELECT {cell} AS c FROM orders))) GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query(_dates_sql())
def date_order_vote(spark, sf_dir):
    """Order dates as text in two orders, read in the order that most cells of a column allow."""
    orders = table(spark, sf_dir, "orders")
    text = lambda form: F.date_format("o_orderdate", form)
    cells = orders.select(*[
        (F.when(F.expr(day), text("dd/MM/yyyy HH:mm")).otherwise(text("MM/dd/yyyy HH:mm")) if day else text("dd-MMM-yyyy")).alias(name)
        for name, day in _ORDERED])
    first = date_orders(cells, cells.columns)
    long = cells.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(first.get(c)).alias("day_first"),
                 X.iso_date(X.to_datetime(F.col(c), "string", first.get(c))).alias("day")) for c in cells.columns])))
    return long.groupBy("column_name", "day_first", "day").agg(F.count("*").alias("cells"))


@query("""SELECT count(*) + count(*) FILTER (event_id % 10 = 0) AS total_rows, count(*) FILTER (event_id % 10 = 0) AS duplicate_rows,
  count(*) FILTER (event_id % 5 = 0) + count(*) FILTER (event_id % 10 = 0) AS missing_in_struct,
  count(*) FILTER (event_id % 7 = 0) + count(*) FILTER (event_id % 70 = 0) AS missing_in_map,
  round(sum(value) FILTER (event_id % 7 <> 0) + coalesce(sum(value) FILTER (event_id % 10 = 0 AND event_id % 7 <> 0), 0), 2) AS map_sum
  FROM events""")
def nested_cells(spark, sf_dir):
    """Events as structs, arrays and maps with NaN: sanitised, then duplicates counted whatever the
    order of a map's entries."""
    events = table(spark, sf_dir, "events")
    odd = lambda n: F.when(F.col("event_id") % n == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    nested = lambda rows, *entries: rows.select(
        "event_id", F.struct(odd(5).alias("x"), F.array("user_id").alias("users")).alias("s"),
        F.map_from_entries(F.array(*entries)).alias("m"))
    a, b = entry("a", odd(7)), entry("b", F.lit(1.0))
    both = nested(events, a, b).unionByName(nested(events.where("event_id % 10 = 0"), b, a))
    clean = sanitise(both)
    total = cw.dataset_summary(clean).select("total_rows", "duplicate_rows")
    found = clean.agg(F.count_if(F.col("s.x").isNull()).alias("missing_in_struct"),
                      F.count_if(F.col("m")["a"].isNull()).alias("missing_in_map"), F.round(F.sum(F.col("m")["a"]), 2).alias("map_sum"))
    return total.join(found)


# -- charts with notes --------------------------------------------------------------------------

_NOTED = ({"column": "event_type", "operator": "!=", "value": "view"}, {"column": "value", "operator": ">", "value": 10},
          {"column": "no_such", "operator": "==", "value": 1}, {"column": "value", "operator": "<", "value": "many"},
          {"column": "props", "operator": "contains", "value": "("})


@query("""WITH e AS (SELECT *, event_type IS DISTINCT FROM 'view' AS a, coalesce(value > 10, FALSE) AS b,
  CASE WHEN event_id % 4 <> 0 THEN value END AS y FROM events), n AS (
  SELECT 'ignored_group' AS kind, 'no_group' AS subject, NULL::BIGINT AS rows UNION ALL
  SELECT 'kept', 'event_type != view', count(*) FILTER (a) FROM e UNION ALL
  SELECT 'kept', 'value > 10', count(*) FILTER (a AND b) FROM e UNION ALL
  SELECT 'ignored_filter', 'no_such == 1: no such column', NULL UNION ALL
  SELECT 'ignored_filter', 'value < many: no number', NULL UNION ALL
  SELECT 'ignored_filter', 'props contains (: no regular expression', NULL UNION ALL
  SELECT 'unusable', 'y', count(*) FILTER (a AND b AND y IS NULL) FROM e UNION ALL
  SELECT 'sampled', '100 points', count(*) FILTER (a AND b AND y IS NOT NULL) - 100 FROM e UNION ALL
  SELECT 'data', 'event_id vs y', 100 UNION ALL
  SELECT 'nothing: no_rows', 'Distribution of value', 0)
SELECT * FROM n""")
def chart_notes(spark, sf_dir):
    """Notes, title and data size of a chart with filters, gaps and a sample, and of one without rows."""
    events = table(spark, sf_dir, "events").withColumn("y", F.expr("CASE WHEN event_id % 4 <> 0 THEN value END"))
    chart = cw.build_chart(events, "scatter", "event_id", "y", group_by="no_group", filters=_NOTED, max_points=100)
    nothing = cw.build_chart(events, "histogram", "value", filters=[{"column": "value", "operator": "<", "value": -1e30}])
    drawn = chart.data.agg(F.lit("data").alias("kind"), F.lit(chart.title).alias("subject"), F.count("*").alias("rows"))
    assert nothing.data is None
    empty = nothing.notes.where("kind = 'no_rows'").select(
        F.concat(F.lit("nothing: "), "kind").alias("kind"), F.lit(nothing.title).alias("subject"), "rows")
    return chart.notes.drop("position").unionByName(drawn).unionByName(empty)


@query("""SELECT p_type AS name, p_brand AS series, count(*) AS value FROM part GROUP BY 1, 2""")
def chart_grouped_long(spark, sf_dir):
    """A grouped bar in long form, for any number of groups."""
    return cw.chart_data(table(spark, sf_dir, "part"), "bar", "p_type", group_by="p_brand", wide=False)


# -- distance from the normal -------------------------------------------------------------------

_KS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
_KS_SHARE = ("exp(-z * z / 2) / sqrt(2 * pi()) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t "
             "+ 0.319381530) * t")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, n, round(max(greatest(r / n - share, share - (r - m) / n)), 4) AS ks_statistic
  FROM (SELECT n, r, m, CASE WHEN z >= 0 THEN 1 - u ELSE u END AS share FROM (SELECT *, {_KS_SHARE} AS u FROM (
    SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM (SELECT v, m, sum(m) OVER (ORDER BY v) AS r, n, (v - mean) / std AS z
      FROM (SELECT {c}::DOUBLE AS v, count(*) AS m FROM lineitem GROUP BY 1),
           (SELECT count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std FROM lineitem))))) GROUP BY n""" for c in _KS))
def normality_distance(spark, sf_dir):
    """Kolmogorov-Smirnov distance of columns from the normal."""
    return rounded(cw.normality_ks(table(spark, sf_dir, "lineitem"), _KS).select("column_name", "n", "ks_statistic"), "ks_statistic")


@query("""SELECT 'mean' AS section, 'value' AS item, round(avg(value), 4) AS value FROM events UNION ALL
  SELECT 'mean', 'user_id', round(avg(user_id), 4) FROM events UNION ALL
  SELECT 'unique', 'event_type', count(DISTINCT event_type) FROM events UNION ALL
  SELECT 'rows', 'all', count(*) FROM events UNION ALL
  SELECT 'DIVIDE_BY_ZERO', 'ratio', count(*) FILTER (event_id % 1000 = 0) FROM events HAVING count(*) FILTER (event_id % 1000 = 0) > 0 UNION ALL
  SELECT 'CAST_INVALID_INPUT', 'number', NULL FROM events HAVING count(try_cast(event_type AS BIGINT)) < count(*)""")
def analysis_errors(spark, sf_dir):
    """A table with two columns that cannot be computed: the others are analysed, these get their errors."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.expr("value / (event_id % 1000)").alias("ratio"),
        F.col("event_type").cast("bigint").alias("number"))
    found = cw.analyze_table(events)
    row = lambda df, section, value: df.select(
        section.alias("section"), F.col("column_name").alias("item"), F.round(value.cast("double"), 4).alias("value"))
    zeros = table(spark, sf_dir, "events").where("event_id % 1000 = 0").count()
    errors = row(found["errors"], F.col("error"), F.when(F.col("column_name") == "ratio", F.lit(zeros)))
    return (row(found["numerical"], F.lit("mean"), F.col("mean"))
            .unionByName(row(found["categorical"], F.lit("unique"), F.col("unique_count")))
            .unionByName(row(found["summary"].withColumn("column_name", F.lit("all")), F.lit("rows"), F.col("total_rows")))
            .unionByName(errors))
