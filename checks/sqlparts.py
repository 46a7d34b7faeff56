"""Pieces of DuckDB SQL for the result checks."""

DIRTY = """
  WITH b AS (
    SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal,
           DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS d
    FROM customer
  ), r AS (
    SELECT k AS customer_id,
      CASE k % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN upper(c_name) ELSE c_name END AS full_name,
      CASE WHEN k % 11 = 0 THEN NULL WHEN k % 23 = 0 THEN 'thirty five'
           WHEN k % 29 = 0 THEN '-5' WHEN k % 31 = 0 THEN '150' WHEN k % 37 = 0 THEN 'abc'
           ELSE CAST(18 + (k * 7) % 60 AS VARCHAR(20)) END AS age,
      CASE k % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'F' ELSE NULL END AS gender,
      CASE WHEN k % 8 = 0 THEN NULL WHEN k % 21 = 0 THEN 'bad@@x'
           WHEN k % 5 = 0 THEN concat(' ', upper(replace(c_name, '#', '.')), '@Example.com. ')
           ELSE concat(lower(replace(c_name, '#', '.')), '@example.com') END AS email,
      CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'abc' WHEN k % 97 = 0 THEN '999999'
           WHEN k % 19 = 0
             THEN concat('$', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR(30)))
           ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR(30)) END AS annual_income,
      CASE WHEN k % 15 = 0 THEN NULL WHEN k % 41 = 0 THEN 'not-a-date'
           WHEN k % 4 = 0 THEN concat(CAST(year(d) AS VARCHAR(4)), '-',
             lpad(CAST(month(d) AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(day(d) AS VARCHAR(2)), 2, '0'))
           WHEN k % 4 = 1 THEN concat(lpad(CAST(day(d) AS VARCHAR(2)), 2, '0'), '/',
             lpad(CAST(month(d) AS VARCHAR(2)), 2, '0'), '/', CAST(year(d) AS VARCHAR(4)))
           WHEN k % 4 = 2 THEN concat(CAST(year(d) AS VARCHAR(4)),
             lpad(CAST(month(d) AS VARCHAR(2)), 2, '0'), lpad(CAST(day(d) AS VARCHAR(2)), 2, '0'))
           ELSE concat(CAST(day(d) AS VARCHAR(2)), '.', CAST(month(d) AS VARCHAR(2)), '.',
             CAST(year(d) AS VARCHAR(4))) END AS account_created,
      CASE WHEN k % 9 = 0 THEN NULL WHEN k % 53 = 0 THEN 140 ELSE (k * 37) % 101 END
        AS loyalty_score,
      CASE WHEN k % 10 = 0 THEN NULL WHEN k % 61 = 0 THEN 990 ELSE 300 + (k * 13) % 551 END
        AS credit_score,
      CASE k % 10 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f'
        WHEN 4 THEN '1.0' WHEN 5 THEN '0' WHEN 6 THEN 'on' WHEN 7 THEN 'off' WHEN 8 THEN 'maybe'
        ELSE NULL END AS is_active,
      CASE WHEN k % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment,
      CASE WHEN k % 6 = 0 THEN '   ' WHEN k % 6 = 1 THEN NULL
           ELSE concat('note ', CAST(k AS VARCHAR(20))) END AS notes
    FROM b
  )
  SELECT * FROM r
  UNION ALL SELECT * FROM r WHERE customer_id % 50 = 0
  UNION ALL SELECT CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL FROM r WHERE customer_id < 3
"""

# Column, cleaning type (None: found from the cells), storage kind.
DIRTY_COLUMNS = (
    ("customer_id", "id", "number"), ("full_name", None, "string"), ("age", "age", "string"),
    ("gender", "category", "string"), ("email", "email", "string"),
    ("annual_income", "salary", "string"), ("account_created", "date", "string"),
    ("loyalty_score", "score", "number"), ("credit_score", "credit_score", "number"),
    ("is_active", "boolean", "string"), ("segment", None, "string"), ("notes", None, "string"),
)
TEXT_COLUMNS = tuple(c for c, _, kind in DIRTY_COLUMNS if kind == "string")
NUMERIC_TYPES = "('numeric', 'age', 'score', 'credit_score', 'salary')"

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
TRUE = "('true', 'yes', 'y', '1', 't', 'on')"
FALSE = "('false', 'no', 'n', '0', 'f', 'off')"
BAD = "('n/a', 'na', 'abc', 'null', 'none', 'invalid-date', 'not-a-date', 'invalid')"


def strip(x):
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def num(x):
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN TRY_CAST({strip(x)} AS DOUBLE) END"


def f2(x):
    bare = f"regexp_replace({x}, '[£$€,\\s]', '', 'g')"
    return num(f"regexp_replace({bare}, 'gbp|usd|eur', '', 'gi')")


def money(x):
    bare = f"regexp_replace({x}, '[£$€]|gbp|usd|eur|inr', '', 'gi')"
    return num(strip(f"replace({bare}, ',', '')"))


def word(x):
    tidy = f"trim(regexp_replace(lower({x}), '[-_\\s]+', ' ', 'g'))"
    return (f"CASE WHEN {tidy} = 'thirty five' THEN 35.0 ELSE "
            f"TRY_CAST(nullif(regexp_extract({tidy}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) END")


def day(x):
    s = strip(x)
    tries = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
        (r"^\d{8}$", "%Y%m%d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "%m-%d-%Y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"),
    )
    parts = [f"CASE WHEN regexp_matches({s}, '{r}') THEN try_strptime({s}, '{f}') END"
             for r, f in tries]
    return f"CAST(coalesce({', '.join(parts)}) AS DATE)"


def iso(x):
    return f"strftime({day(x)}, '%Y-%m-%d')"


def bit(x):
    s = f"lower({strip(x)})"
    return (f"CASE WHEN {num(s)} IN (0, 1) THEN CAST({num(s)} AS BIGINT) "
            f"WHEN {s} IN {TRUE} THEN 1 WHEN {s} IN {FALSE} THEN 0 END")


def title(x):
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), "
            r"'([a-z]+|[^a-z]+)', 1), lambda w: concat(upper(w[1]), w[2:])), '')")


def email(x):
    return f"regexp_replace(replace(lower({strip(x)}), ' ', ''), '\\.+$', '')"


def blank(x):
    return f"CASE WHEN {strip(x)} <> '' THEN {x} END"


def preflighted(source="dirty"):
    cells = [f"{blank(c)} AS {c}" if c in TEXT_COLUMNS else c for c, _, _ in DIRTY_COLUMNS]
    some = " OR ".join(f"{c} IS NOT NULL" for c, _, _ in DIRTY_COLUMNS)
    return (f"SELECT * FROM (SELECT {', '.join(cells)} FROM (SELECT DISTINCT * FROM {source})) "
            f"WHERE {some}")


def with_dirty(body, pf=False):
    extra = f", pf AS ({preflighted()})" if pf else ""
    return f"WITH dirty AS ({DIRTY}){extra} {body}"


def content_type(c, t):
    """Cleaning type of a text column without a telling name."""
    s = strip(c)
    hit = lambda cond: f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL)"
    return f"""(SELECT CASE
      WHEN count({c}) = 0 THEN 'text'
      WHEN {hit(f"lower({s}) IN {TRUE} OR lower({s}) IN {FALSE}")} >= 0.9 THEN 'boolean'
      WHEN {hit(f"regexp_matches({s}, '{EMAIL}')")} > 0.5 THEN 'email'
      WHEN {hit(f"{day(c)} IS NOT NULL")} > 0.5 THEN 'date'
      WHEN {hit(f"({num(f'regexp_replace({s}, {chr(39)}[£$€,{chr(92)}s]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}) IS NOT NULL")} > 0.7 THEN 'numeric'
      WHEN count(DISTINCT {c}) / count({c}) < 0.15 THEN 'category'
      ELSE 'text' END FROM {t})"""


def profile(columns, t):
    """Profile of table ``t`` in the column order given."""
    parts = []
    for c, kind, storage in columns:
        value = f2(c) if storage == "string" else f"CAST({c} AS DOUBLE)"
        zero = "CAST(0 AS BIGINT)"
        nothing = "CAST(NULL AS DOUBLE)"
        numeric = kind in ("numeric", "age", "score", "credit_score", "salary")
        if numeric:
            measures = f"""
              m.n_ok AS n_ok, round(m.skew, 4) AS skewness, m.lo AS min_value, m.hi AS max_value,
              m.mean AS mean, m.q2 AS median, m.std AS std,
              (SELECT count(*) FROM v WHERE m.n_ok >= 4 AND m.q3 > m.q1
                AND (x < m.q1 - 1.5 * (m.q3 - m.q1) OR x > m.q3 + 1.5 * (m.q3 - m.q1))) AS outliers"""
            source = f"""v AS (SELECT {value} AS x FROM {t}), m AS (
              SELECT count(x) AS n_ok, coalesce(skewness(x), 0) AS skew, min(x) AS lo, max(x) AS hi,
                avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q1,
                quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM v)"""
        else:
            measures = (f"s.filled AS n_ok, 0.0 AS skewness, {nothing} AS min_value, "
                        f"{nothing} AS max_value, {nothing} AS mean, {nothing} AS median, "
                        f"{nothing} AS std, 0 AS outliers")
            source = f"v AS (SELECT 1 AS x), m AS (SELECT 1 AS one)"
        low = f"lower({strip(c)})"
        yes = no = bad = "CAST(NULL AS BIGINT)"
        common, invalid = "CAST(NULL AS VARCHAR)", zero
        if kind == "boolean":
            yes = f"count(*) FILTER ({low} IN {TRUE})"
            no = f"count(*) FILTER ({low} IN {FALSE})"
            bad = f"count({c}) - {yes} - {no}"
            common = f"CASE WHEN {yes} >= {no} THEN 'true' ELSE 'false' END"
        elif kind in (None, "category", "text"):
            common = (f"(SELECT x FROM (SELECT {strip(c)} AS x, count(*) AS n FROM {t} "
                      f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, x LIMIT 1)")
        dates = f"count(*) FILTER ({c} IS NOT NULL AND {day(c)} IS NULL)" \
            if kind == "date" and storage == "string" else zero
        mails = f"count(*) FILTER ({c} IS NOT NULL AND NOT regexp_matches({low}, '{EMAIL}'))" \
            if kind == "email" else zero
        label = f"'{kind}'" if kind else content_type(c, t)
        if numeric:
            invalid = "s.filled - m.n_ok"
        elif kind == "boolean":
            invalid = "s.bad"
        parts.append(f"""SELECT * FROM (WITH s AS (
            SELECT count(*) AS total, count({c}) AS filled, count(DISTINCT {c}) AS uniq,
              {yes} AS yes, {no} AS no, {bad} AS bad, {common} AS common, {dates} AS dates,
              {mails} AS mails FROM {t}), {source}, x AS (SELECT *, {measures} FROM s, m)
          SELECT '{c}' AS column_name, {label} AS col_type, s.total AS total_rows,
            s.total - s.filled AS missing_count,
            round((s.total - s.filled) / s.total, 4) AS missing_rate, s.uniq AS unique_count,
            round(s.uniq / s.total, 4) AS unique_ratio,
            CAST({invalid} AS BIGINT) AS invalid_numeric_count,
            CAST(x.outliers AS BIGINT) AS outlier_count_iqr,
            s.dates AS invalid_date_count, s.mails AS invalid_email_count,
            CAST(x.skewness AS DOUBLE) AS skewness, round(x.min_value, 4) AS min_value,
            round(x.max_value, 4) AS max_value, round(x.mean, 4) AS mean,
            round(x.median, 4) AS median, round(x.std, 4) AS std, s.yes AS bool_true_count,
            s.no AS bool_false_count, s.bad AS bool_invalid_count, s.common AS most_common
          FROM s, m, x)""")
    return "\nUNION ALL ".join(parts)


def grouped_profile(name, columns, t, group):
    """Profile of every group of ``t`` and column; quartiles are cells of the group."""
    parts = []
    for c, kind, storage in columns:
        numeric = kind in ("numeric", "age", "score", "credit_score", "salary")
        value = "CAST(NULL AS DOUBLE)"
        if numeric:
            value = f2(c) if storage == "string" else f"CAST({c} AS DOUBLE)"
        low, zero, odd = f"lower({strip(c)})", "0", "0"
        if numeric:
            odd = "count(raw) - count(x)"
        elif kind == "boolean":
            odd = "count(raw) FILTER (fail)"
        fail = {"boolean": f"{low} NOT IN {TRUE} AND {low} NOT IN {FALSE}",
                "email": f"NOT regexp_matches({low}, '{EMAIL}')",
                "date": f"{day(c)} IS NULL" if storage == "string" else "false"}.get(kind, "false")
        label = f"'{kind}'" if kind else content_type(c, t)
        parts.append(f"""SELECT * FROM (WITH v AS (
            SELECT CAST({group} AS VARCHAR) AS g, {c} AS raw, {value} AS x, {fail} AS fail FROM {t}),
          m AS (SELECT g, count(*) AS total, count(raw) AS filled, count(DISTINCT raw) AS uniq, count(x) AS n,
            {odd} AS odd, count(raw) FILTER (fail) AS bad, skewness(x) AS skew,
            quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3 FROM v GROUP BY g),
          o AS (SELECT v.g, count(*) FILTER (n >= 4 AND q3 > q1 AND (x < q1 - 1.5 * (q3 - q1)
            OR x > q3 + 1.5 * (q3 - q1))) AS outliers FROM v JOIN m ON v.g IS NOT DISTINCT FROM m.g GROUP BY v.g)
          SELECT '{name}' AS table_name, m.g AS group_key, '{c}' AS column_name, {label} AS col_type,
            total AS total_rows, total - filled AS missing_count, round((total - filled) / total, 4) AS missing_rate,
            uniq AS unique_count, round(uniq / total, 4) AS unique_ratio, CAST(odd AS BIGINT) AS invalid_numeric_count,
            outliers AS outlier_count_iqr, CAST({"bad" if kind == "date" else "0"} AS BIGINT) AS invalid_date_count,
            CAST({"bad" if kind == "email" else "0"} AS BIGINT) AS invalid_email_count,
            CASE WHEN n >= 3 AND isfinite(skew) THEN round(skew, 4) ELSE 0.0 END AS skewness
          FROM m JOIN o ON m.g IS NOT DISTINCT FROM o.g)""")
    return "\nUNION ALL ".join(parts)


def rule(prefix=""):
    p = prefix
    return f"""CASE
      WHEN {p}invalid_numeric_count > 0 AND {p}col_type IN {NUMERIC_TYPES} THEN 'convert_and_flag'
      WHEN {p}invalid_date_count > 0 AND {p}col_type = 'date' THEN 'parse_and_flag'
      WHEN {p}invalid_email_count > 0 AND {p}col_type = 'email' THEN 'normalize_and_flag'
      WHEN {p}outlier_count_iqr > 0 AND {p}col_type IN {NUMERIC_TYPES} THEN 'flag_outliers'
      WHEN {p}missing_rate > 0 AND {p}col_type IN {NUMERIC_TYPES}
        THEN CASE WHEN abs({p}skewness) < 0.5 THEN 'impute_mean' ELSE 'impute_median' END
      WHEN {p}missing_rate > 0 AND {p}col_type IN ('text', 'category')
        THEN CASE WHEN {p}unique_ratio < 0.3 THEN 'fill_mode' ELSE 'fill_unknown' END
      WHEN {p}missing_rate > 0 AND {p}col_type = 'date' THEN 'date_manual_review'
      WHEN {p}missing_rate > 0 AND {p}col_type = 'email' THEN 'normalize_and_flag'
      ELSE 'no_change' END"""


def mode_of(c, t):
    return (f"(SELECT x FROM (SELECT {c} AS x, count(*) AS n FROM {t} WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, x LIMIT 1)")


def dominance(c, t):
    return (f"(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL "
            f"GROUP BY {c}))")


def refined(c, t, rule_expr):
    """Refined action of one dirty column, given its rule action."""
    if c == "full_name":
        s = strip(c)
        return (f"CASE WHEN (SELECT count(*) FROM {t} WHERE {s} <> {title(s)}) > 0 "
                f"THEN 'title_case' ELSE {rule_expr} END")
    if c == "is_active":
        return "'normalize_boolean'"
    if c == "annual_income":
        return (f"CASE WHEN (SELECT count(*) FROM {t} WHERE {num(c)} < 0) > 0 "
                f"THEN 'convert_and_flag' ELSE {rule_expr} END")
    bounds = {"credit_score": (300, 850), "loyalty_score": (0, 100), "age": (0, 120)}
    if c in bounds:
        lo, hi = bounds[c]
        value = num(c) if c == "age" else c
        settled = "('convert_and_flag')" if c == "age" else "('convert_and_flag', 'flag_outliers')"
        return (f"CASE WHEN {rule_expr} NOT IN {settled} AND (SELECT count(*) FROM {t} WHERE "
                f"{value} < {lo} OR {value} > {hi}) > 0 THEN 'convert_and_flag' "
                f"ELSE {rule_expr} END")
    if c in ("gender", "segment", "notes"):
        return (f"CASE WHEN {rule_expr} IN ('fill_mode', 'fill_unknown') THEN CASE WHEN "
                f"{dominance(c, t)} >= 0.3 THEN 'fill_mode' ELSE 'fill_unknown' END "
                f"ELSE {rule_expr} END")
    return rule_expr


def conversion(c, t):
    """CTE body: customer_id, raw, cleaned value ``x`` and ``note`` of one converted column."""
    storage = dict((n, k) for n, _, k in DIRTY_COLUMNS)[c]
    raw_text = storage == "string"
    value = money(c) if raw_text else f"CAST({c} AS DOUBLE)"
    if c == "age":
        value = f"coalesce({value}, {word(c)})"
    notes = [("v IS NULL AND raw IS NOT NULL", "'could not convert to numeric'")]
    kept = "v"
    if c == "age":
        notes += [("v < 0", "'negative age removed'"), ("v > 120", "'age > 120 flagged'")]
        kept = "CASE WHEN v >= 0 THEN v END"
    if c == "credit_score":
        notes += [("v < 300 OR v > 850", "'credit score out of 300-850 (FICO) range'")]
    if c == "loyalty_score":
        notes += [("v < 0 OR v > 100", "'score out of 0-100 range'")]
        kept = "CASE WHEN v BETWEEN 0 AND 100 THEN v END"
    upper, final = "max(CAST(NULL AS DOUBLE))", "k1"
    if c == "annual_income":
        notes += [("v < 0", "'negative value removed (impossible for this column)'"),
                  ("k1 > u.upper",
                   "concat('extreme outlier removed (> ', printf('%.0f', u.upper), ')')")]
        kept = "CASE WHEN v >= 0 THEN v END"
        upper = ("CASE WHEN count(k1) >= 4 AND quantile_cont(k1, 0.75) > quantile_cont(k1, 0.25) "
                 "THEN quantile_cont(k1, 0.75) + 3 * (quantile_cont(k1, 0.75) - "
                 "quantile_cont(k1, 0.25)) END")
        final = "CASE WHEN k1 > u.upper THEN NULL ELSE k1 END"
    plain = num("raw") if raw_text else "raw"
    note = ", ".join(
        f"CASE WHEN {cond} THEN concat('{c}: ', {words}) END" for cond, words in notes)
    return f"""(WITH a AS (SELECT customer_id, {c} AS raw, {value} AS v FROM {t}),
      b AS (SELECT *, {kept} AS k1 FROM a),
      u AS (SELECT {upper} AS upper FROM b),
      d AS (SELECT b.*, {final} AS k2, concat_ws('; ', {note}) AS note FROM b, u),
      f AS (SELECT CASE WHEN abs(CASE WHEN count(k2) >= 4 THEN coalesce(skewness(k2), 0) ELSE 0 END)
          < 0.5 THEN avg(k2) ELSE quantile_cont(k2, 0.5) END AS fill,
        bool_and(({plain}) % 1 = 0) FILTER (v IS NOT NULL AND ({plain}) IS NOT NULL) AS whole FROM d)
      SELECT customer_id, raw, CASE WHEN whole THEN round_even(coalesce(k2, fill), 0)
        ELSE round(coalesce(k2, fill), 4) END AS x, note FROM d, f)"""
