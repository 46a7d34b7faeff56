"""Cell-level column expressions. Everything here stays inside Catalyst.

``kind`` is the storage kind of a column: ``number``, ``boolean``, ``datetime``,
``string`` or ``nested``. Typed columns skip the text route.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from . import fixed

_SPACES = " \t\n\r\f\v"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "nested"


def kinds(df) -> dict[str, str]:
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def ref(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def lower_strip(c: Column) -> Column:
    return F.lower(strip(text(c)))


def finite(c: Column) -> Column:
    """NaN and the infinities count as missing numbers."""
    value = c.cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def parse_number(s: Column) -> Column:
    """Text to number; anything but a plain decimal literal gives null.

    The pattern runs first because a failed cast is many times dearer than a test.
    """
    return finite(F.when(s.rlike(fixed.NUMBER), s.try_cast("double")))


def to_number(c: Column, kind: str) -> Column:
    if kind == "number":
        return finite(c)
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind == "datetime":
        return F.lit(None).cast("double")
    return parse_number(text(c))


def strip_symbols(s: Column) -> Column:
    return F.translate(s, "£$€," + _SPACES, "")


def to_profile_number(c: Column, kind: str) -> Column:
    """Number after dropping currency signs, commas, blanks and currency codes."""
    if kind == "number":
        return finite(c)
    return parse_number(F.regexp_replace(strip_symbols(text(c)), "(?i)gbp|usd|eur", ""))


def strip_currency(s: Column) -> Column:
    return strip(F.regexp_replace(F.translate(s, "£$€,", ""), "(?i)gbp|usd|eur|inr", ""))


def to_money(c: Column, kind: str) -> Column:
    """Number after dropping currency signs and codes and thousands commas."""
    if kind == "number":
        return finite(c)
    return parse_number(strip_currency(text(c)))


def word_to_number(s: Column) -> Column:
    """Spelled-out number, else the first number inside the text."""
    words = strip(F.regexp_replace(F.lower(strip(s)), r"[-_\s]+", " "))
    pairs = ", ".join(f"'{word}', {value}D" for word, value in fixed.WORD_NUMBERS.items())
    table = F.expr(f"map({pairs})")
    first = F.regexp_extract(words, r"(\d+\.?\d*)", 1)
    return F.coalesce(F.try_element_at(table, words), first.try_cast("double"))


def to_datetime(c: Column, kind: str, day_first: bool | None = None) -> Column:
    """Timestamp without zone. Text is matched against the known formats in order.

    With ``day_first``, cells in none of them are inferred, that order being tried first where numbers
    leave it open; ``date_orders`` tells for a column. The shape test runs before the parser, so
    free text costs one length test and no failed parses.
    """
    if kind == "datetime":
        return c.cast("timestamp_ntz")
    s = strip(text(c))
    known = F.when(F.length(s) >= 6, known_datetime(s))
    if day_first is None:
        return known
    inferred = _inferred(s, lambda n: F.coalesce(*[_from_numbers(n, order) for order in (day_first, not day_first)]))
    return F.coalesce(known, F.when(may_be_inferred(s), inferred))


# Covers the shapes of DATE_FORMATS and ISO_DATETIME, those that begin alike taken together.
_KNOWN = (r"^(?:\d{4}(?:-\d{1,2}-\d{1,2}(?:$|[T ]\d{1,2}:\d{2})|/\d{1,2}/\d{1,2}$|\d{4}$)"
          r"|\d{1,2}(?:[-/]\d{1,2}[-/](?:\d{4}|\d{2})|\.\d{1,2}\.\d{4}| [A-Za-z]+ \d{4})$|[A-Za-z]+ \d{1,2},? \d{4}$)")


def known_datetime(s: Column) -> Column:
    """Text in one of the known formats or an ISO date-time. One pattern that covers all shapes goes
    first, so that other text is not tested for each of them."""
    parsed = [_shaped(s, shape, pattern) for shape, pattern in fixed.DATE_FORMATS]
    return F.when(s.rlike(_KNOWN), F.coalesce(
        *parsed, F.when(s.rlike(fixed.ISO_DATETIME), s.try_cast("timestamp_ntz"))))


def may_be_inferred(s: Column) -> Column:
    """Three short parts of letters or digits, the last one beginning with a digit: no date lacks this."""
    return F.length(s).between(6, 60) & s.rlike(
        r"(?i)^(?:[a-z]{3,9}+[.,]*+\s++)?[a-z0-9]{1,9}+[./,\s-]++[a-z0-9]{1,9}+[./,\s-]++\d")


_CLOCK = (r"(?:(?:T|[\s,]+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([ap]m)?"
          r"\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?)?$")
_MONTH = r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6})\.?"
_GAP = r"[./,\s-]+"
# Shape, then its groups in the order year, month, day; the first shape leaves day and month open.
_INFERRED = (
    (rf"(?i)^(\d{{1,2}})[./\s-](\d{{1,2}})[./\s-](\d{{4}}|\d{{2}}){_CLOCK}", "$3|$2|$1|open"),
    (rf"(?i)^(\d{{4}})[./\s-](\d{{1,2}})[./\s-](\d{{1,2}}){_CLOCK}", "$1|$2|$3|"),
    (rf"(?i)^(\d{{1,2}}){_GAP}{_MONTH}{_GAP}(\d{{4}}|\d{{2}}){_CLOCK}", "$3|$2|$1|"),
    (rf"(?i)^{_MONTH}{_GAP}(\d{{1,2}}){_GAP}(\d{{4}}){_CLOCK}", "$3|$1|$2|"),
)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _inferred(s: Column, use) -> Column:
    """``use(numbers)`` for dates beyond the known formats: other separators, named weekdays and months,
    ordinals, a time of day. Zones are read over: the local time stays. A cell is taken apart once, for
    whatever orders of day and month are asked for."""
    t = F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\s+", "")
    t = F.regexp_replace(t, r"(?i)^([a-z.]*\s*\d{1,2})(?:st|nd|rd|th)\b", "$1")
    parts = lambda t: F.split(F.coalesce(*[
        F.when(t.rlike(shape), F.regexp_replace(t, shape, f"{date}|$4|$5|$6|$7")) for shape, date in _INFERRED]), r"\|")
    return _let(t, lambda t: _let(parts(t), lambda p: _let(_numbers(p), use)))


def _whole(digits: Column) -> Column:
    """Digits as a number, none as 0. Empty text never reaches the cast: a failed one is many times dearer."""
    return F.when(F.length(digits) > 0, digits.cast("int")).otherwise(0)


def _numbers(p: Column) -> Column:
    """Year, month, day, 1 where day and month are open, hour, minute, second and hours to add, as numbers;
    null without parts."""
    year, month = F.get(p, 0), F.get(p, 1)
    century = F.when(F.length(year) > 2, 0).when(year < "69", 2000).otherwise(1900)
    name = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(month, 1, 3)))
    number = F.when(month < ":", month.cast("int")).otherwise(((name + 2) / 3).cast("int"))
    hour, half = _whole(F.get(p, 4)), F.lower(F.get(p, 7))
    shift = F.when((half == "pm") & (hour < 12), 12).when((half == "am") & (hour == 12), -12).otherwise(0)
    return F.when(p.isNotNull(), F.array(
        century + _whole(year), number, _whole(F.get(p, 2)), F.length(F.get(p, 3)), hour, _whole(F.get(p, 5)),
        _whole(F.get(p, 6)), shift))


def _date_of(n: Column, day_first: bool) -> Column:
    """The date in the numbers of a cell, where the calendar has it; nothing is parsed that could fail."""
    year, month, day, open_ = (F.get(n, i) for i in range(4))
    if not day_first:
        month, day = F.when(open_ > 0, day).otherwise(month), F.when(open_ > 0, month).otherwise(day)
    first = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when((day >= 1) & (day <= F.day(F.last_day(first))), F.date_add(first, day - 1))


def _on_clock(n: Column) -> Column:
    return (F.get(n, 4) < 24) & (F.get(n, 5) < 60) & (F.get(n, 6) < 60)


def _from_numbers(n: Column, day_first: bool) -> Column:
    clock = F.make_dt_interval(F.lit(0), F.get(n, 4) + F.get(n, 7), F.get(n, 5), F.get(n, 6))
    return F.when(_on_clock(n), _date_of(n, day_first).cast("timestamp_ntz") + clock)


def order_votes(s: Column) -> Column:
    """1 for a cell that only inference can read and only with the day first, -1 if only with the month
    first, 0 if either way; null for other cells."""
    def vote(n):
        day, month = (_date_of(n, order).isNotNull() for order in (True, False))
        return F.when(_on_clock(n), F.when(day & month, 0).when(day, 1).when(month, -1))
    return F.when(may_be_inferred(s) & known_datetime(s).isNull(), _inferred(s, vote))


def _shaped(s: Column, shape: str, pattern: str) -> Column:
    day = F.when(s.rlike(shape), F.try_to_date(s, pattern))
    if pattern.endswith("yy") and not pattern.endswith("yyyy"):
        # Two-digit years from 69 on belong to the 1900s.
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day.cast("timestamp_ntz")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_number(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")


def has_date_shape(s: Column, shapes) -> Column:
    """Every date shape takes 8 characters or more, so short text needs no pattern."""
    return (F.length(s) >= 8) & s.rlike("|".join(f"(?:{p})" for p in shapes))


def normalize_email(c: Column) -> Column:
    bare = F.replace(F.lower(strip(text(c))), F.lit(" "), F.lit(""))
    return F.regexp_replace(bare, r"\.+$", "")


def is_email(s: Column) -> Column:
    return F.contains(s, F.lit("@")) & s.rlike(fixed.EMAIL)


def truth_token(c: Column) -> Column:
    """Lower-case boolean spelling; whole numbers lose their decimal part."""
    s = F.lower(strip(text(c)))
    number = parse_number(s)
    return (
        F.when((number == 1) | (number == 0), number.cast("int").cast("string")).otherwise(s)
    )


def to_bit(c: Column) -> Column:
    token = truth_token(c)
    return F.when(token.isin(*fixed.TRUE_TOKENS), 1).when(token.isin(*fixed.FALSE_TOKENS), 0)


def title_case(s: Column) -> Column:
    """Capital after every non-letter, as in ``O'Neil``; other letters lower."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    capital = F.transform(
        runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), run.substr(F.lit(2), F.length(run)))
    )
    return F.array_join(capital, "")


def title_cell(c: Column) -> Column:
    s = strip(text(c))
    return F.when(s == "", text(c)).otherwise(title_case(s))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def cell_class(c: Column) -> Column:
    """Raw-cell problem class: ``missing``, ``invalid`` or empty."""
    return (
        F.when(c.isNull(), "missing")
        .when(F.lower(strip(text(c))).isin(*fixed.BAD_TOKENS), "invalid")
        .otherwise("")
    )


def json_safe(c: Column) -> Column:
    """NaN and infinities to null, for metric output."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds(data_type: T.DataType, wanted) -> bool:
    """Whether a type is, or has somewhere inside, one of the wanted types."""
    if isinstance(data_type, wanted):
        return True
    if isinstance(data_type, T.StructType):
        return any(holds(f.dataType, wanted) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return holds(data_type.elementType, wanted)
    return isinstance(data_type, T.MapType) and (holds(data_type.keyType, wanted) or holds(data_type.valueType, wanted))


def _inside(c: Column, data_type: T.DataType, wanted, change) -> Column:
    """``change`` applied to every part of a cell whose type is wanted; the cell's shape stays."""
    if isinstance(data_type, wanted):
        return change(c, data_type)
    if not holds(data_type, wanted):
        return c
    if isinstance(data_type, T.StructType):
        parts = [_inside(c.getField(f.name), f.dataType, wanted, change).alias(f.name) for f in data_type.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: _inside(x, data_type.elementType, wanted, change))
    # Keys identify the entries of a map and stay as they are.
    return F.transform_values(c, lambda _, v: _inside(v, data_type.valueType, wanted, change))


def finite_cell(c: Column, data_type: T.DataType) -> Column:
    """NaN and infinities to null in a cell of any type, nested ones included."""
    return _inside(c, data_type, (T.DoubleType, T.FloatType), lambda x, _: json_safe(x))


def canonical(c: Column, data_type: T.DataType) -> Column:
    """A cell of any type with maps as sorted arrays of their entries, so that equal cells are equal."""
    def entries(x, map_type):
        pair = lambda e: F.struct(
            canonical(e.getField("key"), map_type.keyType).alias("key"),
            canonical(e.getField("value"), map_type.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(x), pair))
    return _inside(c, data_type, T.MapType, entries)
