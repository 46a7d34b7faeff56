"""Cleaning as fit and transform.

``fit`` measures every column together and turns each chosen action into one
column expression with its fill values and bounds as literals. ``transform`` is a
single ``select``: no shuffle, no row order, and it also runs on a stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import exprs as X, fixed
from ..operators.melt import by_column, wide
from ..operators.profiling import (
    PROFILE_SCHEMA, date_orders, fences, moments, named, profile, rows_to_df, sample_skewness,
)
from ..operators.quantiles import exact_quantiles
from ..sources.staging import release, stage
from ..sources.tables import blanks_to_null, check_columns, distinct_rows, drop_empty, sanitise
from .decide import decide

FLAGGING = (
    "convert_and_flag", "parse_and_flag", "normalize_and_flag", "normalize_boolean", "flag_outliers",
)


@dataclass
class ColumnPlan:
    """What happens to one column."""

    name: str
    kind: str
    decision: dict
    cell: Column                                    # cleaned value
    parsed: Column | None = None                    # parsed cell, projected ahead of the rest
    notes: list[tuple[Column, str]] = field(default_factory=list)
    changed: Column | None = None                   # cell counted as changed
    details: dict = field(default_factory=dict)

    @property
    def parsed_name(self) -> str:
        return parsed_name(self.name)

    @property
    def flagged(self) -> Column:
        return X.any_of(F.coalesce(condition, F.lit(False)) for condition, _ in self.notes)


class CleaningPlan:
    """Fitted cleaning of one table."""

    def __init__(self, columns: list[ColumnPlan], source: DataFrame, rows: dict):
        self.columns = {c.name: c for c in columns}
        self.source = source
        self.rows = rows

    # -- fitting -------------------------------------------------------------

    @classmethod
    def fit(cls, df: DataFrame, columns=None, overrides=None, threshold: float = 0.65,
            skip_ids: bool = True, model=None, preflighted: bool = False) -> "CleaningPlan":
        """Choose and measure an action per column.

        ``overrides`` maps a column to an action. The table is deduplicated and
        blank cells are nulled first, once, into the shared staging folder;
        ``preflighted`` tells that this has been done or is not wanted; NaN and infinities are
        missing in either case.
        """
        overrides = dict(overrides or {})
        wanted = [c for c in (columns or df.columns) if c in df.columns]
        if preflighted:
            source, rows = sanitise(df), {}
        else:
            staged = stage(blanks_to_null(distinct_rows(df)), "preflight")
            source = drop_empty(staged)
            source.staged_at = staged.staged_at
            rows = _row_counts(df, staged, source)
        of_kind = X.kinds(source)
        wanted = [c for c in wanted if of_kind[c] != "nested"]
        profiled = profile(source, wanted, evidence=any(c not in overrides for c in wanted))
        decisions = [
            r.asDict(recursive=True)
            for r in decide(profiled, model, threshold).orderBy("position").collect()
        ]
        for d in decisions:
            if skip_ids and d["col_type"] == "id" and d["column_name"] not in overrides:
                d |= {"action": "skipped", "method": "skip_id", "confidence": 1.0,
                      "predicted_action": None, "rule_action": None, "refined": False,
                      "reason": "", "probabilities": {}}
            elif d["column_name"] in overrides:
                d |= {"action": overrides[d["column_name"]], "method": "override",
                      "refined": False, "reason": "manual override"}
        return cls(_column_plans(source, of_kind, decisions), source, rows)

    @classmethod
    def fit_column(cls, df: DataFrame, column: str, action: str | None = None, **options):
        """One column, without deduplication and without the id rule."""
        check_columns(df, [column])
        overrides = {column: action} if action else None
        return cls.fit(df, [column], overrides, skip_ids=False, preflighted=True, **options)

    # -- use -----------------------------------------------------------------

    def transform(self, df: DataFrame) -> DataFrame:
        """Cleaned columns, with ``review_required`` and ``review_notes`` if any action flags.

        Cells are parsed in a first projection, so that value, notes and bounds all use
        the result of one parse.
        """
        cells = [
            self.columns[c].cell.alias(c) if c in self.columns else X.ref(c) for c in df.columns
        ]
        if any(p.decision["action"] in FLAGGING for p in self.columns.values()):
            notes = self.review_notes()
            cells += [
                (notes != "").alias("review_required"), notes.alias("review_notes"),
            ]
        return self.with_parsed(sanitise(df)).select(*cells)

    def with_parsed(self, df: DataFrame) -> DataFrame:
        parsed = {p.parsed_name: p.parsed for p in self.columns.values() if p.parsed is not None}
        return df.withColumns(parsed) if parsed else df

    def review_notes(self) -> Column:
        notes = [
            F.when(condition, F.lit(f"{plan.name}: {words}"))
            for plan in self.columns.values() for condition, words in plan.notes
        ]
        # Absent notes are null and left out, so no note starts with a separator.
        return F.concat_ws("; ", *notes)

    def cleaned(self) -> DataFrame:
        return self.transform(self.source)

    def release(self) -> None:
        """Remove the staged copy of the table, after the last use of the plan's own results."""
        if hasattr(self.source, "staged_at"):
            release(self.source)

    def changes(self, key: str, columns=None) -> DataFrame:
        """Cell-level change log without a join: raw and cleaned come from the same row."""
        from ..operators.compare import change_rows

        names = [c for c in (columns or self.source.columns) if c != key]
        pairs = {
            c: (X.ref(c), self.columns[c].cell if c in self.columns else X.ref(c)) for c in names
        }
        return change_rows(self.with_parsed(self.source), X.ref(key).alias(key), pairs)

    def counters(self) -> dict[str, tuple[int, int]]:
        """Cells changed and flagged per column, one pass."""
        metrics = {}
        for name, plan in self.columns.items():
            if plan.changed is not None:
                metrics[name, "changed"] = F.count_if(plan.changed)
            if plan.notes:
                metrics[name, "flagged"] = F.count_if(plan.flagged)
        found = wide(self.with_parsed(self.source), metrics, 60) if metrics else {}
        return {
            n: (found.get((n, "changed"), 0), found.get((n, "flagged"), 0)) for n in self.columns
        }

    def report(self) -> DataFrame:
        """One row per column: decision, counters, details."""
        counts = self.counters()
        rows = []
        for name, plan in self.columns.items():
            d = plan.decision
            rows.append({f: d.get(f) for f in REPORT_SCHEMA.names} | {
                "cells_changed": counts[name][0], "cells_flagged": counts[name][1],
                "details": {k: str(v) for k, v in plan.details.items()},
                "probabilities": json.dumps(d.get("probabilities") or {}, sort_keys=True),
            })
        return rows_to_df(self.source.sparkSession, rows, REPORT_SCHEMA)

    def summary(self) -> DataFrame:
        """One row of run counters."""
        counts = self.counters()
        plans = [p.decision for p in self.columns.values()]
        row = {
            "columns_processed": len(plans),
            "columns_skipped": sum(d["action"] == "skipped" for d in plans),
            "total_cells_changed": sum(c for c, _ in counts.values()),
            "total_cells_flagged": sum(f for _, f in counts.values()),
            "rows_before": self.rows.get("before"), "rows_after": self.rows.get("after"),
            "duplicate_rows_dropped": self.rows.get("duplicates"),
            "empty_rows_dropped": self.rows.get("empty"),
            "ml_used_count": sum(d["method"] == "ml" for d in plans),
            "rule_used_count": sum(
                d["method"] in ("rule_based", "fallback_low_confidence") for d in plans),
        }
        return rows_to_df(self.source.sparkSession, [row], SUMMARY_SCHEMA)


_L, _S = T.LongType(), T.StringType()
SUMMARY_SCHEMA = T.StructType([T.StructField(n, _L) for n in (
    "columns_processed", "columns_skipped", "total_cells_changed", "total_cells_flagged",
    "rows_before", "rows_after", "duplicate_rows_dropped", "empty_rows_dropped",
    "ml_used_count", "rule_used_count")])
REPORT_SCHEMA = T.StructType(
    [PROFILE_SCHEMA[n] for n in ("column_name", "position", "col_type")]
    + [T.StructField(n, _S) for n in ("action", "predicted_action", "rule_action", "method")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("refined", T.BooleanType()),
       T.StructField("reason", _S), T.StructField("cells_changed", _L),
       T.StructField("cells_flagged", _L), T.StructField("probabilities", _S),
       T.StructField("details", T.MapType(_S, _S))]
)


def clean(df: DataFrame, columns=None, **options):
    """Fit and apply: the cleaned table and its plan."""
    plan = CleaningPlan.fit(df, columns, **options)
    return plan.cleaned(), plan


def _row_counts(df: DataFrame, distinct: DataFrame, source: DataFrame) -> dict:
    """Rows before and after, split into dropped duplicates and dropped empty rows."""
    before, unique, after = df.count(), distinct.count(), source.count()
    return {"before": before, "after": after, "duplicates": before - unique,
            "empty": unique - after}


# -- per-action fitting --------------------------------------------------------


def parsed_name(column: str) -> str:
    return f"__parsed_{column}"


def _parser(action: str, name: str, raw: Column, kind: str, day_first: bool = True) -> Column | None:
    """The parse an action rests on."""
    if action in ("impute_mean", "impute_median", "flag_outliers"):
        return X.to_money(raw, kind)
    if action == "convert_and_flag":
        value = X.to_money(raw, kind)
        if named(fixed.WORD_NUMBER_NAME, name) and kind != "number":
            value = F.coalesce(value, X.word_to_number(X.text(raw)))
        return value
    if action == "parse_and_flag":
        return X.to_datetime(raw, kind, day_first)
    if action == "normalize_and_flag":
        return X.normalize_email(raw)
    if action == "normalize_boolean":
        return X.to_bit(raw)
    if action == "title_case":
        return X.title_cell(raw)
    return None


def _column_plans(source, of_kind, decisions) -> list[ColumnPlan]:
    """Measure everything the chosen actions need, all columns and actions per pass."""
    chosen = {d["column_name"]: d["action"] for d in decisions}
    with_action = lambda *actions: [c for c, a in chosen.items() if a in actions]
    orders = date_orders(source, [c for c in with_action("parse_and_flag") if of_kind[c] == "string"])
    parsers = {c: _parser(a, c.lower(), X.ref(c), of_kind[c], orders.get(c)) for c, a in chosen.items()}
    parsers = {c: p for c, p in parsers.items() if p is not None}
    work = source.withColumns({parsed_name(c): p for c, p in parsers.items()}) if parsers else source
    parsed = {c: X.ref(parsed_name(c)) for c in parsers}

    imputed = with_action("impute_mean", "impute_median")
    fenced = with_action("flag_outliers")
    fixes = _conversion_steps(work, {c: parsed[c] for c in with_action("convert_and_flag")})
    values = {c: parsed[c] for c in imputed + fenced} | {c: s["kept"] for c, s in fixes.items()}
    # Whether plainly parsed numbers are whole, and the share of ones among booleans.
    extra = {(c, "plain"): X.to_number(X.ref(c), of_kind[c]) for c in imputed}
    extra |= {
        (c, "plain"): F.when(parsed[c].isNotNull(), X.to_number(X.ref(c), of_kind[c]))
        for c in fixes
    }
    extra |= {(c, "bit"): parsed[c].cast("double") for c in with_action("normalize_boolean")}
    shape = moments(work, values | extra)
    skew = {
        c: sample_skewness(shape[c]["skew"], shape[c]["n"]) if shape[c]["n"] >= 4 else 0.0
        for c in fixes
    }
    ranked = fenced + with_action("impute_median") + [c for c in fixes if abs(skew[c]) >= 0.5]
    counts = {c: shape[c]["n"] for c in ranked}
    quartiles = exact_quantiles(work, {c: values[c] for c in ranked}, counts=counts)
    bounds = fences({c: quartiles[c] for c in fenced}, counts)
    median = {c: q[1] if q else None for c, q in quartiles.items()}
    whole = {c: bool(shape[c, "plain"]["whole"]) for c in imputed + list(fixes)}
    for c, s in fixes.items():
        s["method"] = "median" if c in median else "mean"
        s["fill"] = median[c] if c in median else shape[c]["mean"]
        s["whole"], s["filled"] = whole[c], shape[c]["n"]

    out = []
    for d in decisions:
        c = d["column_name"]
        raw, action, cell = X.ref(c), chosen[c], parsed.get(c)
        plan = ColumnPlan(c, of_kind[c], d, raw, parsers.get(c))
        if action in ("impute_mean", "impute_median"):
            fill = shape[c]["mean"] if action == "impute_mean" else median[c]
            plan.cell = F.coalesce(cell, F.lit(fill).cast("double"))
            plan.details["fill_value"] = None if fill is None else round(fill, 4)
            if whole[c] and fill is not None:
                plan.cell = F.bround(plan.cell).cast("bigint")
                plan.details["fill_value"] = round(fill)
            plan.changed = raw.isNull()
        elif action == "convert_and_flag":
            _apply_conversion(plan, raw, fixes[c])
        elif action == "parse_and_flag":
            plan.cell = X.iso_date(cell)
            plan.notes = [(cell.isNull() & raw.isNotNull(), "unparseable date")]
            plan.details |= {"day_first": orders[c]} if c in orders else {}
            plan.changed = cell.isNotNull()
        elif action == "normalize_and_flag":
            valid = F.coalesce(X.is_email(cell), F.lit(False))
            plan.cell = F.when(valid, cell)
            plan.notes = [(~valid & raw.isNotNull(), "invalid email")]
            plan.changed = valid
        elif action == "flag_outliers" and c in bounds:
            lo, hi = bounds[c]
            plan.notes = [((cell < lo) | (cell > hi),
                           f"IQR outlier [bounds {lo:.2f}–{hi:.2f}]")]
            plan.details |= {"iqr_lower": round(lo, 4), "iqr_upper": round(hi, 4)}
        elif action == "fill_mode":
            mode = d["mode_text"]
            data_type = "string" if mode is None else source.schema[c].dataType
            fill = F.lit("Unknown" if mode is None else mode).cast(data_type)
            plan.cell = F.coalesce(raw.cast(data_type), fill)
            plan.changed = raw.isNull()
            plan.details["fill_value"] = mode if mode is not None else "Unknown"
        elif action == "fill_unknown":
            plan.cell = F.when(raw.isNull() | (X.text(raw) == "nan"), "Unknown").otherwise(X.text(raw))
            plan.changed = raw.isNull()
            plan.details["fill_value"] = "Unknown"
        elif action == "normalize_boolean":
            mode = int((shape[c, "bit"]["mean"] or 0.0) > 0.5)
            plan.cell = F.coalesce(cell, F.lit(mode)).cast("bigint")
            plan.notes = [(cell.isNull() & raw.isNotNull(), "unrecognised boolean value")]
            plan.changed = cell.isNotNull()
            plan.details |= {"fill_value": mode, "null_filled": d["missing_count"]}
        elif action == "title_case":
            plan.cell = cell
            plan.changed = X.strip(X.text(raw)) != X.strip(cell)
        elif action not in fixed.ACTIONS and action != "skipped":
            plan.details["warning"] = f"Unknown action '{action}', no change applied"
        out.append(plan)
    return out


def _conversion_steps(work, parsed: dict[str, Column]) -> dict[str, dict]:
    """Number conversion up to the fill: range rules, then extremes.

    Extremes are judged on the values the range rules keep, the fill value on those
    the extremes leave.
    """
    steps = {}
    for c, value in parsed.items():
        name = c.lower()
        invalid = value.isNull() & X.ref(c).isNotNull()
        notes, kept = [(invalid, "could not convert to numeric")], value
        if named(fixed.CONVERT_AGE_NAME, name):
            notes.append((value < 0, "negative age removed"))
            notes.append((value > 120, "age > 120 flagged"))
            kept = F.when(value >= 0, kept)
        if named(fixed.CREDIT_NAME, name):
            notes.append(((kept < 300) | (kept > 850), "credit score out of 300-850 (FICO) range"))
        elif named(fixed.CONVERT_SCORE_NAME, name):
            notes.append(((kept < 0) | (kept > 100), "score out of 0-100 range"))
            kept = F.when(kept.between(0, 100), kept)
        money = named(fixed.MONEY_NAME, name)
        if money:
            notes.append((value < 0, "negative value removed (impossible for this column)"))
            kept = F.when(value >= 0, kept)
        steps[c] = {"kept": kept, "notes": notes, "invalid": invalid, "money": money}

    money = {c: s["kept"] for c, s in steps.items() if s["money"]}
    counts = {c: m.get("n", 0) for c, m in by_column(work, money, n=F.count("v")).items()}
    quartiles = exact_quantiles(work, money, (0.25, 0.75), counts)
    for c, (_, upper) in fences(quartiles, counts, 3.0).items():
        kept = steps[c]["kept"]
        steps[c]["notes"].append((kept > upper, f"extreme outlier removed (> {upper:.0f})"))
        steps[c]["kept"] = F.when(kept <= upper, kept)
    return steps


def _apply_conversion(plan: ColumnPlan, raw: Column, s: dict) -> None:
    plan.cell = F.coalesce(s["kept"], F.lit(s["fill"]).cast("double"))
    if s["whole"] and s["fill"] is not None:
        plan.cell = F.bround(plan.cell).cast("bigint")
    plan.notes = s["notes"]
    plan.changed = s["invalid"]
    empty = plan.decision["total_rows"] - s["filled"]
    if empty and s["fill"] is not None:
        plan.details |= {"imputed_nulls": empty, "impute_method": s["method"],
                         "impute_fill_value": round(s["fill"], 4)}
