"""Spark-native data profiling, cleaning and insight."""

from .operators.charts import Chart, build_chart, chart_data, filter_rows
from .operators.compare import (
    change_log, change_totals, clean_by_position, compare, compare_by_position, missing_scorecard,
    positioned, problem_cells, raw_snapshot, report_tables, review_rows,
)
from .operators.explain import explain, insight_details
from .operators.groups import profile_groups
from .operators.insights import detect_insights
from .operators.profiling import profile, semantic_types, top_values
from .operators.stats import (
    analyze_column, analyze_table, correlations, dataset_summary, describe_categorical,
    describe_numeric, failing_columns, grouped, normality_ks,
)
from .plans.action_model import load_model, save_model, train_action_model, training_rows
from .plans.cleaning import CleaningPlan, clean
from .plans.decide import decide, predict
from .plans.domains import catalog_of, column_advice, detect_domains, predict_with_template
from .sources.tables import preflight, preview, read_csv, read_table, write_csv, write_tables
