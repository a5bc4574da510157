"""Table schemas and the required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

CALLS = "user STRING, account STRING, id_chat STRING, dttm TIMESTAMP_NTZ"

UNIFIED = (
    "user STRING, metric_name STRING, metric_value DOUBLE, index_value INT, "
    "week_start_date DATE, date DATE, n_weeks INT"
)
UNIFIED_COLUMNS = [
    "user", "metric_name", "metric_value", "index_value",
    "week_start_date", "date", "n_weeks",
]

REPORT_COLUMNS = [
    "dttm", "user", "account", "id_chat", "date", "dept_fctn_id", "dept_fctn_desc",
    "emp_status_ind", "user_comm_id", "job_desc", "job_cd", "iso_country_cd",
    "num_of_unique_suspicious_accounts",
]

ACCESS_BASELINE = "user STRING, kind STRING, v1 STRING, v2 STRING, as_of DATE"

GRAPH_FEATURE_COLUMNS = [
    "user", "event_date", "entropy", "degree", "clustering_coefficient",
]
RULE_COLUMNS = [
    "user", "rule_id", "any_remote", "any_device", "any_command",
    "allowed_remote_ips", "allowed_device_ips", "allowed_commands",
]


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise ValueError naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df
