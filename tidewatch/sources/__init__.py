"""Readers and writers."""

from .files import (
    file_order, load_baseline, load_ids, load_models, load_report, load_unified,
    read_calls_csv, read_calls_folder, read_table, save_baseline, save_models, save_unified,
)
from .jdbc import list_tables_catalog, list_tables_jdbc, read_jdbc, write_jdbc

__all__ = [
    "file_order", "list_tables_catalog", "list_tables_jdbc", "load_baseline", "load_ids",
    "load_models", "load_report", "load_unified", "read_calls_csv", "read_calls_folder",
    "read_jdbc", "read_table", "save_baseline", "save_models", "save_unified", "write_jdbc",
]
