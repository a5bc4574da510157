"""Column-to-column functions; all are built-in Spark expressions."""

from .scores import (
    cap_at_one, edge_width, entropy_bits, node_size, normalised_entropy, purity,
    ratio_or_zero,
)
from .text import (
    edit_similarity, is_manual, likely_functional, normalize_command, parse_allowlist,
    reason, strip, three_digits, tokens,
)
from .times import (
    TIME_FORMATS, day, grid_day, grid_hour, hour_of_week, parse_ts, stringify_ts, unreadable_times, week_start,
)

__all__ = [
    "TIME_FORMATS",
    "cap_at_one", "day", "edge_width", "edit_similarity", "entropy_bits", "grid_day",
    "grid_hour", "hour_of_week", "is_manual", "likely_functional", "node_size",
    "normalised_entropy", "normalize_command", "parse_allowlist", "parse_ts", "purity", "unreadable_times",
    "ratio_or_zero", "reason", "stringify_ts", "strip", "three_digits", "tokens", "week_start",
]
