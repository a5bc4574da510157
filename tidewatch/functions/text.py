"""Command, call-note and account-name text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import _col

# Patterns, prefixes, labels and word lists that results depend on.
MANUAL_PATTERN = r"\bmanual\b"
UNKNOWN_COMMAND = "UNKNOWN_CMD"
COMMAND_GROUPS = [
    (r"^show run", "SHOW_CONFIG"),
    (r"^(conf t$|configure terminal$|conf )", "CONFIG_MODE"),
    (r"^(reload|reboot)", "RELOAD"),
    (r"^copy ", "COPY"),
]
USER_COMMAND_WORDS = r"add|delete|remove|username"
USER_COMMAND_GROUP = "USER_MGMT"
FUNCTIONAL_KEYWORDS = [
    "admin", "svc", "nso", "monitor", "report", "batch", "task", "job",
    "bot", "system", "api", "service", "auto", "deploy",
]
SHORT_NAME = 3
LONG_NAME = 10


def strip(c: Column | str) -> Column:
    """Drop all leading and trailing whitespace (``trim`` keeps tabs)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def is_manual(c: Column | str, pattern: str = MANUAL_PATTERN) -> Column:
    """Case-insensitive search for ``pattern``; null is no match."""
    return F.coalesce(_col(c).rlike("(?iU)" + pattern), F.lit(False))


def normalize_command(c: Column | str) -> Column:
    """Group label of a raw command: the first matching rule, else its first word."""
    text = F.lower(strip(_col(c).cast("string")))
    group = F.when(text.isNull() | (text == ""), UNKNOWN_COMMAND)
    for pattern, label in COMMAND_GROUPS:
        group = group.when(text.rlike(pattern), label)
    group = group.when(text.contains("user") & text.rlike(USER_COMMAND_WORDS), USER_COMMAND_GROUP)
    return group.otherwise(F.upper(F.split(text, r"(?U)\s+")[0]))


def likely_functional(c: Column | str, in_directory: Column) -> Column:
    """Whether an account name looks like a machine account.

    A name in the people directory never does. Otherwise any of: a keyword,
    a very short or long name, a separator, or mixed case not led by V.
    """
    name = strip(c)
    low = F.lower(name)
    mixed = (name != low) & (name != F.upper(name)) & name.rlike("[A-Z]")
    length = F.char_length(name)
    return (
        F.when(name.isNull() | (name == ""), False)
        .when(F.coalesce(in_directory, F.lit(False)), False)
        .when(low.rlike("|".join(FUNCTIONAL_KEYWORDS)), True)
        .when((length <= SHORT_NAME) | (length >= LONG_NAME), True)
        .when(name.rlike(r"[_\-.:]"), True)
        .when(mixed, ~F.upper(name).startswith("V"))
        .otherwise(False)
    )


def parse_allowlist(c: Column | str, is_text: bool) -> Column:
    """Allow list as an array; null or blank text means the list is unknown."""
    c = _col(c)
    if not is_text:
        return c.cast("array<string>")
    text = strip(c)
    parts = F.transform(F.split(text, ","), strip)
    return F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(parts)


def tokens(c: Column | str) -> Column:
    """Whitespace-separated words; an empty array for null or blank text."""
    text = strip(c)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
        F.split(text, r"(?U)\s+")
    )


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))
    )


def three_digits(c: Column | str) -> Column:
    """Text with three digits after the point, correctly rounded.

    ``format_string`` rounds the shortest decimal form of a double, which errs on
    near-ties such as 0.0375. Here the exact product by 1000 decides them: ``p``
    is the rounded product and ``error`` what it lost (values below 2**900).
    """
    c = _col(c).cast("double")
    p = c * F.lit(1000.0)
    high = c * F.lit(134217729.0) - (c * F.lit(134217729.0) - c)
    error = (high * F.lit(1000.0) - p) + (c - high) * F.lit(1000.0)
    tie = (p - F.floor(p)) == F.lit(0.5)
    thousandths = F.when(tie & (error != 0), F.floor(p) + (error > 0).cast("int")).otherwise(F.rint(p))
    return F.format_string("%.3f", thousandths / F.lit(1000.0))


def reason(name: str, over: float) -> Column:
    """``name=value`` with three digits when the column exceeds ``over``, else null."""
    c = F.col(name)
    return F.when(c > F.lit(over), F.concat(F.lit(f"{name}="), three_digits(c)))
