"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import _col

# Drawing sizes that results depend on.
NODE_SIZE_MIN, NODE_SIZE_PER_DEGREE = 80.0, 12.0
EDGE_WIDTH_MIN, EDGE_WIDTH_POWER = 0.5, 0.8


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def cap_at_one(c: Column | str) -> Column:
    return F.least(_col(c), F.lit(1.0))


def purity(human: Column | str, functional: Column | str) -> Column:
    return F.greatest(_col(human), _col(functional))


def entropy_bits(weight: Column | str) -> Column:
    """Aggregate: Shannon entropy in bits of positive weights, one row each."""
    w = F.when(_col(weight) > 0, _col(weight).cast("double"))
    total = F.sum(w)
    bits = F.log2(total) - F.sum(w * F.log2(w)) / total
    return F.when(F.count(w) > 1, bits).otherwise(F.lit(0.0))


def normalised_entropy(weight: Column | str) -> Column:
    """Aggregate: entropy over the log of the number of positive weights."""
    n = F.count(F.when(_col(weight) > 0, 1))
    return F.when(n > 1, entropy_bits(weight) / F.log2(F.greatest(n, F.lit(2)).cast("double"))).otherwise(F.lit(0.0))


def node_size(degree: Column | str) -> Column:
    return F.greatest(F.lit(NODE_SIZE_MIN), F.lit(NODE_SIZE_PER_DEGREE) * _col(degree))


def edge_width(weight: Column | str) -> Column:
    return F.greatest(F.lit(EDGE_WIDTH_MIN), F.pow(_col(weight).cast("double"), F.lit(EDGE_WIDTH_POWER)))
