"""Registered queries over the given tables, each with its SQL equivalent."""

from obsframe.plans.catalog import ORACLES, QUERIES
from obsframe.plans import (  # noqa: F401  (registration)
    controls,
    features,
    observations,
    rankings,
    sequential,
    series,
    statistics,
    training,
)

__all__ = ["ORACLES", "QUERIES"]
