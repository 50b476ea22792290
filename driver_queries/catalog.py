"""Imports every query module, which registers its queries."""

from driver_queries import (  # noqa: F401
    cohort_tables,
    evaluation,
    harmonisation,
    modelling,
    neighbours,
    reports,
    study_flow,
    survival,
    trajectories,
)
from driver_queries.registry import ITEMS, ORACLES, QUERIES  # noqa: F401
