"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .operators import alignment, annotation, audits, banks, dedup, design, domains, family_profiles, feature_gates, gates, identity, intervals, joins, language_models, model_inputs, neighbours, prepare, profiles, reports, sampling, scalars, similarity  # noqa: F401  importing a module registers its queries
from .streaming import ledger  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
