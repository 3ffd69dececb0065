"""All queries of the panel engine and their DuckDB SQL."""

from panelcast.plans import asof_queries, detector_queries, feature_queries, fold_queries, forecast_queries, matching_queries, news_queries, queries, smoothing_queries, spatial_queries  # noqa: F401  each registers its own
from panelcast.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
