"""All registered queries."""

from foliospark.plans import board_queries, box_queries, grouping_queries, route_queries, series_queries, session_queries  # noqa: F401
from foliospark.plans.registry import QUERIES  # noqa: F401
