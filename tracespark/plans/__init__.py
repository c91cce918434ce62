"""Queries on the driver tables, each with the SQL that gives the same rows."""

from tracespark.plans import behaviours, kernels, places, pools, signals, timejoins  # noqa: F401
from tracespark.plans.bindings import QUERIES, SQL
from tracespark.plans.flagship import EVENT_RESPONSE_SQL, event_response

QUERIES["event_response"] = event_response
SQL["event_response"] = EVENT_RESPONSE_SQL
