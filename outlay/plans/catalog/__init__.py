"""The query catalog, one module per area."""

from outlay.plans.catalog import audit, extraction, fraud, matching, ml, reports, streaming, transactions  # noqa: F401
