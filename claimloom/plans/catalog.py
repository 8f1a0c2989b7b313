"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from claimloom.plans import documents, expenses, fields, fraud, kpi, layout, lifecycle, papers, retrieval, risk, sources  # noqa: F401
from claimloom.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "x11_fraud_assessment"
