"""The registered queries of the library and their oracle SQL."""

from __future__ import annotations

from quarry.plans import evaluation, ingestion, learning, questions, reports, retrieval, runs, scalars, streams, validation  # noqa: F401
from quarry.plans.registry import ORACLE, QUERIES  # noqa: F401
from quarry.plans.retrieval import flagship  # noqa: F401
