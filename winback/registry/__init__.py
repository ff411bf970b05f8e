"""Named queries and, where SQL can state them, the equal ANSI SQL."""

from __future__ import annotations

from winback.registry.core import ORACLES, QUERIES, finish

from winback.registry import q_ingest, q_decide, q_features, q_cohort, q_counterfactual, q_recommend, q_report, q_live, q_models, q_stream  # noqa: E402,F401

finish()
