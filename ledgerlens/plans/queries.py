"""Registered queries (one per operator of the coverage checklist).

Each query reads the driver tables (or frames Spark derives from them) in
full; nothing is sampled or capped except where the limit is the feature.
"""

from __future__ import annotations

# Importing the modules registers their queries.
from ledgerlens.plans import q_audit, q_etl, q_features, q_governance, q_graph, q_metrics, q_models  # noqa: F401
