"""All catalogue queries and their SQL twins."""

from __future__ import annotations

from tabforge.plans import (
    data_queries,
    model_queries,
    prep_queries,
    run_queries,
    serving_queries,
)

FLAGSHIP = "train_linear"
_PARTS = (data_queries, prep_queries, model_queries, run_queries, serving_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.catalogue.queries.items()}
ORACLES = {name: q for part in _PARTS for name, q in part.catalogue.oracles.items()}
