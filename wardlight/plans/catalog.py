"""All registered queries with their SQL twins."""

from __future__ import annotations

from wardlight.plans import (
    clinical_queries, evaluation_queries, feature_queries, history_queries, job_queries, model_queries,
    source_queries, stream_queries)
from wardlight.session import ship_package

_MODULES = [history_queries, evaluation_queries, clinical_queries, feature_queries, model_queries, job_queries,
            source_queries, stream_queries]

ship_package()

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
