"""The registered queries: a Spark function and, where SQL can say it, the same query in SQL."""

from .base import QUERIES, SQL  # noqa: F401
from . import (  # noqa: F401
    clinical_and_contract, audit_and_splits, metric_queries, report_queries, feature_queries, similarity_queries, model_queries,
)
