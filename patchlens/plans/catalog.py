"""All registered queries."""
from patchlens.plans import job_queries, table_queries, text_queries  # noqa: F401
from patchlens.plans.registry import ORACLES, QUERIES  # noqa: F401
