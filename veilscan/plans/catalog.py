"""All registered queries: importing the area modules fills the registry."""

from veilscan.plans import parts  # noqa: F401
from veilscan.plans import text_queries, detection_queries, metric_queries, evidence_queries, guard_queries, run_queries, evalset_queries, file_queries, stream_queries  # noqa: F401
from veilscan.plans.registry import QUERIES, reference_sql  # noqa: F401
