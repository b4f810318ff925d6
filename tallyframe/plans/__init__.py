"""Every registered query of the library and its oracle."""

from tallyframe.plans import audit_queries, contract_queries, metadata_queries, panel_queries, score_queries, serving_queries, sheet_queries, stream_queries  # noqa: F401  they register their queries
from tallyframe.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
