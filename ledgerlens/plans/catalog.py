"""All registered queries."""

from ledgerlens.plans import ledger_queries, run_queries, search_queries, stream_queries, text_queries  # noqa: F401
from ledgerlens.plans.registry import ORACLES, QUERIES, with_tables  # noqa: F401
