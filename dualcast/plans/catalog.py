"""All registered queries; importing this module fills the registry."""

from dualcast.plans import model_queries, panel_queries, report_queries, study_queries  # noqa: F401
from dualcast.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
