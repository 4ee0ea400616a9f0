"""All registered queries; importing a module registers its part."""

from faultmatch.queries.base import QUERIES, SQL
from faultmatch.queries import texts, checks, scores, reports, matches, upkeep, learning

__all__ = ["QUERIES", "SQL", "texts", "checks", "scores", "reports", "matches", "upkeep", "learning"]
