"""All registered queries over the driver's tables."""

from draftlake.plans import drafts, features, feed, protocol, relational, scalars, snapshots
from draftlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "drafts", "features", "feed", "protocol", "relational", "scalars", "snapshots"]
