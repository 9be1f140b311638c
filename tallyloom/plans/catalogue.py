"""Every query of the purchase engine with the SQL it is held against."""

from tallyloom.plans import changing, replication, selections, spending, streams, values  # noqa: F401  they register their queries
from tallyloom.plans.registry import QUERIES, SQL  # noqa: F401
