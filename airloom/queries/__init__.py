"""Every operator run on the driver tables, each beside the SQL it must agree with."""

from airloom.queries.base import QUERIES, SQL
from airloom.queries import batch, tables, windows, reports, joins, models, streams  # noqa: F401,E402

__all__ = ["QUERIES", "SQL"]
