"""All queries over the driver's tables, by name, with their SQL."""

from newsflow.catalog import flows, more, rows, scalars, web  # noqa: F401
from newsflow.catalog.base import ORACLE_SQL, QUERIES  # noqa: F401
