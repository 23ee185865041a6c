"""All queries by name, with their DuckDB equivalents."""

from moiety.queries import distances, evaluation, metadata, scalars, structure  # noqa: F401
from moiety.queries.registry import ORACLES, QUERIES  # noqa: F401
