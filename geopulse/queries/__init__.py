"""All registered queries."""

from geopulse.queries import (
    job_queries,
    official_queries,
    place_queries,
    source_queries,
    store_queries,
    text_queries,
    view_queries,
)  # noqa: F401
from geopulse.queries.registry import ORACLES, QUERIES  # noqa: F401
