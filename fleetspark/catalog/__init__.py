"""All registered queries."""

from fleetspark.catalog import (  # noqa: F401
    aggregate_queries,
    join_queries,
    lifecycle_queries,
    store_queries,
    stream_queries,
    text_queries,
    view_queries,
)
from fleetspark.catalog.registry import ORACLES, QUERIES  # noqa: F401
