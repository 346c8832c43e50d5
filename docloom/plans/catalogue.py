"""All queries of the core library for the driver."""

from __future__ import annotations

from docloom.plans import chosen, engine, graphs, judged, quality, retrieval, text, trees  # noqa: F401
from docloom.plans.registry import QUERIES, SQL  # noqa: F401
