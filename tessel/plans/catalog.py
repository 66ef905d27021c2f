"""All queries of the core."""

from tessel.plans import activity, evaluate, graph, orphans, search, similar, state, text
from tessel.plans.registry import Query

QUERIES: dict[str, Query] = {}
for _part in (orphans, text, activity, graph, search, similar, evaluate, state):
    QUERIES |= _part.QUERIES
