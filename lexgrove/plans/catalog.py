"""All queries of the library's own operators."""

from lexgrove.plans import answers, contexts, documents, order, parsed, scores, surface, trees  # noqa: F401
from lexgrove.plans.registry import ORACLES, QUERIES  # noqa: F401
