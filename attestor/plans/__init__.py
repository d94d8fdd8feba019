"""The catalogue of queries."""

from attestor.plans import contract_texts, contracts, documents, evidence, grounding, planning, references, sources  # noqa: F401
from attestor.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
