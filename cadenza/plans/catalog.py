"""All queries of the reference operators; importing the modules registers them."""

from __future__ import annotations

from cadenza.plans import breaks, engines, more, relations, reviews, rules, scores, texts, timeline, wording  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
