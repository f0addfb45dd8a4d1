"""All named queries; importing the plan modules registers them."""

from __future__ import annotations

from verbatim.plans import answers, cleaning, counting, feeling, reading, tokenising, topics  # noqa: F401
from verbatim.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
