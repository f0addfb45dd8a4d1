"""Tables behind comparison and word clouds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from verbatim.operators.reshape import pivot_counts


def comparison_terms(counts: DataFrame, term: str, category: str, categories: Sequence[str], n: str = "n",
                     k: int | None = 125) -> DataFrame:
    """Terms by how far their rate in one category exceeds the mean rate over categories.

    (term, category, deviation); the first listed category wins a tie. ``k``
    None returns every term.
    """
    cells = counts.where(F.col(category).isin(list(categories)))
    wide = pivot_counts(cells, term, category, categories, n, fill=0)
    totals = cells.agg(F.struct(*[F.sum(F.when(F.col(category) == c, F.col(n))).alias(c) for c in categories])).scalar()
    rates = [F.coalesce(F.col(c) / totals.getField(c), F.lit(0.0)) for c in categories]
    mean = reduce(lambda a, b: a + b, rates) / len(categories)
    shift = wide.select(term, *[(r - mean).alias(c) for r, c in zip(rates, categories)])
    best = F.greatest(*categories) if len(categories) > 1 else F.col(categories[0])
    owner = F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in categories])
    out = shift.select(term, owner.alias(category), best.alias("deviation"))
    return out if k is None else out.orderBy(F.desc("deviation"), F.asc(term)).limit(k)


def frequent_terms(term_documents: DataFrame, term: str = "term", n: str = "n", k: int = 50) -> DataFrame:
    """Most frequent terms over all documents; equal counts are ordered by term."""
    return term_documents.groupBy(term).agg(F.sum(n).alias(n)).orderBy(F.desc(n), F.asc(term)).limit(k)
