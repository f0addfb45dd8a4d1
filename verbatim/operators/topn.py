"""Top-k, order and label operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from verbatim.functions.text import facet_label
from verbatim.operators.keyed import SALTS, attach, names, ordinals


def top_n(df: DataFrame, k: int, weight: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """All rows whose weight ranks within the best ``k`` (of their group), ties kept.

    The k-th best weight is found first, from at most ``k`` rows per group and task;
    the rows are then filtered against it where they are. No group passes through
    one task, however many rows or ties it has. The weight must be reproducible (a
    count, or arithmetic on counts).
    """
    by = names(by)
    known = df.where(F.col(weight).isNotNull())
    if not by:
        cut = known.select(weight).orderBy(F.desc(weight)).limit(k).agg(F.min(weight)).scalar()
        return df.where(F.col(weight) >= cut)
    # Each task sends at most k rows of a group: the limit on row numbers is applied before the shuffle.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(weight)))
    best = known.select(*by, weight).withColumn("_place", place).where(F.col("_place") <= k)
    cuts = best.groupBy(*by).agg(F.min(weight).alias("_cut"))
    return attach(df, cuts, by, salts=SALTS).where(F.col(weight) >= F.col("_cut")).drop("_cut")


def top_n_exact(df: DataFrame, k: int, term: str, n: str = "n") -> DataFrame:
    """Exactly ``k`` rows by count; equal counts are ordered by term, last first."""
    return df.where(F.col(term).isNotNull()).orderBy(F.desc(n), F.desc(term)).limit(k)


def top_n_per_term_group(df: DataFrame, k: int, weight: str, group: str, term: str) -> DataFrame:
    """Top k rows of each (group, term), ties kept; for a count table, which has one row each, all rows."""
    return top_n(df, k, weight, by=[group, term])


def top_facets(df: DataFrame, k: int, term: str, facet: str, weight: str = "n") -> DataFrame:
    """Bars of a faceted chart: null terms out, top k of each facet with ties, bar order and the label term__facet."""
    best = top_n(df.where(F.col(term).isNotNull()), k, weight, by=facet)
    return bar_order(best, term, weight, facet).withColumn("label", facet_label(term, facet))


def top_bars(df: DataFrame, k: int, term: str, weight: str = "n") -> DataFrame:
    """Bars of a chart without facets: null terms out, top k with ties, and bar order."""
    return bar_order(top_n(df.where(F.col(term).isNotNull()), k, weight), term, weight)


def sort_desc(df: DataFrame, value: str, term: str) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(term))


def sort_group_then_desc(df: DataFrame, group: str, n: str = "n") -> DataFrame:
    """Order by group, then count; the other columns break ties, so that many equal
    counts of one group are still cut into ranges."""
    rest = [F.asc(c) for c in df.columns if c not in (group, n)]
    return df.orderBy(F.asc(group), F.desc(n), *rest)


def head_limit(df: DataFrame, order: Sequence[Column], k: int = 6) -> DataFrame:
    """The first ``k`` rows of a total order."""
    return df.orderBy(*order).limit(k)


def bar_order(df: DataFrame, term: str, n: str = "n", facet: str | Sequence[str] | None = None, out: str = "ord") -> DataFrame:
    """Position of each bar in its facet: 1 for the smallest count."""
    return ordinals(df, [n, term], by=facet, out=out)


def collapse_repeated_labels(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Blank the group label on all but the group's first row in ``order`` (unique in a group).

    The first row is a partial aggregate (minimum of the order columns), not a window.
    """
    rest = [c for c in df.columns if c != group and c not in order]  # read as well, so that both uses of df share a shuffle
    firsts = df.groupBy(group).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    is_first = F.struct(*order).eqNullSafe(F.struct(*[F.col("_first").getField(c).alias(c) for c in order]))
    label = F.when(is_first, F.col(group)).otherwise("")
    return attach(df, firsts, group, salts=SALTS).withColumn("_label", label).withColumn(group, F.col("_label")).drop("_first", "_label")
