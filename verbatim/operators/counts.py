"""Counting operators. Spark's partial aggregation combines hot terms before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from verbatim.operators.topn import top_n


def count_by(df: DataFrame, *keys: str, out: str = "n", weight: str | None = None, alone: str | None = None) -> DataFrame:
    """Rows (or the sum of ``weight``) per key; null keys form a group.

    Where the boolean column ``alone`` is true, the row is known to be the only one of its key: it is
    counted where it is, and only the other rows are shuffled.
    """
    if alone is not None:
        own = df.where(alone).select(*keys, (F.lit(1).cast("long") if weight is None else F.col(weight)).alias(out))
        return own.unionByName(count_by(df.where(~F.coalesce(alone, F.lit(False))), *keys, out=out, weight=weight))
    value = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(value.alias(out))


def total_rows(df: DataFrame, *null_checked: str) -> DataFrame:
    """One row: number of rows, and of null / non-null values of the given columns."""
    parts = [F.count("*").alias("n")]
    for c in null_checked:
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count(c).alias(f"{c}_not_null")]
    return df.agg(*parts)


def lexicon_coverage(scored: DataFrame, word: str = "word", score: str = "score") -> DataFrame:
    """One row: distinct words without a score, with a score, and in total.

    The words are made distinct first, so one shuffle serves all three counts.
    """
    words = scored.groupBy(word).agg(
        F.bool_or(F.col(score).isNull()).alias("_bare"), F.bool_or(F.col(score).isNotNull()).alias("_hit")
    )
    return words.agg(
        F.count_if("_bare").alias("unscored"), F.count_if("_hit").alias("scored"), F.count("*").alias("total")
    )


def category_counts(counts: DataFrame, term: str, category: str, categories: Sequence[str], n: str = "n") -> DataFrame:
    """One column ``<category>_n`` per category, null where the term is absent from it."""
    return counts.where(F.col(category).isin(list(categories))).groupBy(term).agg(
        *[F.sum(F.when(F.col(category) == c, F.col(n))).alias(f"{c}_n") for c in categories]
    )


def common_terms(counts: DataFrame, term: str, category: str, a: str, b: str, n: str = "n") -> DataFrame:
    """Terms present in both categories with both counts; one aggregation instead of a self join."""
    return category_counts(counts, term, category, [a, b], n).na.drop("any", subset=[f"{a}_n", f"{b}_n"])


def paired_counts(counts: DataFrame, term: str, category: str, a: str, b: str, k: int = 25, n: str = "n") -> DataFrame:
    """The ``k`` common terms with the largest absolute count difference."""
    both = common_terms(counts, term, category, a, b, n)
    both = both.withColumn("difference", F.abs(F.col(f"{a}_n") - F.col(f"{b}_n")))
    return both.orderBy(F.desc("difference"), F.asc(term)).limit(k)


def mirrored_counts(counts: DataFrame, category: str, negated: str, k: int = 20, n: str = "n") -> DataFrame:
    """Top ``k`` terms per category with the counts of one category negated."""
    top = top_n(counts, k, n, by=category)
    return top.withColumn("signed_n", F.when(F.col(category) == negated, -F.col(n)).otherwise(F.col(n)))
