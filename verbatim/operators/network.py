"""Bigram partners and the bigram graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from verbatim.operators.clean import filter_not_in
from verbatim.operators.topn import top_n


def bigram_pair_counts(pairs: DataFrame, weight: str = "rows", n: str = "n") -> DataFrame:
    """(word1, word2, n). From a per-segment count table ``rows`` counts the
    segments that hold the pair, ``occurrences`` adds their counts."""
    value = F.count("*") if weight == "rows" else F.sum(n)
    return pairs.groupBy("word1", "word2").agg(value.alias("n"))


def bigram_edges(pairs: DataFrame, more_than: int = 3, weight: str = "rows") -> DataFrame:
    """Directed weighted edges word1 -> word2 between two known words."""
    known = pairs.na.drop("any", subset=["word1", "word2"])
    return bigram_pair_counts(known, weight).where(F.col("n") > more_than)


def bigram_vertices(edges: DataFrame) -> DataFrame:
    """Words at either end of an edge."""
    return edges.select(F.explode(F.array("word1", "word2")).alias("id")).distinct()


def _partners(pairs: DataFrame, target: str, partner: str, targets: Iterable[str], exclude: Iterable[str], k: int | None,
              per_target: bool) -> DataFrame:
    hits = filter_not_in(pairs.where(F.col(target).isin(list(targets))), partner, exclude)
    counts = hits.groupBy(target, partner).agg(F.sum("n").alias("n"))
    return counts if k is None else top_n(counts, k, "n", by=target if per_target else None)


def words_after(pairs: DataFrame, targets: Iterable[str], exclude: Iterable[str] = (), k: int | None = 10,
                per_target: bool = True) -> DataFrame:
    """Words that follow the target words, top ``k`` per target or overall."""
    return _partners(pairs, "word1", "word2", targets, exclude, k, per_target)


def words_before(pairs: DataFrame, targets: Iterable[str], exclude: Iterable[str] = (), k: int | None = 10,
                 per_target: bool = True) -> DataFrame:
    """Words that precede the target words, top ``k`` per target or overall."""
    return _partners(pairs, "word2", "word1", targets, exclude, k, per_target)
