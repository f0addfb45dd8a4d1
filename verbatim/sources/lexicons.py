"""Stop words and sentiment lexicons as small DataFrames.

Lexicons built from Python values become a local relation whose exact size
Spark knows; a lexicon read from a table keeps that table's statistics. No
operator forces a broadcast: Spark broadcasts a lexicon that is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, functions as F


def stop_word_list(language: str = "english") -> list[str]:
    """Spark's built-in stop words of one language."""
    return StopWordsRemover.loadDefaultStopWords(language)


def word_frame(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"word": pa.array(sorted(set(words)), pa.string())}))


def load_stop_words(spark: SparkSession, languages: Iterable[str] = ("english",)) -> DataFrame:
    """Stacked stop word lists of several languages without duplicates: (word)."""
    return word_frame(spark, [w for lang in languages for w in stop_word_list(lang)])


def stacked_stop_words(lists: Mapping[str, DataFrame]) -> DataFrame:
    """(word, lexicon) of several (word) tables, each under its name."""
    named = [df.select("word", F.lit(name).alias("lexicon")).where(F.col("word").isNotNull()).distinct() for name, df in lists.items()]
    return reduce(DataFrame.union, named)


def polarity_lexicon(spark: SparkSession, entries: Mapping[str, str]) -> DataFrame:
    """(word, sentiment) from a mapping."""
    return spark.createDataFrame(
        pa.table({"word": pa.array(list(entries), pa.string()), "sentiment": pa.array(list(entries.values()), pa.string())})
    )


def score_lexicon(spark: SparkSession, entries: Mapping[str, float]) -> DataFrame:
    """(word, score) from a mapping."""
    return spark.createDataFrame(
        pa.table(
            {"word": pa.array(list(entries), pa.string()), "score": pa.array([float(v) for v in entries.values()], pa.float64())}
        )
    )


def normalise_lexicon(df: DataFrame, value: str, out: str, word: str = "word", to: str = "string") -> DataFrame:
    """(word, ``out``) with lower-cased non-null words; bad numbers become null and are dropped."""
    return (
        df.select(F.lower(F.trim(F.col(word))).alias("word"), F.col(value).try_cast(to).alias(out))
        .na.drop("any")
        .distinct()
    )
