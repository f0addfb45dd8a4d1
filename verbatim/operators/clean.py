"""Cleaning, filters and projections of response tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from verbatim.functions import text as tx
from verbatim.operators.keyed import names


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names with ``_`` for each white-space character."""
    return df.toDF(*[re.sub(r"\s", "_", c).lower() for c in df.columns])


def rename_columns(df: DataFrame, new_names: Sequence[str]) -> DataFrame:
    """Rename all columns by position."""
    return df.toDF(*new_names)


def filter_in_list(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_not_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Drop the listed values and keep null."""
    return df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def filter_not_regex(df: DataFrame, column: str, pattern: str, lower: bool = False) -> DataFrame:
    """Keep rows whose text does not contain the pattern; null text is dropped."""
    value = F.lower(column) if lower else F.col(column)
    return df.where(~value.rlike(pattern))


def filter_row_id_not(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop one known row; the value is cast to the column's type so the filter reaches the scan."""
    return df.where(F.col(column) != F.lit(value).cast(df.schema[column].dataType))


def filter_min_length(df: DataFrame, column: str, longer_than: int) -> DataFrame:
    return df.where(F.char_length(column) > longer_than)


def filter_has_letter(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows in which each column holds a letter a-z."""
    for c in columns:
        df = df.where(F.col(c).rlike("[a-z]"))
    return df


def filter_min_count(df: DataFrame, more_than: int, n: str = "n") -> DataFrame:
    return df.where(F.col(n) > more_than)


def filter_word_count(df: DataFrame, more_than: int | None = None, less_than: int | None = None,
                      equal_to: int | None = None, column: str = "word_count") -> DataFrame:
    if more_than is not None:
        df = df.where(F.col(column) > more_than)
    if less_than is not None:
        df = df.where(F.col(column) < less_than)
    if equal_to is not None:
        df = df.where(F.col(column) == equal_to)
    return df


def filter_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def filter_not_null(df: DataFrame, column: str, also_literal_na: bool = False) -> DataFrame:
    """Keep non-null rows; optionally drop the literal text ``NA`` as well."""
    return df.where(F.col(column) != "NA") if also_literal_na else df.where(F.col(column).isNotNull())


def drop_na(df: DataFrame, subset: str | Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column, or in the named ones."""
    return df.na.drop("any", subset=names(subset) or None)


def split_path_columns(df: DataFrame, path: str, into: tuple[str, str] = ("split_1", "split_2")) -> DataFrame:
    """Replace a path column by its first two pieces."""
    first, second = tx.split_path(path)
    return df.withColumns({into[0]: first, into[1]: second}).drop(path)


def split_pair(df: DataFrame, column: str, into: tuple[str, str] = ("word1", "word2"), remove: bool = True) -> DataFrame:
    """Split a two-word column at its blank."""
    words = F.split(F.col(column), " ")
    df = df.withColumns({into[0]: F.get(words, 0), into[1]: F.get(words, 1)})
    return df.drop(column) if remove else df


def count_literal_answers(df: DataFrame, column: str, answers: Iterable[str]) -> DataFrame:
    """One row: responses whose whole text is one of the answers."""
    return df.where(F.col(column).isin(list(answers))).agg(F.count("*").alias("n"))
