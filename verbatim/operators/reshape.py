"""Wide <-> long reshaping and set-like joins of survey answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from verbatim.operators.keyed import ordinals


def unpivot_choices(df: DataFrame, ids: Sequence[str], boxes: Sequence[str], out: str = "category") -> DataFrame:
    """One row per ticked box: (ids..., ``out``, ord). Unticked and unanswered boxes drop out.

    Used for single-choice and for multi-choice questions; ``ord`` is the box's
    column position.
    """
    ticked = F.filter(
        F.array(*[F.when(F.col(b), F.struct(F.lit(b).alias(out), F.lit(i).cast("long").alias("ord"))) for i, b in enumerate(boxes)]),
        lambda box: box.isNotNull(),
    )
    return df.select(*ids, F.inline(ticked))


def concat_choices(df: DataFrame, ids: Sequence[str], boxes: Sequence[str], out: str = "reasons", sep: str = ",") -> DataFrame:
    """Ticked boxes of each response joined in column order; responses without a tick drop out.

    The boxes of a response sit in one row, so this needs no unpivot and no shuffle.
    """
    ticked = F.filter(F.array(*[F.when(F.col(b), F.lit(b)) for b in boxes]), lambda box: box.isNotNull())
    return df.select(*ids, ticked.alias(out)).where(F.size(out) > 0).withColumn(out, F.array_join(out, sep))


def concat_long_choices(long: DataFrame, ids: Sequence[str], reason: str, order: str, out: str = "reasons", sep: str = ",") -> DataFrame:
    """The same from an already unpivoted block; a group holds one response's boxes."""
    return long.groupBy(*ids).agg(F.expr(f"listagg({reason}, '{sep}') within group (order by {order})").alias(out))


def full_join_blocks(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two unpivoted question blocks."""
    return a.join(b, list(keys), "full")


def pivot_counts(df: DataFrame, ids: str | Sequence[str], column: str, values: Sequence[str], n: str | None = "n",
                 fill: int | None = None) -> DataFrame:
    """One column per listed value; a missing cell is null, or ``fill``."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    cell = F.count(F.lit(1)) if n is None else F.sum(n)
    wide = df.groupBy(*ids).pivot(column, list(values)).agg(cell)
    return wide if fill is None else wide.fillna(fill, subset=list(values))


def term_document_table(texts: DataFrame, document: str, text: str, min_length: int = 3) -> DataFrame:
    """Long (term, document, n) table of blank-separated cleaned text."""
    words = texts.select(document, F.explode(F.split(text, " +")).alias("term"))
    return words.where(F.char_length("term") >= min_length).groupBy("term", document).agg(F.count("*").alias("n"))


def cast_dfm(counts: DataFrame, document: str, term: str, n: str = "n", binary: bool = False) -> DataFrame:
    """Document-feature matrix in its sparse long form (document, term, n)."""
    cell = F.lit(1).cast("long") if binary else F.sum(n)
    return counts.where(F.col(document).isNotNull()).groupBy(document, term).agg(cell.alias(n))


def dfm_dictionary(counts: DataFrame, term: str) -> DataFrame:
    """(term, id): ids 0 to V - 1 without gaps, in the order of the terms."""
    terms = counts.where(F.col(term).isNotNull()).select(term).distinct()
    return ordinals(terms, [term], out="id").withColumn("id", F.col("id") - 1)


def dfm_vectors(counts: DataFrame, dictionary: DataFrame, document: str, term: str, n: str = "n", binary: bool = False) -> DataFrame:
    """Document-feature matrix as one sparse vector per document: (document, size, indices, values).

    ``size`` is the number of terms of the dictionary; indices ascend. Counts of one
    cell are summed. A document without any term of the dictionary has no vector.
    """
    cells = cast_dfm(counts.where(F.col(term).isNotNull()), document, term, n, binary)
    ids = cells.join(dictionary.select(F.col(term).alias("_term"), "id"), F.col(term) == F.col("_term"))
    pairs = F.array_sort(F.collect_list(F.struct("id", F.col(n).cast("double").alias("v"))))  # at most the terms of one document
    size = dictionary.agg(F.count("*").alias("v")).scalar()
    out = ids.groupBy(document).agg(pairs.alias("_p"))
    return out.select(document, size.alias("size"), F.transform("_p", lambda p: p["id"]).alias("indices"), F.transform("_p", lambda p: p["v"]).alias("values"))


def dfm_cells(vectors: DataFrame, dictionary: DataFrame, document: str, term: str, n: str = "n") -> DataFrame:
    """The long form (document, term, n) of sparse vectors."""
    cells = vectors.select(document, F.inline(F.arrays_zip("indices", "values")))
    return cells.join(dictionary, F.col("indices") == F.col("id")).select(document, term, F.col("values").alias(n))
