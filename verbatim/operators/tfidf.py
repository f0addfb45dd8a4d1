"""Term frequency and inverse document frequency of count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verbatim.operators.keyed import SALTS, attach


def tf_idf(counts: DataFrame, term: str, document: str, n: str = "n", dedupe: bool = True) -> DataFrame:
    """(term, document, n, tf, idf, tf_idf).

    tf = n / total n of the document, idf = ln(documents / rows of the term). A
    null document has no total (tf null) and is not counted as a document.

    Totals come from partial aggregates that are joined back, never from windows:
    document totals over salted keys, term rows by a join whose hot partitions
    Spark splits, so neither a document with a third of the rows nor a term of
    every document fills one task. With ``dedupe=False`` every input row is kept and counted,
    each carrying the summed n of its cell: totals and term rows are then
    inflated and idf can be negative, as when the formula is applied to counts
    finer than (term, document).
    """
    cells = counts.groupBy(term, document).agg(F.sum(n).alias(n), F.count("*").alias("_rows"))
    if dedupe:
        cells = cells.withColumn("_rows", F.lit(1).cast("long"))
    # Every branch reads all columns of the cells, so that all share one shuffle of
    # them and the texts are tokenised once: no filter on the key, no unused count.
    in_document = F.when(F.col(document).isNotNull(), F.sum(F.col(n) * F.col("_rows")))
    totals = cells.groupBy(document).agg(in_document.alias("_total"))
    spread = cells.groupBy(term).agg(F.sum(F.when(F.col(n).isNotNull(), F.col("_rows"))).alias("_term_rows"))
    documents = totals.agg(F.count("_total")).scalar()
    out = attach(attach(cells, totals, document, "left", SALTS), spread, term)
    out = out.withColumn("tf", F.col(n) / F.col("_total"))
    out = out.withColumn("idf", F.ln(documents.cast("double") / F.col("_term_rows")))
    out = out.withColumn("tf_idf", F.col("tf") * F.col("idf"))
    if not dedupe:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return out.select(term, document, n, "tf", "idf", "tf_idf")
