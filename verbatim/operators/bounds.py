"""Sentence bounds: abbreviations learned from a corpus, so that their periods do not end a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verbatim.functions import text as tx

# How often a true abbreviation has its period, and the scores from which a word is taken for one, at once or if a small letter mostly follows.
KEEPS_PERIOD, SURE, LIKELY = 0.99, 0.3, 0.1


def period_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, with_period, without, small_after): how often each word stands with a period at its end, and before a small letter then."""
    pieces = F.filter(F.split(F.col(text), r"[ \t\n\f\r]+"), lambda p: p != "")
    rows = df.select(pieces.alias("_p")).select(F.inline(F.transform("_p", lambda p, i: F.struct(p.alias("p"), F.get("_p", i + 1).alias("after")))))
    # of a piece that is a word, only marks can follow the period
    dot = F.endswith(F.rtrim("p", F.lit(tx.MARKS_AFTER)), F.lit("."))
    rows = rows.select(tx.abbreviation_core(F.col("p")).alias("word"), dot.alias("dot"), "after").where("word <> ''")
    return rows.groupBy("word").agg(
        F.count_if("dot").alias("with_period"), F.count_if(~F.col("dot")).alias("without"), F.count_if(F.col("dot") & F.col("after").rlike(r"^[\p{Ll}]")).alias("small_after")
    )


def _score(period_share: Column) -> Column:
    """Log-likelihood ratio of a word that keeps its period against one that gets as many as any word, less for long words and those seen without."""
    a, b = F.col("with_period"), F.col("without")
    chance = a * F.ln(period_share) + b * F.ln(1.0 - period_share)
    keeps = a * F.ln(F.lit(KEEPS_PERIOD)) + b * F.ln(F.lit(1.0 - KEEPS_PERIOD))
    inner = F.char_length("word") - F.char_length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.char_length("word") - inner).cast("double")
    return 2.0 * (keeps - chance) * F.exp(-letters) * (inner + 1) * F.pow(letters, -b.cast("double"))


def abbreviations(df: DataFrame, text: str, least: int = 3) -> DataFrame:
    """(word, with_period, without, small_after, score) of the words that are abbreviations.

    A word that stands ``least`` times with a period or more is one if it has the
    period far more often than words have it by chance; short words and words with
    inner periods need less, and so do those that small letters follow. Words are
    counted where they stand, before one shuffle of the counts. Null texts count for
    nothing; a corpus without periods has none.
    """
    counts = period_counts(df, text)
    # reading all counts lets both sides share the shuffle behind them, so the texts are read once
    dots = F.when(F.col("small_after") >= 0, F.col("with_period"))
    share = counts.agg(F.sum(dots) / F.sum(F.col("with_period") + F.col("without"))).scalar()
    scored = counts.where(F.col("with_period") >= least).withColumn("score", _score(share))
    small = F.col("small_after") * 2 >= F.col("with_period")
    return scored.where((F.col("score") >= SURE) | (small & (F.col("score") >= LIKELY)))


def abbreviation_list(found: DataFrame) -> Column:
    """The words of an abbreviation table as ``tx.WORD_SLOTS`` arrays by hash."""
    slots = found.where(F.col("word").isNotNull()).groupBy(tx.slot_of("word").alias("slot")).agg(F.collect_set("word").alias("words"))
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "words")))  # at most WORD_SLOTS
    return slots.agg(filled.alias("_f")).select(F.transform(F.sequence(F.lit(0), F.lit(tx.WORD_SLOTS - 1)), lambda k: F.try_element_at("_f", k)).alias("known")).scalar()


def learned_sentences(df: DataFrame, text: str, found: DataFrame, out: str = "sentence", lower: bool = True, sentence_id: str | None = None) -> DataFrame:
    """One row per sentence with the other columns, bounds as ``found`` (an abbreviation table) says; ``sentence_id`` numbers them from 1."""
    listed = df.withColumn("_known", abbreviation_list(found))
    sentences = tx.bounded_sentences(F.col(text), F.col("_known"))
    arrays = listed.withColumn("_sentences", F.transform(sentences, F.lower) if lower else sentences).drop(text, "_known")
    carried = [c for c in arrays.columns if c != "_sentences"]
    rows = arrays.select(*carried, F.posexplode("_sentences").alias("_at", out))
    return rows.drop("_at") if sentence_id is None else rows.withColumnRenamed("_at", sentence_id).withColumn(sentence_id, (F.col(sentence_id) + 1).cast("long"))
