"""Tokenisers: one row per word, n-gram or sentence.

All of them work on the word array of a response, so tokenising, dropping stop
words and forming n-grams happen in the scan stage. Responses with null text
give one null word or n-gram; responses without words give no word row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from verbatim.functions import text as tx
from verbatim.operators.keyed import names


StopWords = Iterable[str] | DataFrame


def with_word_array(df: DataFrame, text: str, out: str = "words", stop_words: StopWords | None = None) -> DataFrame:
    """Replace the text by its word array, optionally without stop words.

    A list is filtered inside the array. A (word) table is anti-joined by token and
    the arrays are put together again; responses without any word left then go.
    """
    df = df.withColumn(out, tx.word_array(text)).drop(text)
    if stop_words is None:
        return df
    if not isinstance(stop_words, DataFrame):
        return df.withColumn(out, tx.without_words(out, stop_words))
    carried = [c for c in df.columns if c != out]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    words = remove_stop_words(numbered.select("_row", *carried, F.posexplode(out).alias("_pos", "_word")), stop_words, "_word")
    pairs = F.array_sort(F.collect_list(F.struct("_pos", "_word")))  # at most the words of one response
    return words.groupBy("_row", *carried).agg(F.transform(pairs, lambda p: p["_word"]).alias(out)).drop("_row")


def word_tokens(df: DataFrame, text: str, out: str = "word", pos: str | None = None,
                stop_words: StopWords | None = None, times: str | None = None) -> DataFrame:
    """One row per word with the other columns carried along.

    With ``times``, one row per distinct word of a response, and how often it has it; such rows have no ``pos``.
    """
    if pos is not None and times is not None:
        raise ValueError("a distinct word has no one position")
    listed = None if isinstance(stop_words, DataFrame) else stop_words
    arrays = with_word_array(df, text, "_words", listed)
    carried = [c for c in arrays.columns if c != "_words"]
    words = F.coalesce("_words", F.array(F.lit(None).cast("string")))
    if times is not None:
        runs = arrays.select(*carried, F.sort_array(words).alias("_words"))
        runs = runs.withColumns({"_starts": tx.run_starts("_words"), "_end": F.size("_words")})
        each = runs.select(*carried, "_starts", "_end", F.posexplode(F.array_distinct("_words")).alias("_run", out))
        # Counted from the places, above the rows: where nobody reads the numbers, Spark leaves out the places as well.
        number = F.coalesce(F.get("_starts", F.col("_run") + 1), F.col("_end")) - F.get("_starts", F.col("_run"))
        tokens = each.select(*carried, out, number.cast("long").alias(times))
    else:
        each = F.explode(words).alias(out) if pos is None else F.posexplode(words).alias(pos, out)
        tokens = arrays.select(*carried, each)
    return remove_stop_words(tokens, stop_words, out) if isinstance(stop_words, DataFrame) else tokens


def ngrams(df: DataFrame, text: str, n: int, out: str = "ngram", stop_words: StopWords | None = None,
           keep_short: bool = True) -> DataFrame:
    """One row per ``n``-gram of adjacent words.

    With ``stop_words`` the n-grams bridge removed words and responses left
    without any word disappear, as they do from a filtered token table.
    """
    arrays = with_word_array(df, text, "_words", stop_words)
    if stop_words is not None:
        arrays = arrays.where(F.size("_words") > 0)
    if not keep_short:
        arrays = arrays.where(F.size("_words") >= n)
    carried = [c for c in arrays.columns if c != "_words"]
    # Zipped and joined as rows: in generated code, which lambdas over the array are not. A row without n words gives one null.
    parts = [f"w{k}" for k in range(1, n + 1)]
    long = F.size("_words") >= n
    rows = arrays.select(
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], F.coalesce(long, F.lit(False)).alias("_long"),
        F.inline(F.when(long, tx.adjacent("_words", n)).otherwise(F.array(F.struct(*[F.lit(None).cast("string").alias(w) for w in parts])))),
    ).where(F.col(parts[-1]).isNotNull() | ~F.col("_long"))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], F.when(F.col("_long"), F.concat_ws(" ", *parts)).alias(out))


def rejoined_text(df: DataFrame, text: str, stop_words: StopWords, out: str = "no_stop_text") -> DataFrame:
    """Text of each response without its stop words, joined by blanks."""
    arrays = with_word_array(df, text, "_words", stop_words).where(F.size("_words") > 0)
    return arrays.withColumn(out, F.array_join("_words", " ")).drop("_words")


def rejoin_tokens(tokens: DataFrame, keys: str | Sequence[str], word: str = "word", pos: str = "pos",
                  out: str = "no_stop_words") -> DataFrame:
    """Words of each response back in one array, from a token table.

    ``keys`` must identify a response: a group is then never longer than its text.
    """
    pairs = F.array_sort(F.collect_list(F.struct(pos, word)))
    return tokens.groupBy(*names(keys)).agg(F.transform(pairs, lambda p: p[word]).alias(out))


def ngrams_over_tokens(tokens: DataFrame, keys: str | Sequence[str], n: int, word: str = "word", pos: str = "pos",
                       out: str = "ngram") -> DataFrame:
    """``n``-grams per response whose input is an already exploded token table."""
    arrays = rejoin_tokens(tokens, keys, word, pos, "_words")
    return arrays.select(*names(keys), F.explode(tx.ngram_array("_words", n)).alias(out))


def sentence_tokens(df: DataFrame, text: str, out: str = "sentence", lower: bool = True, sentence_id: str | None = None) -> DataFrame:
    """One row per sentence; ``sentence_id`` numbers them from 1 in each response."""
    arrays = df.withColumn("_sentences", tx.sentence_array(F.lower(text) if lower else text)).drop(text)
    carried = [c for c in arrays.columns if c != "_sentences"]
    if sentence_id is None:
        return arrays.select(*carried, F.explode("_sentences").alias(out))
    rows = arrays.select(*carried, F.posexplode("_sentences").alias(sentence_id, out))
    return rows.withColumn(sentence_id, (F.col(sentence_id) + 1).cast("long"))


def remove_stop_words(tokens: DataFrame, stop_words: DataFrame, word: str = "word") -> DataFrame:
    """Anti join of a token table with a (word) table; a null word survives."""
    stops = stop_words.select(F.col("word").alias("_stop")).where(F.col("_stop").isNotNull())
    return tokens.join(stops, F.col(word) == F.col("_stop"), "left_anti")


def bigrams_without_stop_parts(bigrams: DataFrame, stop_words: DataFrame, bigram: str = "bigram") -> DataFrame:
    """Bigrams of raw text in which neither half is a stop word and both hold a letter."""
    halves = F.split(F.col(bigram), " ")
    parts = bigrams.withColumns({"first": F.get(halves, 0), "second": F.get(halves, 1)})
    parts = parts.where(F.col("first").rlike("[a-z]") & F.col("second").rlike("[a-z]"))
    return remove_stop_words(remove_stop_words(parts, stop_words, "first"), stop_words, "second")


def pairs_without_stop_parts(df: DataFrame, text: str, stop_words: StopWords) -> DataFrame:
    """The same pairs as (word1, word2) rows from the text.

    With a list, pairs are dropped inside the word array, before any row is made of
    them; with a (word) table, both words are anti-joined.
    """
    table = isinstance(stop_words, DataFrame)
    words = with_word_array(df, text, "_words")
    words = words.withColumn("_words", tx.only_lettered("_words", () if table else stop_words))
    carried = [c for c in words.columns if c != "_words"]
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)]
    pairs = words.select(*kept, F.inline(tx.adjacent("_words", 2))).where(F.col("w1").isNotNull() & F.col("w2").isNotNull())
    pairs = pairs.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], F.col("w1").alias("word1"), F.col("w2").alias("word2"))
    return remove_stop_words(remove_stop_words(pairs, stop_words, "word1"), stop_words, "word2") if table else pairs
