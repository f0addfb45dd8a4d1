"""Lexicon sentiment of words, responses, segments and sentences.

Lexicons are DataFrames: (word, sentiment) and (word, score). Joins state no
hint: Spark broadcasts a lexicon it measures as small and otherwise shuffles,
splitting skewed partitions. Where only counts are needed, tokens are counted
first and the lexicon joins the distinct words.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from verbatim.functions import numeric as num, text as tx
from verbatim.operators.bounds import abbreviation_list
from verbatim.operators.keyed import SALTS, attach, names
from verbatim.operators.topn import top_n
from verbatim.sources.lexicons import polarity_lexicon, score_lexicon

# Weights and reach of the sentence score.
SHIFT_WEIGHT = 0.8
ADVERSATIVE_WEIGHT = 0.25
WORDS_BEFORE = 5
WORDS_AFTER = 2


# --- lexicon joins ----------------------------------------------------------

def join_polarity(tokens: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Tokens (or counts) that are in the polarity lexicon, with their sentiment."""
    return tokens.join(lexicon.select(F.col("word").alias(word), "sentiment"), word)


def join_scores(tokens: DataFrame, lexicon: DataFrame, how: str = "left", word: str = "word") -> DataFrame:
    """Tokens (or counts) with their score; ``left`` keeps unscored words as null."""
    return tokens.join(lexicon.select(F.col("word").alias(word), "score"), word, how)


def override_scores(lexicon: DataFrame, scores: Mapping[str, float] | DataFrame) -> DataFrame:
    """Reassign the scores of some lexicon words, given as a mapping or as a (word, score) table."""
    new = scores.select("word", F.col("score").cast("double").alias("_new")) if isinstance(scores, DataFrame) else score_lexicon(
        lexicon.sparkSession, scores
    ).withColumnRenamed("score", "_new")
    return lexicon.join(new, "word", "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")


def override_polarity(counts: DataFrame, sentiments: Mapping[str, str] | DataFrame, neutral: Iterable[str] = (),
                      word: str = "word") -> DataFrame:
    """Reassign the sentiment of some words and drop neutral ones; counts stay as they are.

    A (word, sentiment) table works like the mapping; its words without sentiment are neutral.
    """
    spark = counts.sparkSession
    if not isinstance(sentiments, DataFrame):
        sentiments = polarity_lexicon(spark, {**sentiments, **dict.fromkeys(neutral)})
    new = sentiments.select(F.col("word").alias(word), F.col("sentiment").alias("_new"), F.lit(True).alias("_known"))
    joined = counts.join(new, word, "left").where(F.col("_known").isNull() | F.col("_new").isNotNull())
    return joined.withColumn("sentiment", F.coalesce("_new", "sentiment")).select(*counts.columns)


# --- word polarity ----------------------------------------------------------

def polarity_word_counts(tokens: DataFrame, lexicon: DataFrame, *dims: str, word: str = "word") -> DataFrame:
    """(word, sentiment, dims..., n); words are counted before they meet the lexicon."""
    counts = tokens.groupBy(word, *dims).agg(F.count("*").alias("n"))
    return join_polarity(counts, lexicon, word).groupBy(word, "sentiment", *dims).agg(F.sum("n").alias("n"))


def score_word_counts(counts: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, score, n): rows of a count table per scored word."""
    rows = counts.groupBy(word).agg(F.count("*").alias("n"))
    return join_scores(rows, lexicon, "inner", word).groupBy(word, "score").agg(F.sum("n").alias("n"))


def top_words_by_sentiment(polar_counts: DataFrame, k: int = 10) -> DataFrame:
    return top_n(polar_counts, k, "n", by="sentiment")


def top_polar_words(polar_counts: DataFrame, sentiment: str, by: str | Sequence[str], k: int = 5, more_than: int = 0) -> DataFrame:
    """Top words of one sentiment per group, optionally only those counted more than once."""
    rows = polar_counts.where((F.col("sentiment") == sentiment) & F.col("word").isNotNull() & (F.col("n") > more_than))
    return top_n(rows, k, "n", by=by)


# --- responses and segments -------------------------------------------------

def response_mean_score(scored: DataFrame, row_id: str, out: str = "avg_sm_score") -> DataFrame:
    """Mean score over the scored words of each response."""
    return scored.where(F.col("score").isNotNull()).groupBy(row_id).agg(F.avg("score").alias(out))


def response_mean_score_strict(scored: DataFrame, row_id: str, out: str = "avg_sm_score") -> DataFrame:
    """Mean score per response; null if any of its words has no score."""
    known = scored.where(F.col("word").isNotNull())
    return known.groupBy(row_id).agg(num.strict_mean("score").alias(out))


def attach_response_score(responses: DataFrame, scores: DataFrame, row_id: str, min_words: int | None = 1) -> DataFrame:
    """Responses with more than ``min_words`` words, their score, and no null in any column."""
    joined = responses.join(scores, row_id, "left")
    if min_words is not None:
        joined = joined.where(F.col("word_count") > min_words)
    return joined.na.drop("any")


def mean_by(df: DataFrame, value: str, *by: str, out: str = "m") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(out))


def sum_by(df: DataFrame, value: str, *by: str, out: str = "total") -> DataFrame:
    """Height of bars stacked over rows."""
    return df.groupBy(*by).agg(F.sum(value).alias(out))


def segment_polarity(polar_counts: DataFrame, segment: str = "segment", fill: int | None = None) -> DataFrame:
    """Rows of the polar count table per sentiment, their difference and its ratio.

    A side without rows is null, or ``fill``. The rows are counted through n, so
    that a plan which also uses the counts shares their shuffle.
    """
    wide = polar_counts.groupBy(segment).pivot("sentiment", ["positive", "negative"]).agg(F.count_if(F.col("n") > 0))
    if fill is not None:
        wide = wide.fillna(fill, subset=["positive", "negative"])
    wide = wide.withColumn("polarity", F.col("positive") - F.col("negative"))
    return wide.withColumn("ratio", num.ratio("polarity", F.col("positive") + F.col("negative")))


def attach_segment_polarity(counts: DataFrame, polarity: DataFrame, segment: str = "segment") -> DataFrame:
    """Word counts next to the polarity of their segment, with a sign label; a null word drops out."""
    rows = attach(counts.where(F.col("word").isNotNull()), polarity, segment, "left", SALTS)
    return rows.withColumn("sentiment", num.sign_label("positive", "negative"))


def segment_polarity_bar(counts: DataFrame, polarity: DataFrame, segment: str = "segment") -> DataFrame:
    """Polarity summed over the word rows of each segment.

    Rows are counted per segment before the join, which therefore joins one row
    per segment instead of every word row.
    """
    known = counts.where(F.col("word").isNotNull())
    rows = known.groupBy(segment).agg(F.count_if(F.col("n") > 0).alias("_rows"))
    joined = attach(rows, polarity, segment, "left")
    return joined.select(
        segment, num.sign_label("positive", "negative").alias("sentiment"), (F.col("polarity") * F.col("_rows")).alias("polarity")
    )


# --- sentences --------------------------------------------------------------

#: Numbers of 64 bits in a sieve of lexicon words: with ten thousand words, one other word in a hundred passes.
SIEVE_SLOTS = 2048


@dataclass(frozen=True)
class Shifters:
    """Word lists that change the weight of a polar word near them."""

    negators: Sequence[str] = field(default_factory=tuple)
    amplifiers: Sequence[str] = field(default_factory=tuple)
    deamplifiers: Sequence[str] = field(default_factory=tuple)
    adversatives: Sequence[str] = field(default_factory=tuple)

    def by_code(self) -> dict[str, list[str]]:
        """The lists by a one-letter code; a word must not be in two of them."""
        lists = {"n": self.negators, "a": self.amplifiers, "d": self.deamplifiers, "b": self.adversatives}
        coded = {code: sorted(set(words)) for code, words in lists.items()}
        if len({w for words in coded.values() for w in words}) < sum(map(len, coded.values())):
            raise ValueError("a word is in two shifter lists")
        return coded


def _count(codes: Column, code: str) -> Column:
    """How often a code letter occurs in a string of codes."""
    return F.char_length(F.translate(codes, ".nadb".replace(code, ""), "")).cast("double")


def split_sentences(responses: DataFrame, row_id: str, text: str, *more: str, abbreviations: DataFrame | None = None) -> DataFrame:
    """(row_id, more..., sentence_id, sentence, clauses): sentences in text order, clauses as word arrays.

    With an abbreviation table, periods of its words and in decimals end no sentence.
    """
    if abbreviations is None:
        rows = responses.select(row_id, *more, F.posexplode(tx.sentence_array(text)).alias("_p", "sentence"))
    else:
        known = responses.withColumn("_known", abbreviation_list(abbreviations))
        rows = known.select(row_id, *more, F.posexplode(tx.bounded_sentences(text, F.col("_known"))).alias("_p", "sentence"))
    clauses = F.transform(tx.clause_array("sentence"), tx.word_array)
    return rows.select(row_id, *more, (F.col("_p") + 1).cast("long").alias("sentence_id"), "sentence", clauses.alias("clauses"))


def _shifted(weight: Column, before: Column, after: Column) -> Column:
    """Weight of a polar word under the codes around it."""
    near = F.concat(before, after)
    neg = _count(near, "n") % 2
    amp, deamp = _count(near, "a"), _count(near, "d")
    turn = _count(before, "b") - _count(after, "b")
    up = SHIFT_WEIGHT * amp * (1.0 - neg)
    down = F.greatest(-SHIFT_WEIGHT * (amp * neg + deamp), F.lit(-1.0))
    return weight * (1.0 + up + down) * (1.0 + ADVERSATIVE_WEIGHT * turn) * (1.0 - 2.0 * neg)


def _around(codes: Column, i: Column) -> tuple[Column, Column]:
    """Codes of the five words before and the two words after place ``i``."""
    first = F.greatest(i - WORDS_BEFORE, F.lit(0))
    return F.substring(codes, first + 1, i - first), F.substring(codes, i + 2, F.lit(WORDS_AFTER))


def _places(word: Column) -> list[Column]:
    """The bits of a word in a sieve: slot and bit in it, from three parts of one hash."""
    h = F.xxhash64(word)
    bits = [F.pmod(F.shiftright(h, 20 * k), F.lit(64 * SIEVE_SLOTS)) for k in range(3)]
    return [F.struct(F.shiftright(b, 6).cast("int").alias("slot"), b.bitwiseAND(F.lit(63)).cast("int").alias("bit")) for b in bits]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def word_sieve(lexicon: DataFrame, word: str = "word") -> Column:
    """Bloom filter of a table's words, an array of ``SIEVE_SLOTS`` numbers of 64 bits, whatever the size of the table."""
    marks = lexicon.where(F.col(word).isNotNull()).select(F.inline(F.array(*_places(F.col(word)))))
    slots = marks.groupBy("slot").agg(F.bit_or(_one(F.col("bit"))).alias("mask"))
    filled = F.map_from_entries(F.collect_list(F.struct("slot", "mask")))  # at most SIEVE_SLOTS
    return slots.agg(filled.alias("_f")).select(F.transform(
        F.sequence(F.lit(0), F.lit(SIEVE_SLOTS - 1)), lambda k: F.coalesce(F.try_element_at("_f", k), F.lit(0).cast("long"))
    ).alias("sieve")).scalar()


def passes(sieve: Column, word: Column) -> Column:
    """False only for words that the sieve's table does not have."""
    return F.forall(F.array(*_places(word)), lambda p: F.get(sieve, p["slot"]).bitwiseAND(_one(p["bit"])) != 0)


def sentence_sentiment(responses: DataFrame, row_id: str, text: str, polarity: Mapping[str, float] | DataFrame, shifters: Shifters,
                       abbreviations: DataFrame | None = None, sieve: bool = False) -> DataFrame:
    """(row_id, sentence_id, word_count, sentiment) for each sentence of each row.

    A clause is written as a string with one code letter per word, and a polar word
    is weighed by the codes of the five words before and the two words after it. With
    a mapping of words to weights everything happens inside the sentence, without any
    shuffle. With a (word, weight) table words leave their sentence with the codes
    around them, the join keeps the polar ones, and their sums are shuffled. With
    ``sieve`` only words that a Bloom filter of the table lets pass leave: dearer where
    Spark broadcasts the table, cheaper where the words would be shuffled to it. Rows are told apart by place, so ``row_id`` may
    repeat or be null. ``abbreviations`` is a table of words whose periods end no sentence.
    """
    coded = shifters.by_code()

    def code_of(word: Column) -> Column:
        return F.coalesce(*[F.when(word.isin(words), code) for code, words in coded.items() if words], F.lit("."))

    codes = F.transform("clauses", lambda clause: F.array_join(F.transform(clause, code_of), ""))
    n_words = F.aggregate("clauses", F.lit(0), lambda acc, c: acc + F.size(c)).cast("long")
    score = lambda total: F.when(F.col("word_count") > 0, total / F.sqrt(F.col("word_count").cast("double"))).otherwise(0.0)

    if isinstance(polarity, Mapping):
        split = split_sentences(responses, row_id, text, abbreviations=abbreviations).withColumn("codes", codes)
        weights = F.create_map(*[F.lit(v) for word, weight in polarity.items() for v in (word, float(weight))]) if polarity else None

        def weighed(clause: Column, codes: Column) -> Column:
            return F.transform(clause, lambda word, i: F.coalesce(_shifted(weights[word], *_around(codes, i)), F.lit(0.0)))

        total = F.lit(0.0)
        if polarity:
            total = F.aggregate(F.flatten(F.zip_with("clauses", "codes", weighed)), F.lit(0.0), lambda acc, w: acc + w)
        sums = split.select(row_id, "sentence_id", n_words.alias("word_count"), total.alias("_s"))
        return sums.select(row_id, "sentence_id", "word_count", score(F.col("_s")).alias("sentiment"))

    def with_context(clause: Column, codes: Column) -> Column:
        def near(word: Column, i: Column) -> Column:
            before, after = _around(codes, i)
            return F.struct(word.alias("word"), before.alias("before"), after.alias("after"))

        return F.transform(clause, near)

    # One extra row per sentence carries its word count and keeps sentences without
    # a polar word. Its key starts with a blank, so it matches no lexicon word, and
    # it differs by row, so it is not a hot key if the join is shuffled.
    numbered = responses.withColumn("_row", F.monotonically_increasing_id())
    split = split_sentences(numbered, row_id, text, "_row", abbreviations=abbreviations).withColumn("codes", codes)
    nothing = F.lit("")
    marker = F.struct(F.concat(F.lit(" "), F.col("_row").cast("string")).alias("word"), nothing.alias("before"), nothing.alias("after"))
    possible = F.flatten(F.zip_with("clauses", "codes", with_context))
    if sieve:
        split = split.withColumn("_sieve", word_sieve(polarity))
        possible = F.filter(possible, lambda near: passes(F.col("_sieve"), near["word"]))
    contexts = split.select(
        row_id, "_row", "sentence_id", n_words.alias("_n"), F.inline(F.concat(F.array(marker), possible))
    )
    lexicon = polarity.select(F.col("word"), F.col("weight").cast("double").alias("_p"))
    is_marker = F.col("word").startswith(" ")
    rows = contexts.join(lexicon, "word", "left").where(is_marker | F.col("_p").isNotNull())
    sums = rows.groupBy("_row", row_id, "sentence_id").agg(
        F.sum(F.when(is_marker, F.col("_n")).otherwise(0)).alias("word_count"),
        F.sum(F.when(is_marker, F.lit(0.0)).otherwise(_shifted(F.col("_p"), F.col("before"), F.col("after")))).alias("_s"),
    )
    return sums.select(row_id, "sentence_id", "word_count", score(F.col("_s")).alias("sentiment"))


def attach_sentences(responses: DataFrame, sentences: DataFrame, row_id: str, element_id: str | None = None) -> DataFrame:
    """Responses left join their sentences, which may go by another key name."""
    element_id = element_id or row_id
    return responses.join(sentences.withColumnRenamed(element_id, "_e"), F.col(row_id) == F.col("_e"), "left").drop("_e")


def quote_study(responses: DataFrame, row_id: str, text: str, polarity: Mapping[str, float] | DataFrame, shifters: Shifters,
                abbreviations: DataFrame | None = None) -> DataFrame:
    """(row_id, sentence_id, sentence, characters, word_count, sentiment): every sentence in lower case, its length without extra blanks, its score.

    ``row_id`` must be unique; its null stands for one response.
    """
    scores = sentence_sentiment(responses, row_id, text, polarity, shifters, abbreviations)
    sentences = split_sentences(responses, row_id, text, abbreviations=abbreviations)
    lines = sentences.select(row_id, "sentence_id", F.lower("sentence").alias("sentence"), tx.squeezed_char_length("sentence").alias("characters"))
    return attach(lines, scores, [row_id, "sentence_id"], "left")


def sentiment_by_response(sentences: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Word count, sd and zero-down-weighted mean of sentence scores per response or group."""
    s = F.col("sentiment")
    zeros = F.count_if(s == 0).cast("double")
    weight = F.count_if(s != 0) + F.sqrt(F.ln(1.0 + zeros))
    return sentences.groupBy(*names(by)).agg(
        F.sum("word_count").alias("word_count"),
        F.stddev_samp(s).alias("sd"),
        F.coalesce(F.sum(s) / F.nullif(weight, F.lit(0.0)), F.lit(0.0)).alias("ave_sentiment"),
    )
