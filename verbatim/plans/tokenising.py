"""Queries for tokenisers and the joins that filter tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatim.functions import text as tx
from verbatim.operators import bounds as bd, counts as ct, sentiment as sn, tokens as tk
from verbatim.plans.base import ENGLISH, gram_list, query, stop_frame, table, tokens

_SENTENCES = (
    r"list_filter(list_transform(regexp_extract_all({0}, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')),"
    " lambda s: s <> '')"
)


_WORD_PIECE = tx.WORD_PIECE.replace("'", "''")
#: Abbreviations learned from the documents, and their sentences cut with them.
LEARNED = (
    r""", marked AS (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: {'p': p[i], 'after': p[i + 1]})) AS m FROM (
  SELECT list_filter(string_split_regex(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT lower(regexp_extract(m.p, '@piece', 1)) AS word, regexp_extract(m.p, '@piece', 2) = '.' AS dot, m.after AS after FROM marked),
perioded AS (SELECT word, count_if(dot) AS with_period, count_if(NOT dot) AS without, count_if(dot AND coalesce(regexp_matches(after, '^[\p{Ll}]'), false)) AS small_after
  FROM worded WHERE word <> '' GROUP BY word),
shared AS (SELECT CAST(sum(with_period) AS DOUBLE) / sum(with_period + without) AS share FROM perioded),
sized AS (SELECT *, length(word) - length(replace(word, '.', '')) AS inside FROM perioded, shared WHERE with_period >= 3),
rated AS (SELECT word, with_period, without, small_after, 2e0 * ((with_period * ln(@keepse0) + without * ln(1e0 - @keepse0))
  - (with_period * ln(share) + without * ln(1e0 - share))) * exp(-CAST(length(word) - inside AS DOUBLE)) * (inside + 1)
  * pow(CAST(length(word) - inside AS DOUBLE), -CAST(without AS DOUBLE)) AS score FROM sized),
short AS MATERIALIZED (SELECT * FROM rated WHERE score >= @sure OR (small_after * 2 >= with_period AND score >= @likely)),
hidden AS (SELECT doc_id, lang, source, list_transform(list_filter(list_transform(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(
    regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'),
    '[^ \t\n\f\r]+|[ \t\n\f\r]+'), lambda p: CASE WHEN list_contains(known, lower(regexp_extract(p, '@piece', 1))) THEN replace(p, '.', chr(57344)) ELSE p END), ''),
    '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda s: s <> ''), lambda s: replace(s, chr(57344), '.')) AS s
  FROM documents, (SELECT coalesce(list(word), []) AS known FROM short))
"""
    .replace("@piece", _WORD_PIECE).replace("@keeps", str(bd.KEEPS_PERIOD)).replace("@sure", str(bd.SURE)).replace("@likely", str(bd.LIKELY))
)


def _docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text")


@query("word_tokens", "SELECT doc_id, pos, word FROM tok")
def word_tokens(spark, sf):
    return tokens(spark, sf, "doc_id", stop=False, pos=True).withColumn("pos", F.col("pos").cast("long"))


@query("bigram_tokens", "SELECT doc_id, ngram FROM bi")
def bigram_tokens(spark, sf):
    return tk.ngrams(_docs(spark, sf), "text", 2)


@query("trigram_tokens", "SELECT doc_id, ngram FROM tri WHERE word_count > 1")
def trigram_tokens(spark, sf):
    many = _docs(spark, sf).where(tx.word_count("text") > 1)
    return tk.ngrams(many, "text", 3)


@query("sentence_tokens", f"SELECT item_id, unnest({_SENTENCES.format('lower(text)')}) AS sentence FROM benchmark")
def sentence_tokens(spark, sf):
    return tk.sentence_tokens(table(spark, sf, "benchmark", "item_id", "text"), "text")


@query(
    "sentence_split_scored",
    f"""SELECT doc_id, generate_subscripts(s, 1) AS sentence_id, unnest(s) AS sentence
    FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)""",
)
def sentence_split_scored(spark, sf):
    return sn.split_sentences(_docs(spark, sf), "doc_id", "text").drop("clauses")


@query("abbreviations", LEARNED + "SELECT word, with_period, without, small_after, round(score, 6) AS score FROM short")
def abbreviations(spark, sf):
    """Words of the documents whose periods end no sentence."""
    return bd.abbreviations(_docs(spark, sf), "text").withColumn("score", F.round("score", 6))


@query("period_counts", LEARNED + "SELECT * FROM perioded")
def period_counts(spark, sf):
    return bd.period_counts(_docs(spark, sf), "text")


@query("sentence_tokens_learned", LEARNED + "SELECT doc_id, generate_subscripts(s, 1) AS sentence_id, unnest(list_transform(s, lambda x: lower(x))) AS sentence FROM hidden")
def sentence_tokens_learned(spark, sf):
    """Sentences of the documents, cut by what was learned from them."""
    docs = _docs(spark, sf)
    return bd.learned_sentences(docs, "text", bd.abbreviations(docs, "text"), sentence_id="sentence_id")


@query("sentence_split_learned", LEARNED + "SELECT doc_id, generate_subscripts(s, 1) AS sentence_id, unnest(s) AS sentence FROM hidden")
def sentence_split_learned(spark, sf):
    docs = _docs(spark, sf)
    return sn.split_sentences(docs, "doc_id", "text", abbreviations=bd.abbreviations(docs, "text")).drop("clauses")


@query("rejoin_tokens", "SELECT doc_id, array_to_string(words, ' ') AS no_stop_text FROM kept WHERE len(words) > 0")
def rejoin_tokens(spark, sf):
    return tk.rejoined_text(_docs(spark, sf), "text", ENGLISH)


@query("bigram_tokens_no_stop", "SELECT doc_id, ngram FROM binostop")
def bigram_tokens_no_stop(spark, sf):
    return tk.ngrams(_docs(spark, sf), "text", 2, stop_words=ENGLISH)


@query("trigram_tokens_no_stop", "SELECT doc_id, ngram FROM trinostop")
def trigram_tokens_no_stop(spark, sf):
    return tk.ngrams(_docs(spark, sf), "text", 3, stop_words=ENGLISH)


@query("ngrams_over_tokens", "SELECT doc_id, lang, ngram FROM trinostop")
def ngrams_over_tokens(spark, sf):
    words = tokens(spark, sf, "doc_id", "lang", pos=True)
    return tk.ngrams_over_tokens(words, ["doc_id", "lang"], 3)


_NO_STOP_PARTS = """FROM (SELECT doc_id, ngram AS bigram, word1 AS first, word2 AS second FROM halves)
    WHERE first NOT IN (SELECT word FROM stops) AND second NOT IN (SELECT word FROM stops)"""
_STOPS_CTE = ", stops AS (SELECT unnest([" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]) AS word) "


@query(
    "bigrams_no_stopword_parts",
    _STOPS_CTE + "SELECT doc_id, bigram, first, second " + _NO_STOP_PARTS
    + " AND regexp_matches(first, '[a-z]') AND regexp_matches(second, '[a-z]')",
)
def bigrams_no_stopword_parts(spark, sf):
    bigrams = tk.ngrams(_docs(spark, sf), "text", 2, out="bigram")
    return tk.bigrams_without_stop_parts(bigrams, stop_frame(spark))


@query("remove_stopwords", "SELECT doc_id, word FROM nostop")
def remove_stopwords(spark, sf):
    return tk.remove_stop_words(tokens(spark, sf, "doc_id", stop=False), stop_frame(spark))


@query("anti_join_two_keys", _STOPS_CTE + "SELECT first, second, count(*) AS n " + _NO_STOP_PARTS + " GROUP BY ALL")
def anti_join_two_keys(spark, sf):
    halves = F.split("ngram", " ")
    parts = tk.ngrams(_docs(spark, sf), "text", 2, keep_short=False).select(
        "doc_id", F.get(halves, 0).alias("first"), F.get(halves, 1).alias("second")
    )
    stops = stop_frame(spark)
    kept = tk.remove_stop_words(tk.remove_stop_words(parts, stops, "first"), stops, "second")
    return ct.count_by(kept, "first", "second")
