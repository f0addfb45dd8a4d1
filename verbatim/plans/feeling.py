"""Queries for lexicon and sentence sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatim.operators import bounds as bd, counts as ct, sentiment as sn
from verbatim.plans.base import (
    NEUTRAL, NEW_POLARITY, NEW_SCORES, POLARITY, SHIFTERS, polarity, query, rounded, scores, surveys, table, tokens, weights,
)
from verbatim.plans.tokenising import LEARNED


# --- lexicon joins ----------------------------------------------------------

@query("join_polarity", "SELECT doc_id, word, sentiment FROM nostop JOIN pol USING (word)")
def join_polarity(spark, sf):
    return sn.join_polarity(tokens(spark, sf, "doc_id"), polarity(spark))


@query("join_scores_inner", "SELECT lang, word, n, score FROM (SELECT lang, word, count(*) AS n FROM nostop GROUP BY ALL) JOIN sco USING (word)")
def join_scores_inner(spark, sf):
    return sn.join_scores(ct.count_by(tokens(spark, sf, "lang"), "lang", "word"), scores(spark), "inner")


@query("join_scores_left", "SELECT doc_id, word, score FROM nostop LEFT JOIN sco USING (word)")
def join_scores_left(spark, sf):
    return sn.join_scores(tokens(spark, sf, "doc_id"), scores(spark))


# --- word polarity ----------------------------------------------------------

@query("polarity_word_counts", "SELECT word, sentiment, count(*) AS n FROM nostop JOIN pol USING (word) GROUP BY ALL")
def polarity_word_counts(spark, sf):
    return sn.polarity_word_counts(tokens(spark, sf), polarity(spark))


def _polar(spark, sf):
    return sn.polarity_word_counts(tokens(spark, sf, "segment", "device"), polarity(spark), "segment", "device")


@query("polarity_word_counts_by", "SELECT * FROM polar")
def polarity_word_counts_by(spark, sf):
    return _polar(spark, sf)


@query(
    "score_word_counts",
    "SELECT word, score, count(*) AS n FROM (SELECT DISTINCT doc_id, word FROM nostop) JOIN sco USING (word) GROUP BY ALL",
)
def score_word_counts(spark, sf):
    per_row = ct.count_by(tokens(spark, sf, "doc_id", cells=True), "doc_id", "word", weight="times", alone="alone")
    return sn.score_word_counts(per_row, scores(spark))


@query(
    "lexicon_coverage",
    """SELECT count(DISTINCT CASE WHEN score IS NULL THEN word END) AS unscored, count(DISTINCT CASE WHEN score IS NOT NULL THEN word END) AS scored,
    count(DISTINCT word) AS total FROM nostop LEFT JOIN sco USING (word)""",
)
def lexicon_coverage(spark, sf):
    return ct.lexicon_coverage(sn.join_scores(ct.count_by(tokens(spark, sf), "word"), scores(spark)))


@query(
    "override_polarity",
    """SELECT word, CASE WHEN word = 'thon' THEN 'negative' ELSE sentiment END AS sentiment, segment, device, n FROM polar
    WHERE word <> 'thor'""",
)
def override_polarity(spark, sf):
    return sn.override_polarity(_polar(spark, sf), NEW_POLARITY, NEUTRAL)


@query(
    "override_scores",
    """SELECT word, CASE WHEN word = 'thon' THEN -1 ELSE score END AS score, count(*) AS n FROM nostop JOIN sco USING (word) GROUP BY ALL""",
)
def override_scores(spark, sf):
    counts = ct.count_by(tokens(spark, sf), "word")
    return sn.join_scores(counts, sn.override_scores(scores(spark), NEW_SCORES), "inner")


@query(
    "top_words_by_sentiment",
    """SELECT word, sentiment, count(*) AS n FROM nostop JOIN pol USING (word)
    GROUP BY word, sentiment QUALIFY rank() OVER (PARTITION BY sentiment ORDER BY count(*) DESC) <= 5""",
)
def top_words_by_sentiment(spark, sf):
    return sn.top_words_by_sentiment(polarity_word_counts(spark, sf), 5)


@query(
    "top_polar_words_by_segment",
    """SELECT * FROM polar WHERE sentiment = 'positive' QUALIFY rank() OVER (PARTITION BY segment ORDER BY n DESC) <= 5
    UNION ALL SELECT * FROM (SELECT * FROM polar WHERE sentiment = 'negative' AND n > 1
    QUALIFY rank() OVER (PARTITION BY segment ORDER BY n DESC) <= 5)""",
)
def top_polar_words_by_segment(spark, sf):
    counts = _polar(spark, sf)
    good = sn.top_polar_words(counts, "positive", "segment", 5)
    return good.unionByName(sn.top_polar_words(counts, "negative", "segment", 5, more_than=1))


# --- responses and segments -------------------------------------------------

def _scored_tokens(spark, sf):
    return sn.join_scores(tokens(spark, sf, "doc_id"), scores(spark))


@query("response_mean_score", "SELECT doc_id, round(avg_sm_score, 9) AS avg_sm_score FROM resp")
def response_mean_score(spark, sf):
    return rounded(sn.response_mean_score(_scored_tokens(spark, sf), "doc_id"), "avg_sm_score", digits=9)


@query(
    "response_mean_score_strict",
    """SELECT doc_id, round(CASE WHEN count(score) = count(*) THEN avg(score) END, 9) AS avg_sm_score
    FROM nostop LEFT JOIN sco USING (word) GROUP BY doc_id""",
)
def response_mean_score_strict(spark, sf):
    return rounded(sn.response_mean_score_strict(_scored_tokens(spark, sf), "doc_id"), "avg_sm_score", digits=9)


def scored_responses(spark, sf):
    """Multi-word responses with a score."""
    responses = surveys(spark, sf)
    return sn.attach_response_score(responses, sn.response_mean_score(_scored_tokens(spark, sf), "doc_id"), "doc_id")


@query("attach_response_score", "SELECT doc_id, lang, segment, word_count, round(avg_sm_score, 9) AS avg_sm_score FROM scored")
def attach_response_score(spark, sf):
    out = scored_responses(spark, sf).select("doc_id", "lang", "segment", "word_count", "avg_sm_score")
    return rounded(out, "avg_sm_score", digits=9)


@query("segment_mean_score", "SELECT segment_name, device, round(avg(avg_sm_score), 6) AS m FROM scored GROUP BY ALL")
def segment_mean_score(spark, sf):
    return rounded(sn.mean_by(scored_responses(spark, sf), "avg_sm_score", "segment_name", "device"), "m")


@query("stacked_score_sum", "SELECT segment, device, round(sum(avg_sm_score), 6) AS total FROM scored GROUP BY ALL")
def stacked_score_sum(spark, sf):
    return rounded(sn.sum_by(scored_responses(spark, sf), "avg_sm_score", "segment", "device"), "total")


@query("segment_polarity", "SELECT * FROM segpolarity")
def segment_polarity(spark, sf):
    return sn.segment_polarity(_polar(spark, sf))


def _word_counts(spark, sf):
    return ct.count_by(tokens(spark, sf, "segment", "device"), "word", "segment", "device")


_ROWS = "(SELECT word, segment, device, count(*) AS n FROM nostop GROUP BY ALL)"
_SIGN = "CASE WHEN positive > negative THEN 'positive' WHEN positive <= negative THEN 'negative' END AS sentiment"


@query("attach_segment_polarity", f"SELECT word, segment, device, n, positive, negative, polarity, ratio, {_SIGN} FROM {_ROWS} LEFT JOIN segpolarity USING (segment)")
def attach_segment_polarity(spark, sf):
    counts = _word_counts(spark, sf)
    return sn.attach_segment_polarity(counts, sn.segment_polarity(sn.join_polarity(counts, polarity(spark))))


@query(
    "segment_polarity_bar",
    f"SELECT segment, {_SIGN}, sum(polarity)::BIGINT AS polarity FROM {_ROWS} LEFT JOIN segpolarity USING (segment) GROUP BY ALL",
)
def segment_polarity_bar(spark, sf):
    counts = _word_counts(spark, sf)
    return sn.segment_polarity_bar(counts, sn.segment_polarity(sn.join_polarity(counts, polarity(spark))))


# --- sentences --------------------------------------------------------------

_TOKEN_SQL = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"
_SENTENCE_SQL = rf""", sents AS (SELECT doc_id, lang, source, generate_subscripts(s, 1) AS sentence_id, unnest(s) AS sentence FROM (
  SELECT doc_id, lang, source, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
    lambda s: regexp_replace(s, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda s: s <> '') AS s FROM documents)),
clauses AS (SELECT doc_id, sentence_id, generate_subscripts(c, 1) AS clause_id, unnest(c) AS clause FROM (
  SELECT doc_id, sentence_id, regexp_extract_all(sentence, '[^,;:]+') AS c FROM sents)),
sw AS (SELECT doc_id, sentence_id, clause_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (
  SELECT *, regexp_extract_all(lower(clause), '{_TOKEN_SQL}') AS w FROM clauses)),
flags AS (SELECT *, CASE WHEN word IN ('no', 'is') THEN 1 ELSE 0 END AS ng, CASE WHEN word = 'with' THEN 1 ELSE 0 END AS am,
  CASE WHEN word = 'by' THEN 1 ELSE 0 END AS dm, CASE WHEN word = 'for' THEN 1 ELSE 0 END AS av FROM sw),
near AS (SELECT doc_id, sentence_id, word,
  (coalesce(sum(ng) OVER b, 0) + coalesce(sum(ng) OVER a, 0)) % 2 AS neg, coalesce(sum(am) OVER b, 0) + coalesce(sum(am) OVER a, 0) AS amp,
  coalesce(sum(dm) OVER b, 0) + coalesce(sum(dm) OVER a, 0) AS deamp, coalesce(sum(av) OVER b, 0) - coalesce(sum(av) OVER a, 0) AS turn
  FROM flags WINDOW b AS (PARTITION BY doc_id, sentence_id, clause_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  a AS (PARTITION BY doc_id, sentence_id, clause_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
hits AS (SELECT doc_id, sentence_id, (CASE sentiment WHEN 'positive' THEN 1e0 ELSE -1e0 END)
  * (1e0 + 0.8e0 * amp * (1 - neg) + greatest(-0.8e0 * (amp * neg + deamp), -1e0)) * (1e0 + 0.25e0 * turn) * (1e0 - 2e0 * neg) AS s
  FROM near JOIN pol USING (word)),
sizes AS (SELECT doc_id, sentence_id, count(*) AS n FROM sw GROUP BY ALL),
sums AS (SELECT doc_id, sentence_id, sum(s) AS s FROM hits GROUP BY ALL),
scores AS (SELECT doc_id, lang, source, sentence_id, coalesce(n, 0) AS word_count, coalesce(s / sqrt(CAST(n AS DOUBLE)), 0) AS sentiment
  FROM sents LEFT JOIN sizes USING (doc_id, sentence_id) LEFT JOIN sums USING (doc_id, sentence_id))
"""


def _sentences(spark, sf, listed=False):
    """Scores of all sentences: by a mapping inside the sentence, or by a joined lexicon table."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    lexicon = {w: 1.0 if s == "positive" else -1.0 for w, s in POLARITY.items()} if listed else weights(spark)
    return sn.sentence_sentiment(docs, "doc_id", "text", lexicon, SHIFTERS)


@query("sentence_sentiment", _SENTENCE_SQL + "SELECT doc_id, sentence_id, word_count, round(sentiment, 6) AS sentiment FROM scores")
def sentence_sentiment(spark, sf):
    return rounded(_sentences(spark, sf, listed=True), "sentiment")


_LEARNED_SQL = LEARNED + ", sents AS (SELECT doc_id, lang, source, generate_subscripts(s, 1) AS sentence_id, unnest(s) AS sentence FROM hidden)" + (
    _SENTENCE_SQL[_SENTENCE_SQL.index(",\nclauses AS") :]
)


@query("sentence_sentiment_learned", _LEARNED_SQL + "SELECT doc_id, sentence_id, word_count, round(sentiment, 6) AS sentiment FROM scores")
def sentence_sentiment_learned(spark, sf):
    """Scores of sentences whose bounds were learned from the documents."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    found = bd.abbreviations(docs, "text")
    return rounded(sn.sentence_sentiment(docs, "doc_id", "text", weights(spark), SHIFTERS, abbreviations=found, sieve=True), "sentiment")


@query(
    "quote_study",
    _SENTENCE_SQL + r"""SELECT doc_id, sentence_id, lower(s.sentence) AS sentence, length(regexp_replace(s.sentence, '[ \t\n\f\r]+', ' ', 'g')) AS characters,
    word_count, round(sentiment, 6) AS sentiment FROM sents s JOIN scores USING (doc_id, sentence_id)""",
)
def quote_study(spark, sf):
    """Sentences with length and score in one call."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    return rounded(sn.quote_study(docs, "doc_id", "text", weights(spark), SHIFTERS), "sentiment")


def _with_sentences(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "lang", "source")
    sentences = _sentences(spark, sf).withColumnRenamed("doc_id", "element_id")
    return sn.attach_sentences(docs, sentences, "doc_id", "element_id")


@query(
    "attach_sentences",
    _SENTENCE_SQL + """SELECT d.doc_id, d.lang, d.source, s.sentence_id, s.word_count, round(s.sentiment, 6) AS sentiment
    FROM documents d LEFT JOIN scores s ON d.doc_id = s.doc_id""",
)
def attach_sentences(spark, sf):
    return rounded(_with_sentences(spark, sf), "sentiment")


@query("sentence_mean_by", _SENTENCE_SQL + "SELECT source, round(avg(sentiment), 6) AS mean FROM scores GROUP BY source")
def sentence_mean_by(spark, sf):
    return rounded(sn.mean_by(_with_sentences(spark, sf), "sentiment", "source", out="mean"), "mean")


@query(
    "attach_responses_to_means",
    _SENTENCE_SQL + """SELECT doc_id, round(mean, 6) AS mean, lang, source FROM (SELECT doc_id, avg(sentiment) AS mean FROM scores GROUP BY doc_id)
    LEFT JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)""",
)
def attach_responses_to_means(spark, sf):
    means = sn.mean_by(_sentences(spark, sf), "sentiment", "doc_id", out="mean")
    docs = table(spark, sf, "documents", "doc_id", "lang", "source")
    return rounded(means.join(docs, "doc_id", "left"), "mean")


@query(
    "sentiment_by_response",
    _SENTENCE_SQL + """SELECT doc_id, sum(word_count)::BIGINT AS word_count, round(stddev_samp(sentiment), 6) AS sd,
    round(coalesce(sum(sentiment) / nullif(count_if(sentiment <> 0) + sqrt(ln(1 + count_if(sentiment = 0))), 0), 0), 6) AS ave_sentiment
    FROM scores GROUP BY doc_id""",
)
def sentiment_by_response(spark, sf):
    return rounded(sn.sentiment_by_response(_sentences(spark, sf), "doc_id"), "sd", "ave_sentiment")
