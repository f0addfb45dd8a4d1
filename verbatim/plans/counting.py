"""Queries for counts, top-k, order, tf-idf, bigram networks and word contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatim.functions import text as tx
from verbatim.operators import clean as cl, contrast as cn, counts as ct, keyed, network as nw, reshape as rs, tfidf as ti, tokens as tk, topn as tn
from verbatim.plans.base import ENGLISH, TARGETS, polarity, query, role_tokens, rounded, surveys, table, tokens
from verbatim.operators.sentiment import polarity_word_counts
from verbatim.plans.cleaning import _CLEAN


# --- counts -----------------------------------------------------------------

@query("word_counts", "SELECT word, count(*) AS n FROM nostop GROUP BY word")
def word_counts(spark, sf):
    return ct.count_by(tokens(spark, sf), "word")


@query("word_counts_by", "SELECT word, segment, segment_name, device, count(*) AS n FROM nostop GROUP BY ALL")
def word_counts_by(spark, sf):
    return ct.count_by(tokens(spark, sf, "segment", "segment_name", "device"), "word", "segment", "segment_name", "device")


@query("word_counts_ignoring_dim", "SELECT word, lang, count(*) AS n FROM nostop GROUP BY ALL")
def word_counts_ignoring_dim(spark, sf):
    finer = ct.count_by(tokens(spark, sf, "lang", "source"), "word", "lang", "source")
    return ct.count_by(finer, "word", "lang", weight="n")


@query("ngram_counts", "SELECT ngram, count(*) AS n FROM bi GROUP BY ngram")
def ngram_counts(spark, sf):
    return ct.count_by(tk.ngrams(table(spark, sf, "documents", "text"), "text", 2), "ngram")


@query("ngram_counts_by", "SELECT ngram, segment, count(*) AS n FROM binostop GROUP BY ALL")
def ngram_counts_by(spark, sf):
    docs = surveys(spark, sf).select("segment", "text")
    return ct.count_by(tk.ngrams(docs, "text", 2, stop_words=ENGLISH), "ngram", "segment")


@query("total_rows", "SELECT count(*) AS n, count(*) - count(useful) AS useful_null, count(useful) AS useful_not_null FROM marks")
def total_rows(spark, sf):
    from verbatim.plans.base import boxes

    return ct.total_rows(boxes(spark, sf), "useful")


@query("distinct_rows", "SELECT DISTINCT word, lang FROM nostop")
def distinct_rows(spark, sf):
    return tokens(spark, sf, "lang").select("word", "lang").distinct()


@query(
    "filtered_term_counts",
    """SELECT word, count(*) AS n FROM (SELECT DISTINCT word, lang, source, doc_id FROM nostop
    WHERE word NOT IN ('tion', 'la', 'le', 'un', 'que')) GROUP BY word""",
)
def filtered_term_counts(spark, sf):
    words = tokens(spark, sf, "lang", "source", "doc_id", cells=True)
    cells = ct.count_by(words, "word", "lang", "source", "doc_id", weight="times", alone="alone")
    return ct.count_by(cl.filter_not_in(cells, "word", ["tion", "la", "le", "un", "que"]), "word")


_ROLES = """(SELECT word, nullif(count_if(role = 'user'), 0) AS user_n, nullif(count_if(role = 'assistant'), 0) AS assistant_n
    FROM roles GROUP BY word)"""


def _role_counts(spark, sf):
    return ct.count_by(role_tokens(spark, sf), "word", "role")


@query("common_terms", f"SELECT * FROM {_ROLES} WHERE user_n IS NOT NULL AND assistant_n IS NOT NULL")
def common_terms(spark, sf):
    return ct.common_terms(_role_counts(spark, sf), "word", "role", "user", "assistant")


@query(
    "paired_counts",
    f"""SELECT *, abs(user_n - assistant_n) AS difference FROM {_ROLES} WHERE user_n IS NOT NULL AND assistant_n IS NOT NULL
    ORDER BY difference DESC, word LIMIT 25""",
)
def paired_counts(spark, sf):
    return ct.paired_counts(_role_counts(spark, sf), "word", "role", "user", "assistant", k=25)


@query(
    "mirrored_counts",
    """SELECT word, role, n, CASE WHEN role = 'assistant' THEN -n ELSE n END AS signed_n FROM (
    SELECT word, role, count(*) AS n FROM roles WHERE role <> 'system' GROUP BY ALL)
    QUALIFY rank() OVER (PARTITION BY role ORDER BY n DESC) <= 20""",
)
def mirrored_counts(spark, sf):
    both = _role_counts(spark, sf).where(F.col("role") != "system")
    return ct.mirrored_counts(both, "role", "assistant", k=20)


# --- top-k and order --------------------------------------------------------

_WORDS = "(SELECT word, count(*) AS n FROM nostop GROUP BY word)"
_BY_SOURCE = "(SELECT word, source, count(*) AS n FROM nostop GROUP BY ALL)"


def _by_source(spark, sf):
    return ct.count_by(tokens(spark, sf, "source"), "word", "source")


@query("top_n_global", f"SELECT * FROM {_WORDS} QUALIFY rank() OVER (ORDER BY n DESC) <= 25")
def top_n_global(spark, sf):
    return tn.top_n(word_counts(spark, sf), 25, "n")


@query("top_n_by_group", f"SELECT * FROM {_BY_SOURCE} QUALIFY rank() OVER (PARTITION BY source ORDER BY n DESC) <= 10")
def top_n_by_group(spark, sf):
    return tn.top_n(_by_source(spark, sf), 10, "n", by="source")


@query("top_n_distinct_rank", f"SELECT * FROM {_WORDS} ORDER BY n DESC, word DESC LIMIT 20")
def top_n_distinct_rank(spark, sf):
    return tn.top_n_exact(word_counts(spark, sf), 20, "word")


@query(
    "top_n_per_term_group",
    """SELECT * FROM (SELECT word, source, lang, segment, count(*) AS n FROM nostop GROUP BY ALL)
    QUALIFY rank() OVER (PARTITION BY source, word ORDER BY n DESC) <= 2""",
)
def top_n_per_term_group(spark, sf):
    counts = ct.count_by(tokens(spark, sf, "source", "lang", "segment"), "word", "source", "lang", "segment")
    return tn.top_n_per_term_group(counts, 2, "n", "source", "word")


@query(
    "top_facet_counts",
    f"""SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, word) AS ord, concat(word, '__', source) AS label FROM (
    SELECT * FROM {_BY_SOURCE} WHERE word IS NOT NULL QUALIFY rank() OVER (PARTITION BY source ORDER BY n DESC) <= 20)""",
)
def top_facet_counts(spark, sf):
    return tn.top_facets(_by_source(spark, sf), 20, "word", "source")


@query(
    "group_sum_keep_rows",
    """SELECT word, segment, source, sum(n) OVER (PARTITION BY word, source)::BIGINT AS n FROM (
    SELECT word, segment, source, count(*) AS n FROM nostop GROUP BY ALL)""",
)
def group_sum_keep_rows(spark, sf):
    finer = ct.count_by(tokens(spark, sf, "segment", "source"), "word", "segment", "source")
    return keyed.group_sum_keep_rows(finer, ["word", "source"])


@query(
    "collapse_repeated_labels",
    """SELECT CASE WHEN row_number() OVER (PARTITION BY source ORDER BY segment, device) = 1 THEN source ELSE '' END AS source,
    segment, device, n FROM (SELECT source, segment, device, count(*) AS n FROM survey GROUP BY ALL)""",
)
def collapse_repeated_labels(spark, sf):
    counts = ct.count_by(surveys(spark, sf), "source", "segment", "device")
    return tn.collapse_repeated_labels(counts, "source", ["segment", "device"])


@query("bar_order", f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, word) AS ord FROM {_BY_SOURCE}")
def bar_order(spark, sf):
    return tn.bar_order(_by_source(spark, sf), "word", facet="source")


@query("sort_desc", _WORDS[1:-1])
def sort_desc(spark, sf):
    return tn.sort_desc(word_counts(spark, sf), "n", "word")


@query("sort_group_then_desc", _BY_SOURCE[1:-1])
def sort_group_then_desc(spark, sf):
    return tn.sort_group_then_desc(_by_source(spark, sf), "source")


@query("sort_term_then_desc", _BY_SOURCE[1:-1])
def sort_term_then_desc(spark, sf):
    return tn.sort_group_then_desc(_by_source(spark, sf), "word")


@query(
    "order_by_position",
    f"""SELECT *, abs(user_n - assistant_n) AS difference FROM {_ROLES} WHERE user_n IS NOT NULL AND assistant_n IS NOT NULL""",
)
def order_by_position(spark, sf):
    both = common_terms(spark, sf).withColumn("difference", F.abs(F.col("user_n") - F.col("assistant_n")))
    fourth = both.columns[3]
    return tn.sort_desc(both, fourth, "word")


@query("head_limit", f"SELECT * FROM {_WORDS} ORDER BY n DESC, word LIMIT 6")
def head_limit(spark, sf):
    return tn.head_limit(word_counts(spark, sf), [F.desc("n"), F.asc("word")])


# --- tf-idf -----------------------------------------------------------------

def _tf_idf_sql(cells: str, document: str) -> str:
    return f"""(SELECT word, {document}, n, n / CAST(total AS DOUBLE) AS tf, ln(CAST(docs AS DOUBLE) / term_rows) AS idf,
    (n / CAST(total AS DOUBLE)) * ln(CAST(docs AS DOUBLE) / term_rows) AS tf_idf FROM (SELECT *, sum(n) OVER (PARTITION BY {document}) AS total,
    count(*) OVER (PARTITION BY word) AS term_rows, (SELECT count(DISTINCT {document}) FROM {cells}) AS docs FROM {cells}))"""


_LONG_WORDS = "(SELECT word, segment, count(*) AS n FROM nostop WHERE length(word) > 2 GROUP BY ALL)"
_ROUNDED = "SELECT word, {0}, n, round(tf, 12) AS tf, round(idf, 12) AS idf, round(tf_idf, 12) AS tf_idf FROM "


def _tf_idf(spark, sf):
    words = cl.filter_min_length(tokens(spark, sf, "segment"), "word", 2)
    return ti.tf_idf(ct.count_by(words, "word", "segment"), "word", "segment")


@query("tf_idf", _ROUNDED.format("segment") + _tf_idf_sql(_LONG_WORDS, "segment"))
def tf_idf(spark, sf):
    return rounded(_tf_idf(spark, sf), "tf", "idf", "tf_idf", digits=12)


_ROW_GRAIN = """(SELECT word, source, sum(n) OVER (PARTITION BY word, source)::BIGINT AS n FROM (
    SELECT word, source, segment, lang, count(*) AS n FROM nostop GROUP BY ALL))"""


@query("tf_idf_row_grain", _ROUNDED.format("source") + _tf_idf_sql(_ROW_GRAIN, "source"))
def tf_idf_row_grain(spark, sf):
    finer = ct.count_by(tokens(spark, sf, "source", "segment", "lang"), "word", "source", "segment", "lang")
    return rounded(ti.tf_idf(finer, "word", "source", dedupe=False), "tf", "idf", "tf_idf", digits=12)


@query(
    "top_tf_idf_by_group",
    _ROUNDED.format("segment")
    + f"(SELECT * FROM {_tf_idf_sql(_LONG_WORDS, 'segment')} WHERE n > 1 QUALIFY rank() OVER (PARTITION BY segment ORDER BY tf_idf DESC) <= 10)",
)
def top_tf_idf_by_group(spark, sf):
    best = tn.top_n(cl.filter_min_count(_tf_idf(spark, sf), 1), 10, "tf_idf", by="segment")
    return rounded(best, "tf", "idf", "tf_idf", digits=12)


# --- network ----------------------------------------------------------------

def _pairs(spark, sf):
    """Counted bigrams per segment with no stop word in either half."""
    docs = surveys(spark, sf).select("segment", "text")
    return ct.count_by(tk.pairs_without_stop_parts(docs, "text", ENGLISH), "word1", "word2", "segment")


@query("bigram_pair_counts", "SELECT word1, word2, count(*) AS n FROM pairs GROUP BY ALL")
def bigram_pair_counts(spark, sf):
    return nw.bigram_pair_counts(_pairs(spark, sf))


_EDGES = "(SELECT word1, word2, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) > 3)"


@query("bigram_edges", "SELECT * FROM " + _EDGES)
def bigram_edges(spark, sf):
    return nw.bigram_edges(_pairs(spark, sf), 3)


@query("bigram_edges_by_occurrence", "SELECT word1, word2, sum(n)::BIGINT AS n FROM pairs GROUP BY ALL HAVING sum(n) > 3")
def bigram_edges_by_occurrence(spark, sf):
    return nw.bigram_edges(_pairs(spark, sf), 3, weight="occurrences")


@query("bigram_vertices", f"SELECT word1 AS id FROM {_EDGES} UNION SELECT word2 FROM {_EDGES}")
def bigram_vertices(spark, sf):
    return nw.bigram_vertices(bigram_edges(spark, sf))


_TARGETS = ", ".join(f"'{t}'" for t in TARGETS)


@query(
    "words_after",
    f"""SELECT word1, word2, sum(n)::BIGINT AS n FROM pairs WHERE word1 IN ({_TARGETS}) AND word2 NOT IN ('hent')
    GROUP BY word1, word2 QUALIFY rank() OVER (PARTITION BY word1 ORDER BY sum(n) DESC) <= 10""",
)
def words_after(spark, sf):
    return nw.words_after(_pairs(spark, sf), TARGETS, exclude=["hent"], k=10)


@query(
    "words_before",
    f"""SELECT word1, word2, sum(n)::BIGINT AS n FROM pairs WHERE word2 IN ({_TARGETS})
    GROUP BY word1, word2 QUALIFY rank() OVER (ORDER BY sum(n) DESC) <= 20""",
)
def words_before(spark, sf):
    return nw.words_before(_pairs(spark, sf), TARGETS, k=20, per_target=False)


# --- contrast ---------------------------------------------------------------

@query(
    "comparison_terms",
    """SELECT word, CASE WHEN p >= q THEN 'positive' ELSE 'negative' END AS sentiment, round(greatest(p, q), 12) AS deviation FROM (
    SELECT word, a - (a + b) / 2 AS p, b - (a + b) / 2 AS q FROM (
    SELECT word, CAST(sum(CASE WHEN sentiment = 'positive' THEN n ELSE 0 END) AS DOUBLE) / (SELECT sum(n) FROM polar WHERE sentiment = 'positive') AS a,
    CAST(sum(CASE WHEN sentiment = 'negative' THEN n ELSE 0 END) AS DOUBLE) / (SELECT sum(n) FROM polar WHERE sentiment = 'negative') AS b
    FROM polar GROUP BY word)) ORDER BY greatest(p, q) DESC, word LIMIT 125""",
)
def comparison_terms(spark, sf):
    counts = polarity_word_counts(tokens(spark, sf), polarity(spark))
    return rounded(cn.comparison_terms(counts, "word", "sentiment", ["positive", "negative"]), "deviation", digits=12)


_LANGS = ["en", "de", "fr", "es"]


def _comparison_sql() -> str:
    rates = ", ".join(f"coalesce(CAST(count_if(lang = '{c}') AS DOUBLE) / nullif((SELECT count(*) FROM nostop WHERE lang = '{c}'), 0), 0) AS r{k}" for k, c in enumerate(_LANGS))
    mean = "((" + " + ".join(f"r{k}" for k in range(len(_LANGS))) + f") / {len(_LANGS)})"
    best = "greatest(" + ", ".join(f"d{k}" for k in range(len(_LANGS))) + ")"
    owner = " ".join(f"WHEN d{k} = {best} THEN '{c}'" for k, c in enumerate(_LANGS))
    return f"""SELECT word, CASE {owner} END AS lang, round({best}, 12) AS deviation FROM (
    SELECT word, {", ".join(f"r{k} - {mean} AS d{k}" for k in range(len(_LANGS)))} FROM (SELECT word, {rates} FROM nostop
    WHERE lang IN ({", ".join(f"'{c}'" for c in _LANGS)}) GROUP BY word)) ORDER BY {best} DESC, word LIMIT 125"""


@query("comparison_terms_languages", _comparison_sql())
def comparison_terms_languages(spark, sf):
    """Terms of four categories by how far their rate in one exceeds the mean."""
    counts = ct.count_by(tokens(spark, sf, "lang"), "lang", "word")
    return rounded(cn.comparison_terms(counts, "word", "lang", _LANGS), "deviation", digits=12)


@query(
    "frequent_terms",
    f"""SELECT term, count(*) AS n FROM (SELECT unnest(string_split({_CLEAN}, ' ')) AS term FROM conversations WHERE role IN ('user', 'assistant'))
    WHERE length(term) >= 3 GROUP BY term ORDER BY n DESC, term LIMIT 50""",
)
def frequent_terms(spark, sf):
    """Most frequent terms of the cleaned term-document table."""
    turns = table(spark, sf, "conversations", "role", "text").where(F.col("role").isin("user", "assistant"))
    return cn.frequent_terms(rs.term_document_table(turns.select("role", tx.clean_corpus("text", ENGLISH).alias("clean")), "role", "clean"))


@query(
    "top_terms_overall",
    """SELECT *, row_number() OVER (ORDER BY n, word) AS ord FROM (SELECT word, count(*) AS n FROM nostop WHERE word IS NOT NULL GROUP BY word
    QUALIFY rank() OVER (ORDER BY n DESC) <= 20)""",
)
def top_terms_overall(spark, sf):
    """Bars of a chart without facets."""
    return tn.top_bars(ct.count_by(tokens(spark, sf), "word"), 20, "word")


@query(
    "frequent_tokens",
    """SELECT word AS term, count(*) AS n FROM roles WHERE role IN ('user', 'assistant') AND length(word) >= 3 GROUP BY word
    ORDER BY n DESC, word LIMIT 50""",
)
def frequent_tokens(spark, sf):
    """The same over plain tokens."""
    words = role_tokens(spark, sf).where(F.col("role").isin("user", "assistant") & (F.char_length("word") >= 3))
    table_ = ct.count_by(words, "word", "role").withColumnRenamed("word", "term")
    return cn.frequent_terms(table_)
