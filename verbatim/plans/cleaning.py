"""Queries for projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatim.functions import numeric as num, text as tx
from verbatim.operators import clean as cl, counts as ct, keyed, sentiment as sn, tokens as tk
from verbatim.plans.base import DEVICE_RULES, ENGLISH, SURVEYS, boxes, polarity, query, role_tokens, surveys, table, tokens


def _docs(spark, sf, *columns):
    return table(spark, sf, "documents", *columns)


@query("standardize_columns", "SELECT doc_id, text AS response_text, lang AS answer_language FROM documents")
def standardize_columns(spark, sf):
    raw = _docs(spark, sf, "doc_id", "text", "lang").toDF("Doc Id", "Response\tText", "Answer language")
    return cl.standardize_columns(raw)


@query("filter_in_list", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def filter_in_list(spark, sf):
    return cl.filter_in_list(_docs(spark, sf, "doc_id", "lang"), "lang", ["en", "fr"])


@query(
    "filter_not_regex",
    "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(source, '^src1') AND NOT regexp_matches(lower(text), '^the.*')",
)
def filter_not_regex(spark, sf):
    docs = cl.filter_not_regex(_docs(spark, sf, "doc_id", "source", "text"), "source", "^src1")
    return cl.filter_not_regex(docs, "text", "^the.*", lower=True).select("doc_id", "source")


@query("filter_row_id_not", "SELECT doc_id, lang FROM documents WHERE CAST(doc_id AS VARCHAR) <> '17'")
def filter_row_id_not(spark, sf):
    return cl.filter_row_id_not(_docs(spark, sf, "doc_id", "lang"), "doc_id", "17")


@query(
    "add_row_id",
    """SELECT row_number() OVER (ORDER BY doc_id) AS row_id, doc_id, lang FROM documents
    WHERE lang IN ('en', 'de') AND NOT regexp_matches(lower(text), '^the.*')""",
)
def add_row_id(spark, sf):
    docs = cl.filter_in_list(_docs(spark, sf, "doc_id", "lang", "text"), "lang", ["en", "de"])
    docs = cl.filter_not_regex(docs, "text", "^the.*", lower=True).select("doc_id", "lang")
    return keyed.add_row_id(docs, "doc_id")


@query(
    "strip_reply_prefix",
    "SELECT doc_id, regexp_replace(concat('Reply to @u', doc_id, ': ', text), '.*:', ':') AS reply_removed FROM documents",
)
def strip_reply_prefix(spark, sf):
    reply = F.concat(F.lit("Reply to @u"), F.col("doc_id").cast("string"), F.lit(": "), F.col("text"))
    return _docs(spark, sf, "doc_id", "text").select("doc_id", tx.strip_reply_prefix(reply).alias("reply_removed"))


@query("word_count", "SELECT doc_id, word_count FROM survey")
def word_count(spark, sf):
    return _docs(spark, sf, "doc_id", "text").select("doc_id", tx.word_count("text").alias("word_count"))


@query("char_length", "SELECT doc_id, length(text) AS n_text FROM documents")
def char_length(spark, sf):
    return _docs(spark, sf, "doc_id", "text").select("doc_id", tx.char_length("text").alias("n_text"))


@query("squeezed_char_length", r"SELECT doc_id, length(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')) AS characters FROM documents")
def squeezed_char_length(spark, sf):
    return _docs(spark, sf, "doc_id", "text").select("doc_id", tx.squeezed_char_length("text").alias("characters"))


@query("filter_min_length", "SELECT word, count(*) AS n FROM nostop WHERE length(word) > 2 GROUP BY word")
def filter_min_length(spark, sf):
    return cl.filter_min_length(ct.count_by(tokens(spark, sf), "word"), "word", 2)


@query(
    "filter_has_letter",
    """SELECT word1, word2, count(*) AS n FROM halves WHERE regexp_matches(word1, '[a-z]') AND regexp_matches(word2, '[a-z]')
    GROUP BY ALL""",
)
def filter_has_letter(spark, sf):
    bigrams = tk.ngrams(_docs(spark, sf, "text"), "text", 2)
    pairs = ct.count_by(cl.split_pair(bigrams, "ngram"), "word1", "word2")
    return cl.filter_has_letter(pairs, "word1", "word2")


@query(
    "device_from_segment",
    """SELECT doc_id, segment, device, regexp_replace(regexp_replace(regexp_replace(segment, '.*desktop$', 'desktop', 'g'),
    '.*mobile$', 'mobile', 'g'), '.*src*', 'mobile & desktop', 'g') AS device_with_tail FROM survey""",
)
def device_from_segment(spark, sf):
    with_tail = DEVICE_RULES[:2] + [(".*src*", "mobile & desktop")]
    return surveys(spark, sf).select("doc_id", "segment", "device", tx.relabel("segment", with_tail).alias("device_with_tail"))


@query("segment_base_name", "SELECT doc_id, segment, segment_name FROM survey")
def segment_base_name(spark, sf):
    base = tx.base_name("segment", SURVEYS, ["desktop", "mobile"])
    return surveys(spark, sf).select("doc_id", "segment", base.alias("segment_name"))


@query(
    "split_path",
    r"""SELECT page_id, p[1] AS split_1, p[2] AS split_2 FROM (
    SELECT page_id, regexp_split_to_array(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '[^\p{L}\p{N}]+') AS p FROM pages)""",
)
def split_path(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "url")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return cl.split_path_columns(pages.select("page_id", path.alias("path")), "path")


@query("split_bigram", "SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS word1, split_part(p_name, ' ', 2) AS word2 FROM part")
def split_bigram(spark, sf):
    return cl.split_pair(table(spark, sf, "part", "p_partkey", "p_name"), "p_name", remove=False)


@query("rename_columns", "SELECT doc_id AS row_id, lang AS split_1, source AS split_2 FROM documents")
def rename_columns(spark, sf):
    return cl.rename_columns(_docs(spark, sf, "doc_id", "lang", "source"), ["row_id", "split_1", "split_2"])


@query("select_columns", "SELECT doc_id, source FROM documents")
def select_columns(spark, sf):
    return _docs(spark, sf).select("doc_id", "source")


@query("drop_columns", "SELECT * EXCLUDE (text, n_chars) FROM documents")
def drop_columns(spark, sf):
    return _docs(spark, sf).drop("text", "n_chars")


@query("filter_null", "SELECT doc_id, lang FROM marks WHERE useful IS NULL")
def filter_null(spark, sf):
    return cl.filter_null(boxes(spark, sf), "useful").select("doc_id", "lang")


@query("filter_not_null", "SELECT ngram, count(*) AS n FROM tri WHERE ngram <> 'NA' GROUP BY ngram")
def filter_not_null(spark, sf):
    grams = tk.ngrams(_docs(spark, sf, "text"), "text", 3)
    return cl.filter_not_null(ct.count_by(grams, "ngram"), "ngram", also_literal_na=True)


@query("drop_na_any", "SELECT * FROM marks WHERE useful IS NOT NULL AND harmful IS NOT NULL")
def drop_na_any(spark, sf):
    return cl.drop_na(boxes(spark, sf))


@query("drop_na_subset", "SELECT doc_id, ngram FROM bi WHERE ngram IS NOT NULL")
def drop_na_subset(spark, sf):
    return cl.drop_na(tk.ngrams(_docs(spark, sf, "doc_id", "text"), "text", 2), "ngram")


@query(
    "filter_equals_or",
    "SELECT doc_id, lang, source FROM documents WHERE (lang = 'en' OR lang = 'de' OR lang = 'es') AND source <> 'src3'",
)
def filter_equals_or(spark, sf):
    docs = cl.filter_in_list(_docs(spark, sf, "doc_id", "lang", "source"), "lang", ["en", "de", "es"])
    return docs.where(F.col("source") != "src3")


@query("filter_not_in", "SELECT doc_id, lang FROM marks WHERE useful IS NULL OR useful NOT IN (true)")
def filter_not_in(spark, sf):
    return cl.filter_not_in(boxes(spark, sf), "useful", [True]).select("doc_id", "lang")


@query("filter_min_count", "SELECT word, lang, count(*) AS n FROM nostop GROUP BY ALL HAVING count(*) > 3")
def filter_min_count(spark, sf):
    return cl.filter_min_count(ct.count_by(tokens(spark, sf, "lang"), "word", "lang"), 3)


@query(
    "filter_word_count",
    "SELECT doc_id, word_count FROM survey WHERE word_count > 1",
)
def filter_word_count(spark, sf):
    return cl.filter_word_count(surveys(spark, sf).select("doc_id", "word_count"), more_than=1)


@query("filter_word_count_single", "SELECT doc_id, word_count FROM survey WHERE word_count < 2")
def filter_word_count_single(spark, sf):
    return cl.filter_word_count(surveys(spark, sf).select("doc_id", "word_count"), less_than=2)


@query("count_literal_answers", "SELECT count(*) AS n FROM part WHERE p_name IN ('small ring', 'large ring', 'Small ring')")
def count_literal_answers(spark, sf):
    return cl.count_literal_answers(table(spark, sf, "part", "p_name"), "p_name", ["small ring", "large ring", "Small ring"])


@query(
    "cast_int",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS as_int, TRY_CAST(event_type AS INTEGER) AS bad_int
    FROM events""",
)
def cast_int(spark, sf):
    digits = F.regexp_extract("props", "[0-9]+", 0)
    return table(spark, sf, "events", "event_id", "props", "event_type").select(
        "event_id", digits.try_cast("int").alias("as_int"), F.col("event_type").try_cast("int").alias("bad_int")
    )


@query("cast_double", "SELECT event_id, TRY_CAST(concat(regexp_extract(props, '[0-9]+'), '.5') AS DOUBLE) AS as_double FROM events")
def cast_double(spark, sf):
    number = F.concat(F.regexp_extract("props", "[0-9]+", 0), F.lit(".5"))
    return table(spark, sf, "events", "event_id", "props").select("event_id", number.try_cast("double").alias("as_double"))


@query(
    "case_when_sign",
    """SELECT segment, positive, negative, CASE WHEN positive > negative THEN 'positive' WHEN positive <= negative THEN 'negative' END
    AS sentiment FROM segpol""",
)
def case_when_sign(spark, sf):
    counts = sn.polarity_word_counts(tokens(spark, sf, "segment", "device"), polarity(spark), "segment", "device")
    wide = sn.segment_polarity(counts)
    return wide.select("segment", "positive", "negative", num.sign_label("positive", "negative").alias("sentiment"))


@query("round_half_even", "SELECT doc_id, round_even(n_chars / 2.0, 0) AS half_0, round_even(n_chars / 8.0, 2) AS eighth_2 FROM documents")
def round_half_even(spark, sf):
    n = F.col("n_chars").cast("double")
    return _docs(spark, sf, "doc_id", "n_chars").select(
        "doc_id", num.round_half_even(n / 2.0).alias("half_0"), num.round_half_even(n / 8.0, 2).alias("eighth_2")
    )


@query("facet_label", "SELECT concat_ws('__', word, lang) AS label, count(*) AS n FROM nostop GROUP BY ALL")
def facet_label(spark, sf):
    counts = ct.count_by(tokens(spark, sf, "lang"), "word", "lang")
    return counts.select(tx.facet_label("word", "lang").alias("label"), "n")


@query(
    "strip_facet",
    "SELECT label, regexp_replace(label, '__.+$', '', 'g') AS term FROM (SELECT DISTINCT concat_ws('__', word, source) AS label FROM nostop)",
)
def strip_facet(spark, sf):
    pairs = tokens(spark, sf, "source").distinct()
    label = tx.facet_label("word", "source")
    return pairs.select(label.alias("label"), tx.strip_facet(label).alias("term"))


_BARE = r"lower(regexp_replace(regexp_replace(regexp_replace(text, '[[:punct:]]+', '', 'g'), '[ \t\n\f\r]+', ' ', 'g'), '[0-9]+', '', 'g'))"
_CLEAN = (
    "array_to_string(list_filter(regexp_split_to_array(" + _BARE + ", ' +'), lambda w: w <> '' AND NOT list_contains(["
    + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "], w)), ' ')"
)


@query("corpus_clean", f"SELECT conv_id, turn, {_CLEAN} AS clean FROM conversations")
def corpus_clean(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return turns.select("conv_id", "turn", tx.clean_corpus("text", ENGLISH).alias("clean"))


@query(
    "abs_difference",
    """SELECT word, user_n, assistant_n, abs(user_n - assistant_n) AS difference FROM (SELECT word, count_if(role = 'user') AS user_n,
    count_if(role = 'assistant') AS assistant_n FROM roles GROUP BY word) WHERE user_n > 0 AND assistant_n > 0""",
)
def abs_difference(spark, sf):
    both = ct.common_terms(ct.count_by(role_tokens(spark, sf), "word", "role"), "word", "role", "user", "assistant")
    return both.withColumn("difference", F.abs(F.col("user_n") - F.col("assistant_n")))
