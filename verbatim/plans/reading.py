"""Queries for readers and lexicon loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verbatim.operators import counts as ct, keyed, sentiment as sn
from verbatim.operators.tokens import word_tokens
from verbatim.plans.base import ENGLISH, STOPS, TOKEN_SQL, polarity, query, role_tokens, scores, stop_frame, table, tokens
from verbatim.sources import inference, lexicons as lx, readers as rd, scratch


@query("scan_responses", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_responses(spark, sf):
    return rd.scan(spark, f"{sf}/documents.parquet")


@query("scan_project", "SELECT doc_id, text, source FROM documents")
def scan_project(spark, sf):
    return rd.scan(spark, f"{sf}/documents.parquet", ["doc_id", "text", "source"])


@query("scan_all", "SELECT * FROM conversations")
def scan_all(spark, sf):
    return rd.scan(spark, f"{sf}/conversations.parquet")


@query("scan_except_cast", "SELECT * EXCLUDE (conv_id), CAST(conv_id AS VARCHAR) AS conv_id FROM conversations")
def scan_except_cast(spark, sf):
    return rd.scan_except_cast(table(spark, sf, "conversations"), "conv_id")


@query(
    "scan_comments_sql",
    """SELECT row_number() OVER (ORDER BY event_id) AS row_id, CAST(make_timestamp_ms(epoch_ms(ts)) AS DATE) AS date_created,
    CAST(user_id AS VARCHAR) AS user_name, event_type, event_id FROM events""",
)
def scan_comments_sql(spark, sf):
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    raw = events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "user_id", "event_type")
    rows = keyed.add_row_id(raw, "event_id")
    return rows.select(
        "row_id", rd.date_from_millis("ms").alias("date_created"), F.col("user_id").cast("string").alias("user_name"),
        "event_type", "event_id",
    )


@query("scan_csv", "SELECT item_id, text FROM benchmark")
def scan_csv(spark, sf):
    path = scratch.scratch_path(spark, "quotes")
    rd.write_csv(table(spark, sf, "benchmark", "item_id", "text"), path)
    return rd.scan_csv(spark, path, "item_id long, text string", multi_line=True)


_BROKEN_ROWS = [("7", "n/a", "1995-01-01", "none"), ("8", "1.5", "1995-02-31", "none")]


@query(
    "scan_csv_inferred",
    """SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority,
    CAST(NULL AS VARCHAR) AS _broken FROM orders
    UNION ALL SELECT 7, NULL, DATE '1995-01-01', 'none', 'o_totalprice=n/a' UNION ALL SELECT 8, 1.5, NULL, 'none', 'o_orderdate=1995-02-31'""",
)
def scan_csv_inferred(spark, sf):
    """Orders and two broken rows, with types found in the rows."""
    path = scratch.scratch_path(spark, "orders")
    orders = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    texts = orders.select(*[F.col(c).cast("date" if c == "o_orderdate" else orders.schema[c].dataType).cast("string") for c in orders.columns])
    rd.write_csv(texts.union(spark.createDataFrame(_BROKEN_ROWS, texts.schema)), path)
    return inference.scan_csv_inferred(spark, path, least_share=0.9)


def _used(lexicon: DataFrame, spark, sf) -> DataFrame:
    """Lexicon entries with their occurrences in the documents."""
    seen = ct.count_by(tokens(spark, sf, stop=False), "word")
    return lexicon.join(seen, "word", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(
    "load_polarity_lexicon",
    "SELECT p.word, p.sentiment, count(t.word) AS n FROM pol p LEFT JOIN tok t ON p.word = t.word GROUP BY ALL",
)
def load_polarity_lexicon(spark, sf):
    return _used(polarity(spark), spark, sf)


@query("load_score_lexicon", "SELECT s.word, s.score, count(t.word) AS n FROM sco s LEFT JOIN tok t ON s.word = t.word GROUP BY ALL")
def load_score_lexicon(spark, sf):
    return _used(scores(spark), spark, sf)


@query(
    "load_stopwords",
    "SELECT s.word, count(t.word) AS n FROM (SELECT unnest(["
    + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
    + "]) AS word) s LEFT JOIN tok t ON s.word = t.word GROUP BY ALL",
)
def load_stopwords(spark, sf):
    return _used(stop_frame(spark), spark, sf)


# Lexicons that are read from a table: here, the words of the benchmark texts with values made from their length.
_LISTED = f""", listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS word FROM benchmark),
given AS (SELECT word, CAST(length(word) % 11 - 5 AS DOUBLE) AS score, CASE WHEN length(word) % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment
  FROM listed)
"""


def lexicon_table(spark, sf) -> DataFrame:
    """A lexicon as it comes: words with blanks around, repeated, numbers as text and some that are none."""
    words = word_tokens(table(spark, sf, "benchmark", "text"), "text")
    size = F.length("word")
    rows = words.select(
        F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), (size % 11 - 5).cast("string").alias("value"),
        F.when(size % 2 == 0, "positive").otherwise("negative").alias("feeling"),
    )
    return rows.union(rows.select(F.lit(None).cast("string"), F.lit("n/a"), F.lit(None).cast("string")).limit(1))


def loaded_scores(spark, sf) -> DataFrame:
    return lx.normalise_lexicon(lexicon_table(spark, sf), "value", "score", word="entry", to="double")


def loaded_polarity(spark, sf) -> DataFrame:
    return lx.normalise_lexicon(lexicon_table(spark, sf), "feeling", "sentiment", word="entry")


@query("load_score_lexicon_table", _LISTED + "SELECT g.word, g.score, count(t.word) AS n FROM given g LEFT JOIN tok t ON g.word = t.word GROUP BY ALL")
def load_score_lexicon_table(spark, sf):
    return _used(loaded_scores(spark, sf), spark, sf)


@query("load_polarity_lexicon_table", _LISTED + "SELECT g.word, g.sentiment, count(t.word) AS n FROM given g LEFT JOIN tok t ON g.word = t.word GROUP BY ALL")
def load_polarity_lexicon_table(spark, sf):
    return _used(loaded_polarity(spark, sf), spark, sf)


@query(
    "remove_stopwords_table",
    _LISTED + f"""SELECT doc_id, word FROM tok WHERE word NOT IN (SELECT word FROM listed WHERE length(word) <= 3) AND word NOT IN ({STOPS})""",
)
def remove_stopwords_table(spark, sf):
    """Two stacked stop lists, one of them read from a table."""
    short = lexicon_table(spark, sf).select(F.trim("entry").alias("word")).where(F.length("word") <= 3)
    stacked = lx.stacked_stop_words({"built in": stop_frame(spark), "short": short})
    docs = table(spark, sf, "documents", "doc_id", "text")
    return word_tokens(docs, "text", stop_words=stacked)


@query(
    "override_scores_table",
    _LISTED + """SELECT s.word, coalesce(g.score, s.score) AS score FROM sco s LEFT JOIN (SELECT * FROM given WHERE score > 0) g ON s.word = g.word""",
)
def override_scores_table(spark, sf):
    return sn.override_scores(scores(spark), loaded_scores(spark, sf).where("score > 0")).select("word", "score")


@query(
    "project_to_frame",
    """SELECT user_n AS x, assistant_n AS y, word AS labels FROM (
    SELECT word, sum(CASE WHEN role = 'user' THEN 1 END)::BIGINT AS user_n, sum(CASE WHEN role = 'assistant' THEN 1 END)::BIGINT AS assistant_n
    FROM roles GROUP BY word) WHERE user_n IS NOT NULL AND assistant_n IS NOT NULL ORDER BY abs(user_n - assistant_n) DESC, word LIMIT 25""",
)
def project_to_frame(spark, sf):
    words = ct.count_by(role_tokens(spark, sf), "word", "role")
    top = ct.paired_counts(words, "word", "role", "user", "assistant", k=25)
    return top.select(F.col("user_n").alias("x"), F.col("assistant_n").alias("y"), F.col("word").alias("labels"))
