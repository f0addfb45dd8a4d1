"""Registry, shared inputs and the shared part of the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from verbatim.functions import text as tx
from verbatim.operators.keyed import with_alone
from verbatim.operators.sentiment import Shifters
from verbatim.operators.tokens import word_tokens
from verbatim.sources import lexicons as lx
from verbatim.sources.readers import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The 181 English stop words that Spark ships.
ENGLISH = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's
we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's
where's who's why's would
""".split()

# Invented lexicons for the invented prose of the test tables.
POLARITY = {
    "thatin": "positive", "ononst": "positive", "inoran": "positive", "hehely": "positive", "tion": "positive",
    "ther": "positive", "thon": "positive", "rewh": "negative", "orre": "negative", "orantion": "negative",
    "thha": "negative", "thnt": "negative", "thor": "negative",
}
SCORES = {
    "thatin": 3, "ononst": 2, "inoran": 1, "hehely": 4, "tion": 1, "ther": 2, "thon": 1, "rewh": -2, "orre": -3,
    "orantion": -1, "thha": -4, "thnt": -2, "thor": -5,
}
NEW_POLARITY, NEUTRAL, NEW_SCORES = {"thon": "negative"}, ["thor"], {"thon": -1}
SHIFTERS = Shifters(negators=["no", "is"], amplifiers=["with"], deamplifiers=["by"], adversatives=["for"])
TARGETS = ["thatin", "rewh", "inoran", "tion"]
SURVEYS = [f"src{i}" for i in range(20)]
DEVICE_RULES = [(".*desktop$", "desktop"), (".*mobile$", "mobile"), (".*src.*", "mobile & desktop")]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where given, its SQL twin."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = PRELUDE + sql
        return fn

    return register


# --- Spark inputs -----------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return scan(spark, f"{sf}/{name}.parquet", columns)


def surveys(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as survey responses with segment, device, segment name and word count."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    turn = F.col("doc_id") % 3
    tail = F.when(turn == 0, "_desktop").when(turn == 1, "_mobile").otherwise("")
    docs = docs.withColumn("segment", F.concat("source", tail))
    return docs.withColumns(
        {
            "device": tx.relabel("segment", DEVICE_RULES),
            "segment_name": tx.base_name("segment", SURVEYS, ["desktop", "mobile"]),
            "word_count": tx.word_count("text"),
        }
    )


def tokens(spark: SparkSession, sf: str, *keep: str, stop: bool = True, pos: bool = False, cells: bool = False) -> DataFrame:
    """Document words without stop words (unless ``stop`` is False) and the kept columns.

    With ``cells``, a document's equal words are one row, with their number ``times`` and
    ``alone``: whether no other document has the same kept columns.
    """
    docs = surveys(spark, sf).select("text", *keep)
    docs = with_alone(docs, keep) if cells else docs
    return word_tokens(docs, "text", pos="pos" if pos else None, stop_words=ENGLISH if stop else None, times="times" if cells else None)


def role_tokens(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations", "role", "text")
    return word_tokens(turns, "text", stop_words=ENGLISH)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels as check boxes; unlabelled documents have null boxes."""
    docs = table(spark, sf, "documents", "doc_id", "lang")
    labels = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("useful"), (F.col("toxic") == 1).alias("harmful"))
    return docs.join(marks, "doc_id", "left")


def stop_frame(spark: SparkSession) -> DataFrame:
    return lx.load_stop_words(spark, ["english"])


def polarity(spark: SparkSession) -> DataFrame:
    return lx.polarity_lexicon(spark, POLARITY)


def scores(spark: SparkSession) -> DataFrame:
    return lx.score_lexicon(spark, SCORES)


def weights(spark: SparkSession) -> DataFrame:
    """Polarity lexicon as +1 / -1 weights."""
    return polarity(spark).select("word", F.when(F.col("sentiment") == "positive", 1.0).otherwise(-1.0).alias("weight"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- SQL twins --------------------------------------------------------------

def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOPS = _quoted(ENGLISH)
TOKEN_SQL = tx.TOKEN.replace("'", "''")
_STOP_LIST = f"[{STOPS}]"


def gram_list(words: str, n: int) -> str:
    """SQL list of n-grams of a word list; a short list gives one null."""
    parts = " || ' ' || ".join(f"{words}[i + {k}]" for k in range(n))
    return (
        f"CASE WHEN len({words}) < {n} THEN [CAST(NULL AS VARCHAR)] "
        f"ELSE list_transform(range(1, len({words}) - {n} + 2), lambda i: {parts}) END"
    )


PRELUDE = f"""
WITH seg AS (
  SELECT doc_id, text, lang, source, concat(source, CASE doc_id % 3 WHEN 0 THEN '_desktop' WHEN 1 THEN '_mobile' ELSE '' END) AS segment
  FROM documents),
survey AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(segment, '.*desktop$', 'desktop', 'g'), '.*mobile$', 'mobile', 'g'),
      '.*src.*', 'mobile & desktop', 'g') AS device,
    regexp_replace(segment, '({"|".join(SURVEYS)})_(?:desktop|mobile)', '\\1', 'g') AS segment_name,
    len(regexp_extract_all(text, '{tx.WORD}')) AS word_count
  FROM seg),
arr AS (SELECT * EXCLUDE (text), regexp_extract_all(lower(text), '{TOKEN_SQL}') AS words FROM survey),
kept AS (SELECT * EXCLUDE (words), list_filter(words, lambda w: NOT list_contains({_STOP_LIST}, w)) AS words FROM arr),
tok AS (SELECT * EXCLUDE (words), unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM arr),
nostop AS (SELECT * FROM tok WHERE word NOT IN ({STOPS})),
roles AS (SELECT role, word FROM (SELECT role, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS word FROM conversations)
  WHERE word NOT IN ({STOPS})),
bi AS (SELECT * EXCLUDE (words), unnest({gram_list("words", 2)}) AS ngram FROM arr),
tri AS (SELECT * EXCLUDE (words), unnest({gram_list("words", 3)}) AS ngram FROM arr),
binostop AS (SELECT * EXCLUDE (words), unnest({gram_list("words", 2)}) AS ngram FROM kept WHERE len(words) > 0),
trinostop AS (SELECT * EXCLUDE (words), unnest({gram_list("words", 3)}) AS ngram FROM kept WHERE len(words) > 0),
halves AS (SELECT *, split_part(ngram, ' ', 1) AS word1, split_part(ngram, ' ', 2) AS word2 FROM bi WHERE ngram IS NOT NULL),
pairs AS (SELECT word1, word2, segment, count(*) AS n FROM halves
  WHERE word1 NOT IN ({STOPS}) AND word2 NOT IN ({STOPS}) AND regexp_matches(word1, '[a-z]') AND regexp_matches(word2, '[a-z]')
  GROUP BY ALL),
marks AS (SELECT d.doc_id, d.lang, l.quality = 1 AS useful, l.toxic = 1 AS harmful FROM documents d LEFT JOIN labels l USING (doc_id)),
pol(word, sentiment) AS (VALUES {", ".join(f"('{w}', '{s}')" for w, s in POLARITY.items())}),
sco(word, score) AS (VALUES {", ".join(f"('{w}', CAST({s} AS DOUBLE))" for w, s in SCORES.items())}),
polar AS (SELECT word, sentiment, segment, device, count(*) AS n FROM nostop JOIN pol USING (word) GROUP BY ALL),
segpol AS (SELECT segment, nullif(count_if(sentiment = 'positive'), 0) AS positive, nullif(count_if(sentiment = 'negative'), 0) AS negative
  FROM polar GROUP BY segment),
segpolarity AS (SELECT segment, positive, negative, positive - negative AS polarity,
  (positive - negative) / nullif(CAST(positive + negative AS DOUBLE), 0) AS ratio FROM segpol),
resp AS (SELECT doc_id, avg(score) AS avg_sm_score FROM nostop JOIN sco USING (word) GROUP BY doc_id),
scored AS (SELECT s.*, r.avg_sm_score FROM survey s JOIN resp r USING (doc_id) WHERE word_count > 1)
"""
