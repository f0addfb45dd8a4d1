"""Counts per word and document: rows of a document that has its key for itself are not shuffled."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatim.operators import counts as ct, keyed
from verbatim.operators.tokens import word_tokens
from verbatim.plans import base, catalog

SCHEMA = "doc_id long, text string, lang string, source string"
COMMON = " ".join(f"term{i}" for i in range(40))
ROWS = [(i, f"{COMMON} {COMMON} own{i} the", "en", "src1") for i in range(300)] + [
    (1000, "once twice twice", "en", "src1"),
    (1000, "twice, thrice!", "en", "src1"),
    (1000, "twice", "de", "src1"),
    (1000, "twice", None, "src1"),
    (None, "twice alpha tion", "en", "src2"),
    (None, "twice beta que", "en", "src2"),
    (None, "twice", None, None),
    (1001, "", "en", "src1"),
    (1002, "the and", "en", "src1"),
    (1003, None, "en", "src1"),
    (1003, None, "en", "src1"),
    (1004, None, "en", "src1"),
]


def split(text):
    return [None] if text is None else [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w not in base.ENGLISH]


CELLS = Counter((word, *key) for doc_id, text, lang, source in ROWS for word in split(text) for key in [(lang, source, doc_id)])


def shuffled_rows(df):
    """Rows that the exchanges of a query wrote, once it has run."""

    def total(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return total(node.executedPlan())
        if name.endswith("QueryStage"):
            return total(node.plan())
        found = node.metrics().get("shuffleRecordsWritten") if name.startswith("Exchange") else None
        kids = node.children()
        return (found.get().value() if found and found.isDefined() else 0) + sum(total(kids.apply(i)) for i in range(kids.size()))

    return total(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_filtered_term_counts_shuffle_no_cells_of_single_documents(spark, folder):
    df = catalog.queries()["filtered_term_counts"](spark, folder)
    got = {r["word"]: r["n"] for r in df.collect()}
    assert got == Counter(word for word, *_ in CELLS if word not in ("tion", "la", "le", "un", "que"))
    assert got["twice"] == 5 and got["term0"] == 300 and got[None] == 2
    assert 0 < shuffled_rows(df) < len(CELLS) / 4


def test_score_word_counts_shuffle_no_cells_of_single_documents(spark, tmp_path):
    word = next(iter(base.SCORES))
    rows = [(i, f"{COMMON} {word} {word}", "en", "src1") for i in range(300)] + [(7, word, "de", "src2"), (None, word, "en", "src1"), (None, word, "en", "src1")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["score_word_counts"](spark, str(tmp_path))
    assert [(r["word"], r["n"]) for r in df.collect()] == [(word, 301)]
    assert shuffled_rows(df) < 300 * 40 / 4


@pytest.mark.parametrize("slots", [keyed.REPEAT_SLOTS, 1])
def test_cells_have_the_counts_of_all_rows(spark, folder, slots, monkeypatch):
    """With one slot, most single documents share a hash with a repeated one and take the shuffle."""
    monkeypatch.setattr(keyed, "REPEAT_SLOTS", slots)
    words = base.tokens(spark, folder, "lang", "source", "doc_id", cells=True)
    cells = ct.count_by(words, "word", "lang", "source", "doc_id", weight="times", alone="alone")
    got = [tuple(r) for r in cells.collect()]
    assert len(got) == len(CELLS) and {r[:-1]: r[-1] for r in got} == CELLS


def test_with_alone_is_false_for_repeated_keys(spark, folder):
    marked = keyed.with_alone(spark.read.parquet(f"{folder}/documents.parquet"), ["lang", "source", "doc_id"])
    keys = Counter((r[2], r[3], r[0]) for r in ROWS)
    rows = [(keys[r["lang"], r["source"], r["doc_id"]], r["alone"]) for r in marked.collect()]
    assert len(rows) == len(ROWS) and all(alone == (n == 1) for n, alone in rows)


def test_count_by_without_weight_counts_a_row_that_is_alone_once(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("b", None), (None, True)], "k string, alone boolean")
    assert Counter(map(tuple, ct.count_by(df, "k", alone="alone").collect())) == Counter([("a", 1), ("b", 2), (None, 1)])


def test_distinct_words_of_a_response_with_their_number(spark):
    df = spark.createDataFrame([(1, "b a b c b a"), (2, ""), (3, None), (4, "x")], "id int, text string")
    got = Counter(map(tuple, word_tokens(df, "text", times="n").collect()))
    assert got == Counter([(1, "a", 2), (1, "b", 3), (1, "c", 1), (3, None, 1), (4, "x", 1)])
    stops = spark.createDataFrame([("b",)], "word string")
    assert Counter(map(tuple, word_tokens(df.where(F.col("id") == 1), "text", stop_words=stops, times="n").collect())) == Counter([(1, "a", 2), (1, "c", 1)])
    with pytest.raises(ValueError, match="position"):
        word_tokens(df, "text", pos="pos", times="n")
