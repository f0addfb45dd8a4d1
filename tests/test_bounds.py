"""Learned abbreviations, sentence bounds, and the sieve of lexicon words."""

import random

import pytest
from pyspark.sql import functions as F

from verbatim.functions import text as tx
from verbatim.operators import bounds as bd, sentiment as sn


def corpus(rng):
    """Sentences of made-up words in which three short forms keep their period, and one ends sentences as well."""
    words = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(300)]
    rows = []
    for k in range(400):
        some = [rng.choice(words) for _ in range(rng.randrange(4, 14))]
        some.insert(rng.randrange(1, len(some)), rng.choice(["e.g.", "dr.", "etc.", f"{rng.randrange(9)}.{rng.randrange(99)}", "no"]))
        rows.append((k, " ".join(some).capitalize() + "."))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus(random.Random(2))
    joined = [(k, " ".join(t for _, t in rows[10 * k : 10 * k + 10])) for k in range(40)] + [(99, None), (98, "")]
    df = spark.createDataFrame(joined, "id int, text string")
    return df, bd.abbreviations(df, "text"), rows


def test_abbreviations_are_learned(found):
    df, table, _ = found
    got = {r.word: r for r in table.collect()}
    assert set(got) == {"e.g", "dr", "etc"} and all(r.without == 0 and r.small_after > 0 for r in got.values())


def test_learned_bounds_give_the_sentences_back(found):
    df, table, rows = found
    got = [r.sentence for r in bd.learned_sentences(df, "text", table, lower=False, sentence_id="n").orderBy("id", "n").collect()]
    assert got == [t for _, t in rows]
    # Without what was learned, every period cuts.
    assert df.select(F.explode(tx.sentence_array("text"))).count() > 1.3 * len(rows)


def test_bounds_of_single_texts(spark):
    cases = {
        "It costs 3.5 or 1.2.3.4 here. Then": ["It costs 3.5 or 1.2.3.4 here.", "Then"],
        "See (e.g. this), dr. who etc.": ["See (e.g. this), dr. who etc."],
        "Use etc., or DR. No!  Yes?": ["Use etc., or DR. No!", "Yes?"],
        "a.b c. d": ["a.", "b c.", "d"], "": [], "...": [], "  x \n\n y.z": ["x \n\n y.", "z"], "7.": ["7."], ".5": ["5"],
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", tx.bounded_sentences("t", ["e.g", "dr", "etc"]).alias("s")).collect()}
    assert got == {**cases, None: None}
    assert df.select(tx.bounded_sentences("t", []).alias("s")).where("t = 'x'").count() == 0


def test_scores_use_learned_bounds(spark, found):
    _, table, _ = found
    df = spark.createDataFrame([(1, "No dr. good here. Bad")], "id int, text string")
    weights = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "word string, weight double")
    shift = sn.Shifters(negators=["no"])
    learned = sn.sentence_sentiment(df, "id", "text", weights, shift, abbreviations=table).orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.word_count, r.sentiment) for r in learned] == [(1, 4, -0.5), (2, 1, -1.0)]
    assert sn.sentence_sentiment(df, "id", "text", weights, shift).count() == 3


def test_no_word_of_the_lexicon_is_lost_and_few_others_pass(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30_000)})
    lexicon, others = words[::4], [w for k, w in enumerate(words) if k % 4]
    table = spark.createDataFrame([(w,) for w in lexicon] + [(None,)], "word string")
    every = spark.createDataFrame([(w,) for w in words], "word string").withColumn("s", sn.word_sieve(table))
    passed = {r.word for r in every.where(sn.passes(F.col("s"), F.col("word"))).select("word").collect()}
    assert passed >= set(lexicon) and len(passed & set(others)) < 0.02 * len(others)


def test_only_possible_words_leave_their_sentence(spark, sf):
    """Rows that go into the lexicon join, markers aside, are at most 1.1 times the polar words."""
    from verbatim.plans.base import table, weights

    lexicon = weights(spark)
    words = table(spark, sf, "documents", "text").select(F.explode(tx.word_array("text")).alias("word"))
    polar = words.join(lexicon, "word").count()
    passing = words.withColumn("s", sn.word_sieve(lexicon)).where(sn.passes(F.col("s"), F.col("word"))).count()
    assert 0 < polar <= passing <= 1.1 * polar < 0.2 * words.count()


def test_lookups_compare_few_words(spark):
    """Twenty thousand abbreviations are dealt to slots, and cut texts as a list of them does."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(20_000)]
    table = spark.createDataFrame([(w,) for w in words] + [(words[0],), (None,)], "word string")
    known = spark.range(1).select(bd.abbreviation_list(table).alias("k"))
    sizes = [len(s) for s in known.first()["k"] if s is not None]
    assert sum(sizes) == len(words) and max(sizes) < 40
    rng = random.Random(4)
    texts = [" ".join(rng.choice([*words[:9], "etc", "no", "W" + words[3][1:], "("]) + rng.choice([". ", " ", ".\n", ".) ", "! ", " . "]) for _ in range(40)) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None, " ", ".", "x", "wa. "]], "t string")
    df = df.withColumn("k", bd.abbreviation_list(table))
    got = df.select(tx.bounded_sentences("t", F.col("k")).alias("a"), tx.bounded_sentences("t", words[:9] + [words[3]]).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_a_long_text_takes_no_stack(spark):
    df = spark.createDataFrame([("word " * 300_000 + "e.g. x. y",)], "t string")
    assert [len(s) for s in df.select(tx.bounded_sentences("t", ["e.g"]).alias("s")).first()["s"]] == [1_500_007, 1]


def test_period_counts_of_odd_ends(spark):
    df = spark.createDataFrame([('a.) b.", c! d e.\u2028 f.. g.h. (i .j',), (None,)], "t string")
    got = {r.word: (r.with_period, r.without) for r in bd.period_counts(df, "t").collect()}
    assert got == {"a": (1, 0), "b": (1, 0), "c": (0, 1), "d": (0, 1), "e": (1, 0), "g.h": (1, 0), "i": (0, 1)}


def test_learning_reads_the_texts_once(spark, sf):
    """The share of periods and the scores are read from the same shuffled counts."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = bd.abbreviations(spark.read.parquet(f"{sf}/documents.parquet"), "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "ReusedExchange" in plan
