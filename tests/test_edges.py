"""Null, empty, short and tied inputs."""

import datetime
from collections import Counter

from pyspark.sql import Row, functions as F

from verbatim.functions import numeric as num, text as tx
from verbatim.operators import clean as cl, counts as ct, network as nw, reshape as rs, sentiment as sn, stats as st, tfidf as ti
from verbatim.operators import tokens as tk, topn as tn
from verbatim.sources import lexicons as lx, readers as rd, scratch

TEXTS = [(1, "Don't stop, U.S.A. 42!"), (2, ""), (3, "?!..."), (4, None), (5, "one"), (6, "one two"), (7, "a b c d")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "row_id int, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def by_id(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_id, []).append(r[value])
    return out


def test_word_tokens(spark):
    got = by_id(tk.word_tokens(texts(spark), "text"), "word")
    assert got[1] == ["don't", "stop", "u.s.a", "42"]
    assert 2 not in got and 3 not in got and got[4] == [None]


def test_ngrams_short_and_null(spark):
    got = by_id(tk.ngrams(texts(spark), "text", 2), "ngram")
    assert got[2] == got[3] == got[4] == got[5] == [None]
    assert got[6] == ["one two"] and got[7] == ["a b", "b c", "c d"]
    dropped = by_id(tk.ngrams(texts(spark), "text", 3, keep_short=False), "ngram")
    assert dropped == {1: ["don't stop u.s.a", "stop u.s.a 42"], 7: ["a b c", "b c d"]}


def test_ngrams_over_removed_stop_words(spark):
    got = by_id(tk.ngrams(texts(spark), "text", 2, stop_words=["b", "one"]), "ngram")
    assert got[7] == ["a c", "c d"] and got[6] == [None] and 5 not in got and 2 not in got


def test_ngrams_over_tokens_equal_ngrams_over_text(spark):
    tokens = tk.word_tokens(texts(spark).na.drop(), "text", pos="pos", stop_words=["b"])
    over = rows(tk.ngrams_over_tokens(tokens, "row_id", 2).where("ngram is not null"))
    direct = rows(tk.ngrams(texts(spark).na.drop(), "text", 2, stop_words=["b"]).where("ngram is not null"))
    assert over == direct


def test_stop_words_keep_null(spark):
    words = spark.createDataFrame([("the",), ("cat",), (None,)], "word string")
    left = {r.word for r in tk.remove_stop_words(words, lx.word_frame(spark, ["the"])).collect()}
    assert left == {"cat", None}


def test_pairs_agree_with_anti_joins(spark):
    df = spark.createDataFrame([(1, "the cat sat on the 1999 mat é o"), (2, None), (3, "")], "row_id int, text string")
    stops = ["the", "on"]
    a = rows(tk.pairs_without_stop_parts(df, "text", stops), "row_id", "word1", "word2")
    bigrams = tk.ngrams(df, "text", 2, out="bigram", keep_short=False)
    b = rows(tk.bigrams_without_stop_parts(bigrams, lx.word_frame(spark, stops)), "row_id", "first", "second")
    assert a == b == [(1, "cat", "sat")]


def test_sentences(spark):
    df = spark.createDataFrame([(1, " One.  Two!! three\nfour? "), (2, None), (3, "...")], "row_id int, text string")
    got = rows(tk.sentence_tokens(df, "text", sentence_id="sentence_id"), "row_id", "sentence_id", "sentence")
    assert got == [(1, 1, "one."), (1, 2, "two!!"), (1, 3, "three\nfour?")]


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", None)], "word string, n int")
    assert [r[0] for r in rows(tn.top_n(df, 2, "n"))] == ["a", "b", "c"]
    assert [r[0] for r in rows(tn.top_n_exact(df, 2, "word"))] == ["a", "c"]
    assert [r[0] for r in rows(tn.top_n(df.na.drop(), 99, "n"))] == ["a", "b", "c", "d"]


def test_top_n_by_null_group(spark):
    df = spark.createDataFrame([(None, "a", 3), (None, "b", 1), ("g", "c", 1), ("g", "d", 1)], "g string, word string, n int")
    assert [r[0] for r in sorted(tn.top_n(df, 1, "n", by="g").select("word").collect())] == ["a", "c", "d"]


def test_tf_idf_null_document_and_common_term(spark):
    df = spark.createDataFrame([("x", "d1", 2), ("x", "d2", 1), ("y", "d1", 2), ("y", None, 5)], "word string, doc string, n int")
    got = {(r.word, r.doc): r for r in ti.tf_idf(df, "word", "doc").collect()}
    assert got["x", "d1"].idf == 0.0 and got["x", "d1"].tf == 0.5
    assert got["y", None].tf is None and got["y", None].idf == 0.0  # two rows hold y, two documents


def test_scores_null_and_strict(spark):
    tokens = spark.createDataFrame([(1, "good"), (1, "bad"), (2, "good"), (2, "zzz"), (3, "zzz")], "row_id int, word string")
    scored = sn.join_scores(tokens, lx.score_lexicon(spark, {"good": 3, "bad": -1}))
    assert rows(sn.response_mean_score(scored, "row_id")) == [(1, 1.0), (2, 3.0)]
    strict = {r.row_id: r.avg_sm_score for r in sn.response_mean_score_strict(scored, "row_id").collect()}
    assert strict == {1: 1.0, 2: None, 3: None}
    cover = ct.lexicon_coverage(scored).collect()[0]
    assert (cover.unscored, cover.scored, cover.total) == (1, 2, 3)


def test_attach_response_score_drops_null(spark):
    resp = spark.createDataFrame([(1, "a b", 2), (2, "a", 1), (3, "a b", 2), (4, None, 2)], "row_id int, text string, word_count int")
    score = spark.createDataFrame([(1, 1.0), (2, 1.0), (4, 1.0)], "row_id int, avg_sm_score double")
    assert rows(sn.attach_response_score(resp, score, "row_id"), "row_id") == [(1,)]


def test_polarity_missing_side(spark):
    polar = spark.createDataFrame([("s1", "positive", "a", 2), ("s1", "positive", "b", 1)], "segment string, sentiment string, word string, n int")
    r = sn.segment_polarity(polar).collect()[0]
    assert (r.positive, r.negative, r.polarity, r.ratio) == (2, None, None, None)
    r = sn.segment_polarity(polar, fill=0).collect()[0]
    assert (r.polarity, r.ratio) == (2, 1.0)


def test_ratio_of_zero(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int")
    assert df.select(num.ratio("a", "b").alias("r")).collect()[0].r is None


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(num.round_half_even("x")).collect()] == [0.0, 2.0, 2.0]


def test_sign_label_null(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(num.sign_label("a", "b")).collect()] == ["negative", "positive", "negative", None]


def test_strip_reply_prefix_first_line_with_colon(spark):
    df = spark.createDataFrame([("x\nReply to @u: hi: there\nlater: y",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.strip_reply_prefix("t")).collect()] == ["x\n: there\nlater: y", "none", None]


def test_device_rules(spark):
    df = spark.createDataFrame([("shop_desktop",), ("shop_mobile",), ("plan_offer",)], "s string")
    rules = [(".*desktop$", "desktop"), (".*mobile$", "mobile"), (".*plan*", "both")]
    assert [r[0] for r in df.select(tx.relabel("s", rules)).collect()] == ["desktop", "mobile", "both_offer"]
    assert [r[0] for r in df.select(tx.base_name("s", ["shop"], ["desktop", "mobile"])).collect()] == ["shop", "shop", "plan_offer"]


def test_split_path_missing_piece(spark):
    df = spark.createDataFrame([("/fr/825",), ("news",), (None,)], "path string")
    assert [tuple(r) for r in cl.split_path_columns(df, "path").collect()] == [("", "fr"), ("news", None), (None, None)]


def test_clean_corpus(spark):
    df = spark.createDataFrame([("The  CAT, isn't 42 a\tdog!",)], "t string")
    assert df.select(tx.clean_corpus("t", ["the", "a"])).collect()[0][0] == "cat isnt dog"


def test_filters_and_null(spark):
    df = spark.createDataFrame([(1, "test it"), (2, None), (3, "Testing"), (4, "a test"), (5, "NA")], "row_id int, t string")
    assert [r[0] for r in rows(cl.filter_not_regex(df, "t", "^test.*", lower=True))] == [4, 5]
    assert [r[0] for r in rows(cl.filter_not_in(df, "t", ["NA"]), "row_id")] == [1, 2, 3, 4]
    assert [r[0] for r in rows(cl.filter_not_null(df, "t", also_literal_na=True))] == [1, 3, 4]
    assert [r[0] for r in rows(cl.filter_row_id_not(df, "row_id", "3"), "row_id")] == [1, 2, 4, 5]
    assert cl.standardize_columns(df.toDF("Row Id", "The\tText")).columns == ["row_id", "the_text"]


def test_unpivot_drops_unanswered(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, None), (3, None, None)], "row_id int, a boolean, b boolean")
    assert rows(rs.unpivot_choices(df, ["row_id"], ["a", "b"])) == [(1, "a", 0), (1, "b", 1)]
    assert rows(rs.concat_choices(df, ["row_id"], ["a", "b"])) == [(1, "a,b")]
    joined = rs.full_join_blocks(rs.unpivot_choices(df, ["row_id"], ["a"]), df.select("row_id"), ["row_id"])
    assert {r.row_id: r.category for r in joined.collect()} == {1: "a", 2: None, 3: None}


def test_median_and_boxplot(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4, 100)] + [("b", 7), ("b", None)], "g string, x int")
    got = {r.g: r for r in st.boxplot_stats(df, "x", "g").collect()}
    assert (got["a"].lower, got["a"].middle, got["a"].upper, got["a"].ymin, got["a"].ymax, got["a"].outliers) == (2, 3, 4, 1, 4, 1)
    assert (got["b"].ymin, got["b"].ymax, got["b"].outliers) == (7, 7, 0)
    assert rows(st.boxplot_outliers(df, "x", "g")) == [("a", 100, 1)]
    assert {r.g: r.median for r in st.median(df, "x", "g").collect()} == {"a": 3.0, "b": 7.0}


def test_freq_polygon_of_equal_values(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5)], "g string, x int")
    got = st.freq_polygon(df, "x", "g", bins=3, density=True).orderBy("bin").collect()
    assert [(r.bin, r.n, r.density) for r in got] == [(0, 2, None), (1, 0, None), (2, 0, None)]


def test_edges_and_vertices(spark):
    pairs = spark.createDataFrame([("a", "b", "s1", 5), ("a", "b", "s2", 1), ("b", "c", "s1", 9), ("a", None, "s1", 9)],
                                  "word1 string, word2 string, segment string, n int")
    assert rows(nw.bigram_edges(pairs, 1)) == [("a", "b", 2)]
    assert rows(nw.bigram_edges(pairs, 1, "occurrences")) == [("a", "b", 6), ("b", "c", 9)]
    assert rows(nw.bigram_vertices(nw.bigram_edges(pairs, 0))) == [("a",), ("b",), ("c",)]


def test_overrides(spark):
    lex = lx.score_lexicon(spark, {"a": 1, "b": 2})
    assert rows(sn.override_scores(lex, {"a": -1})) == [("a", -1.0), ("b", 2.0)]
    polar = spark.createDataFrame([("a", "positive", 3), ("b", "positive", 2), ("c", "negative", 1)], "word string, sentiment string, n int")
    assert rows(sn.override_polarity(polar, {"a": "negative"}, ["b"])) == [("a", "negative", 3), ("c", "negative", 1)]


def test_common_and_paired(spark):
    counts = spark.createDataFrame([("w", "x", 5), ("w", "y", 2), ("v", "x", 1)], "word string, cat string, n int")
    assert rows(ct.common_terms(counts, "word", "cat", "x", "y")) == [("w", 5, 2)]
    assert rows(ct.paired_counts(counts, "word", "cat", "x", "y")) == [("w", 5, 2, 3)]


def test_collapse_labels(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 8), ("b", 1, 7), (None, 1, 6)], "g string, o int, v int")
    got = {r.v: r.g for r in tn.collapse_repeated_labels(df, "g", ["o"]).collect()}
    assert got == {9: "a", 8: "", 7: "b", 6: None}


def test_csv_round_trip(spark):
    path = scratch.scratch_path(spark, "csv-test")
    df = spark.createDataFrame([(1, 'say "hi",\nthen go '), (2, " x"), (3, "back\\slash")], "id long, text string")
    rd.write_csv(df, path)
    assert rows(rd.scan_csv(spark, path, "id long, text string", multi_line=True)) == rows(df)


def test_scan_except_cast_and_date(spark):
    df = spark.createDataFrame([(12345678901234, "a", 1560000000000)], "id long, t string, ms long")
    out = rd.scan_except_cast(df, "id")
    assert out.columns == ["t", "ms", "id"] and out.collect()[0].id == "12345678901234"
    assert df.select(rd.date_from_millis("ms").alias("d")).collect() == [Row(d=datetime.date(2019, 6, 8))]


def test_lexicons(spark):
    from verbatim.plans.base import ENGLISH

    assert sorted(ENGLISH) == sorted(lx.stop_word_list("english"))
    raw = spark.createDataFrame([(" Good ", "3"), ("good", "3"), (None, "1"), ("bad", "x")], "w string, v string")
    assert rows(lx.normalise_lexicon(raw, "v", "score", word="w", to="double")) == [("good", 3.0)]


def test_long_chains_of_pieces_and_long_lines(spark, tmp_path):
    path = str(tmp_path / "long")
    spark.createDataFrame([(1, "a." * 100_000), (2, "x" * 1_000_000), (3, "one\nto: b: c\nd: e")], "id int, text string").write.parquet(path)
    df = spark.read.parquet(path)
    sizes = {r.id: (r.n, r.first) for r in df.select("id", F.size(tx.word_array("text")).alias("n"), F.length(F.get(tx.word_array("text"), F.lit(0))).alias("first")).collect()}
    assert sizes[1] == (1, 199_999) and sizes[2] == (1, 1_000_000)
    cut = {r.id: r.t for r in df.select("id", tx.strip_reply_prefix("text").alias("t")).collect()}
    assert cut[2] == "x" * 1_000_000 and cut[3] == "one\n: c\nd: e"


def test_stop_words_from_a_table(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "the and"), (3, None), (1, "a cat")], "id int, text string")
    stops = ["the", "and"]
    frame = lx.word_frame(spark, stops)
    for make in (lambda s: tk.word_tokens(df, "text", stop_words=s), lambda s: tk.ngrams(df, "text", 2, stop_words=s), lambda s: tk.rejoined_text(df, "text", s)):
        assert Counter(map(tuple, make(stops).collect())) == Counter(map(tuple, make(frame).collect()))
    assert rows(tk.pairs_without_stop_parts(df, "text", stops)) == rows(tk.pairs_without_stop_parts(df, "text", frame))


def test_sentences_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "good day. bad."), (1, "good"), (None, "not good"), (None, "")], "id int, text string")
    weights = {"good": 1.0, "bad": -1.0}
    table = spark.createDataFrame(list(weights.items()), "word string, weight double")
    shifters = sn.Shifters(negators=["not"])
    want = Counter([(1, 1, 2, round(2**-0.5, 9)), (1, 2, 1, -1.0), (1, 1, 1, 1.0), (None, 1, 2, round(-(2**-0.5), 9))])
    for lexicon in (weights, table):
        got = sn.sentence_sentiment(df, "id", "text", lexicon, shifters).collect()
        assert Counter((r.id, r.sentence_id, r.word_count, round(r.sentiment, 9)) for r in got) == want


def test_top_facets_and_overrides_from_tables(spark):
    df = spark.createDataFrame([(f"w{i}", "a", 5) for i in range(15)] + [("x", "b", 1), (None, "b", 9)], "word string, g string, n int")
    assert tn.top_n(df, 10, "n", by=["g", "word"]).count() == 17
    assert sorted(r.ord for r in tn.top_facets(df, 3, "word", "g").where("g = 'a'").collect()) == list(range(1, 16))
    three = spark.createDataFrame([("w", "a", k) for k in (3, 3, 2, 1)], "word string, g string, n int")
    assert rows(tn.top_n_per_term_group(three, 2, "n", "g", "word")) == [("w", "a", 3), ("w", "a", 3)]
    lex = lx.score_lexicon(spark, {"a": 1, "b": 2})
    assert rows(sn.override_scores(lex, spark.createDataFrame([("a", -1)], "word string, score int"))) == [("a", -1.0), ("b", 2.0)]


def test_checkpoint_dir_is_the_sessions(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert scratch.scratch_path(spark, "x").startswith(folder)


def test_grams_of_short_empty_and_null_rows(spark):
    """Each row gives its n-grams with what it carries, whatever the columns are called; one null if it has too few words."""
    df = spark.createDataFrame([(1, "A b c d"), (2, "one"), (3, ""), (4, None), (5, "x y"), (5, "x y")], "w1 int, t string")
    assert rows(tk.ngrams(df, "t", 3), "w1", "ngram") == [(1, "a b c"), (1, "b c d"), (2, None), (3, None), (4, None), (5, None), (5, None)]
    assert rows(tk.ngrams(df, "t", 1), "w1", "ngram") == [
        (1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "one"), (3, None), (4, None), (5, "x"), (5, "x"), (5, "y"), (5, "y")
    ]
    assert rows(tk.ngrams(df, "t", 2, keep_short=False), "w1", "ngram") == [(1, "a b"), (1, "b c"), (1, "c d"), (5, "x y"), (5, "x y")]
    assert rows(tk.pairs_without_stop_parts(df, "t", ["b"]), "w1", "word1", "word2") == [(1, "c", "d"), (5, "x", "y"), (5, "x", "y")]


def test_grams_are_joined_as_rows(spark):
    """No lambda runs for each n-gram: they are zipped, and joined in generated code."""
    df = spark.createDataFrame([("a b c",)], "t string")
    for made in (tk.ngrams(df, "t", 3), tk.pairs_without_stop_parts(df, "t", [])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "arrays_zip" in plan and "zip_with" not in plan and "sequence" not in plan
