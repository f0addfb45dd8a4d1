"""Very long texts: bounded time in one text, and the same results as plain versions."""

import math
import random
import time

import pyarrow as pa
import pytest

from verbatim.llm import quality, secrets, suffixes, toxicity


def spent(call):
    start = time.perf_counter()
    out = call()
    return out, time.perf_counter() - start


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30))
    rows = [(k, f"{say(20)} token = {key()} {say(20)}" if k % 3 == 0 else say(40)) for k in range(90)]
    return secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_many_spans_in_one_text(field):
    rng = random.Random(1)
    lines = ["".join(rng.choice("0123456789abcdef") for _ in range(26)) for _ in range(100_000)]
    text = "\n".join(lines)
    (spans,), seconds = spent(lambda: secrets.found_spans(pa.array([text]), field))
    assert [s[1:] for s in spans if s[0] == "hex"] == [(27 * k, 27 * k + 26) for k in range(100_000)] and seconds < 60
    # What the field adds touches no span of the patterns.
    assert not any(s[0] == "crf" and any(a < s[2] and s[1] < b for _, a, b in secrets.base_spans(text)) for s in spans[:200])


def test_added_spans_are_no_bare_signs(field):
    for text in ("so it ends |", "token = | here", "a | b"):
        assert not any(k == "crf" for k, _, _ in secrets.found_spans(pa.array([text]), field)[0])


def plain_hits(text, lexicon):
    """All entries by ``str.find``; the heaviest at each place counts, unless an exception phrase covers it."""
    found = {}
    for entry, weight in lexicon.weights.items():
        at = text.find(entry)
        while at >= 0:
            if at not in found or found[at][1] < weight:
                found[at] = (at + len(entry) - 1, weight)
            at = text.find(entry, at + 1)
    for phrase in lexicon.exceptions:
        at = text.find(phrase)
        while at >= 0:
            for start in [s for s, (end, _) in found.items() if at <= s and end <= at + len(phrase) - 1]:
                del found[start]
            at = text.find(phrase, at + 1)
    return found


def test_scores_equal_a_plain_scorer(spark):
    rng = random.Random(6)
    words = ["bad", "badly", "awful", "good", "nice", "not", "so", "grim", "grimly", "b4d", "BÄD", "аwful"]
    lexicon = toxicity.Lexicon({" bad": 2.0, " badly ": 3.5, " awful ": 1.25, " grim": 0.5}, (" not bad ", " so awful ", " bad good "), (-3.0, 0.7, 0.9))
    texts = ["", "...", " ".join(["not bad"] * 50)] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    automaton = lexicon.automaton()
    for text in texts:
        folded = toxicity.folded(text)
        want = plain_hits(folded, lexicon)
        assert toxicity.hits(folded, automaton) == want
        total, n = sum(w for _, w in want.values()), max(folded.count(" ") - 1, 0)
        score = 1 / (1 + math.exp(-(-3.0 + 0.7 * math.log1p(total) + 0.9 * math.log1p(1000 * total / (n + 50)))))
        assert lexicon.score_of(text, automaton) == (pytest.approx(score), len(want))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (3, texts[3])]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()
    assert sorted(((r.doc_id, r.n_hits) for r in got), key=str) == sorted(((k, lexicon.score_of(t, automaton)[1]) for k, t in rows), key=str)


def test_many_exceptions_in_one_text():
    lexicon = toxicity.Lexicon({" bad ": 2.0}, (" not bad ",), (-3.0, 0.7, 0.9))
    (found, seconds) = spent(lambda: toxicity.hits(toxicity.folded("not bad " * 200_000 + "bad"), lexicon.automaton()))
    assert len(found) == 1 and seconds < 30


def test_repeated_words_and_one_long_word(spark):
    texts = ["same " * 400_000, "x" * 2_000_000, "\n" * 2_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert got[0].n_words == got[0].n_repeat_words == 400_000 and got[0].base_failed
    assert (got[1].n_words, got[1].word_chars, got[2].n_words) == (1, 2_000_000, 0)


def test_one_long_periodic_text_is_cut(spark):
    rng = random.Random(4)
    text = "abcdefghij" * 50_000 + "".join(rng.choice("klmnop") for _ in range(500_000))
    row = suffixes.deduplicated(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # Strings start again ten bytes later, so all but the first ten bytes of the periodic part goes.
    assert (row.n_bytes, row.n_removed, row.n_spans) == (1_000_000, 500_000 - 10, 1)
