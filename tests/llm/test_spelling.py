"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from verbatim.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    without = defaultdict(set)
    for w in count:
        for k in range(len(w)):
            without[w[:k], w[k + 1 :]].add(w)
    near = defaultdict(set)
    for w in count:
        for k in range(len(w)):
            near[w] |= without[w[:k], w[k + 1 :]] - {w}
            short = w[:k] + w[k + 1 :]
            if short in count:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-count[o], o))
            if count[best] >= 10 * count[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), count[form[w]] if w in form else None) for w, n in count.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = []
    for _ in range(60):
        word = "".join(rng.choice("abéz") for _ in range(rng.randrange(6, 12)))
        words += [word] * rng.choice([1, 2, 30, 300])
        for _ in range(6):
            k, c = rng.randrange(len(word) + 1), rng.choice("abézÿÀ")
            words += [rng.choice([word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word[:k] + word[k + 1 :]])] * rng.choice([1, 2, 4, 25])
    words += ["a" * n for n in (6, 7, 8, 9, 10, 38, 39, 40, 41, 42, 43) for _ in range(3)] + ["ab" * n + "c" for n in (19, 20, 21) for _ in range(2)]
    long = "".join(rng.choice("abcd") for _ in range(300))
    words += [long] * 30 + [long[:k] + "e" + long[k + 1 :] for k in (0, 150, 299) for _ in range(2)] + [long[:k] + long[k + 1 :] for k in (0, 7, 299) for _ in range(2)]
    words += [long[:90] + "f" + long[90:]] * 2 + [long[:90] + "g" + long[91:]] * 2
    rng.shuffle(words)
    made = [(k // 2, " ".join(words[40 * k : 40 * k + 40]) + rng.choice(["", "×÷ 12", "\n Wörter-Liste"])) for k in range(len(words) // 40 + 1)]
    return made + [(None, "nothing NOTHING nothinG"), (None, None), (3, ""), (4, None), made[0], made[0]]


@pytest.mark.parametrize("depth", [spelling.DEPTH, 8, 12])
def test_variants_equal_brute_force(spark, texts, monkeypatch, depth):
    monkeypatch.setattr(spelling, "DEPTH", depth)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, word string, n int")
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows_of(got) == plain(texts)


def test_documents_equal_brute_force(spark, documents, nothing):
    assert rows_of(spelling.variants(documents)) == plain([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert spelling.variants(nothing).count() == 0


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(spelling.variants(docs))
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]) and any(r[1] for r in got)


def test_very_long_words(spark):
    word = "".join(random.Random(2).choice("abcdefgh") for _ in range(1_000_000))
    other = word[:500_000] + "x" + word[500_001:]
    rows = [(10 * k, t) for k, t in enumerate([word] * 20 + [other] * 2 + ["b " * 500_000])]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40)) == sorted(
        [(word, None, word, 20, 1, None), (other, word, word, 2, 1, 20)]
    )
