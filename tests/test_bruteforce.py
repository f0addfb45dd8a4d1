"""Operators against plain Python on random frames with one hot key."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from verbatim.operators import keyed, sentiment as sn, stats as st, tfidf as ti, topics as tp, topn as tn
from verbatim.plans.base import SHIFTERS, POLARITY
from verbatim.sources import lexicons as lx


def skewed_counts(seed=1, rows=3000):
    """(word, doc, part, n): one document and one word hold a third of the rows each."""
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        doc = "hot" if rng.random() < 0.4 else rng.choice([None, *[f"d{i}" for i in range(20)]])
        word = "the" if rng.random() < 0.35 else f"w{rng.randrange(300)}"
        out.append((word, doc, rng.randrange(4), rng.randrange(1, 4)))
    return out


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(skewed_counts(), "word string, doc string, part int, n int").cache()


@pytest.mark.parametrize("dedupe", [True, False])
def test_tf_idf(spark, counts, dedupe):
    cells, copies = Counter(), Counter()
    for w, d, _, n in skewed_counts():
        cells[w, d] += n
        copies[w, d] += 1
    if dedupe:
        copies = Counter(dict.fromkeys(cells, 1))
    totals, spread = Counter(), Counter()
    for (w, d), n in cells.items():
        totals[d] += n * copies[w, d]
        spread[w] += copies[w, d]
    docs = len([d for d in totals if d is not None])
    want = Counter()
    for (w, d), n in cells.items():
        tf, idf = (None if d is None else n / totals[d]), math.log(docs / spread[w])
        want[w, d, n, None if tf is None else round(tf, 12), round(idf, 9)] += copies[w, d]
    got = Counter((r.word, r.doc, r.n, None if r.tf is None else round(r.tf, 12), round(r.idf, 9)) for r in ti.tf_idf(counts, "word", "doc", dedupe=dedupe).collect())
    assert got == want
    if dedupe:
        sums = defaultdict(float)
        for w, d, n, tf, _ in got:
            if d is not None:
                sums[d] += tf
        assert all(abs(v - 1) < 1e-9 for v in sums.values())


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("by", [None, "doc"])
def test_top_n(counts, k, by):
    groups = defaultdict(list)
    for r in skewed_counts():
        groups[r[1] if by else 0].append(r)
    want = Counter()
    for members in groups.values():
        cut = sorted((r[3] for r in members), reverse=True)[min(k, len(members)) - 1]
        want.update(r for r in members if r[3] >= cut)
    assert Counter(tuple(r) for r in tn.top_n(counts, k, "n", by=by).collect()) == want


def test_group_sum_keeps_rows(counts):
    sums = Counter()
    for w, d, _, n in skewed_counts():
        sums[w, d] += n
    want = Counter((w, d, p, sums[w, d]) for w, d, p, _ in skewed_counts())
    assert Counter(tuple(r) for r in keyed.group_sum_keep_rows(counts, ["word", "doc"]).collect()) == want


def test_ordinals_by_group(spark):
    data = sorted({(w, d, n) for w, d, _, n in skewed_counts()}, key=str)
    df = spark.createDataFrame(data, "word string, doc string, n int")
    got = defaultdict(list)
    for r in tn.bar_order(df, "word", facet="doc").collect():
        got[r.doc].append((r.ord, r.n, r.word))
    for members in got.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1:] for m in members] == sorted(m[1:] for m in members)


def test_rank_fraction(counts):
    groups = defaultdict(list)
    for r in skewed_counts():
        groups[r[1]].append(r[3])
    want = Counter((*r, sum(v <= r[3] for v in groups[r[1]]) / len(groups[r[1]])) for r in skewed_counts())
    assert Counter(tuple(r) for r in keyed.rank_fraction(counts, "n", "doc").collect()) == want


def test_row_ids_are_dense_and_ordered(spark):
    keys = random.Random(3).sample(range(10**12), 5000)
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string").repartition(13)
    got = sorted((r.row_id, r.k, r.v) for r in keyed.add_row_id(df, "k").collect())
    assert got == [(i + 1, k, str(k)) for i, k in enumerate(sorted(keys))]


def test_attach_salted_equals_plain(spark, counts):
    lookup = counts.groupBy("doc").count()
    plain = sorted(map(str, keyed.attach(counts, lookup, "doc", "left").collect()))
    assert plain == sorted(map(str, keyed.attach(counts, lookup, "doc", "left", salts=16).collect()))
    assert len(plain) == len(skewed_counts())


@pytest.mark.parametrize("seed, small", [(1, True), (2, True), (2, False)])
def test_sentence_scores(spark, seed, small):
    rng = random.Random(seed)
    vocab = list(POLARITY) + ["no", "is", "with", "by", "for", "stone", "river"]
    texts = []
    for i in range(60):
        parts = [rng.choice(vocab) + rng.choice(["", "", "", ",", ";", ":", ".", "!", "?"]) for _ in range(rng.randrange(1, 60))]
        texts.append((i, " ".join(parts).capitalize()))
    df = spark.createDataFrame(texts, "row_id int, text string")
    lex = lx.polarity_lexicon(spark, POLARITY).selectExpr("word", "if(sentiment = 'positive', 1.0, -1.0) as weight")
    if small:
        lex = {r.word: r.weight for r in lex.collect()}
    got = {(r.row_id, r.sentence_id): (r.word_count, round(r.sentiment, 9)) for r in sn.sentence_sentiment(df, "row_id", "text", lex, SHIFTERS).collect()}
    want = {}
    for i, text in texts:
        sentences = [s for s in (p.strip() for p in re.findall(r"[^.!?]+[.!?]*", text)) if s]
        for j, s in enumerate(sentences, 1):
            total = words = 0
            for clause in re.split("[,;:]", s):
                w = re.findall(r"[^\W]+", clause.lower())
                words += len(w)
                for k, word in enumerate(w):
                    if word not in POLARITY:
                        continue
                    before, after = w[max(k - 5, 0):k], w[k + 1:k + 3]
                    neg = sum(x in ("no", "is") for x in before + after) % 2
                    amp, deamp = (before + after).count("with"), (before + after).count("by")
                    up, down = 0.8 * amp * (1 - neg), max(-0.8 * (amp * neg + deamp), -1)
                    turn = 1 + 0.25 * (before.count("for") - after.count("for"))
                    total += (1 if POLARITY[word] == "positive" else -1) * (1 + up + down) * turn * (-1) ** neg
            want[i, j] = (words, round(total / math.sqrt(words), 9) if words else 0.0)
    assert got == want


def test_density_integrates_to_one(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else "cold", rng.randrange(1, 60)) for _ in range(800)] + [("tiny", 3)]
    df = spark.createDataFrame(data, "g string, x int")
    out = st.density_ridges(df, "x", "g").toPandas()
    assert set(out.g) == {"hot", "cold"} and len(out) == 2 * 512
    values = {g: np.array([x for h, x in data if h == g], float) for g in ("hot", "cold")}
    q = {g: np.percentile(v, [25, 75]) for g, v in values.items()}
    bw = np.mean([0.9 * min(v.std(ddof=1), (q[g][1] - q[g][0]) / 1.34) * len(v) ** -0.2 for g, v in values.items()])
    for g, part in out.groupby("g"):
        part = part.sort_values("point")
        assert abs(np.trapezoid(part.density, part.x) - 1) < 2e-3
        want = np.exp(-0.5 * ((part.x.to_numpy()[:, None] - values[g]) / bw) ** 2).sum(1) / (len(values[g]) * bw * math.sqrt(2 * math.pi))
        assert np.allclose(part.density, want)


def test_freq_polygon_counts_every_row(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), rng.randrange(0, 500)) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, x int")
    few = st.freq_polygon(df, "x", "g").toPandas()
    many = st.freq_polygon(df, "x", "g", few_values=False).toPandas()
    assert few.n.sum() == 2000 and len(few) == 60
    assert few.sort_values(["g", "bin"]).reset_index(drop=True).equals(many.sort_values(["g", "bin"]).reset_index(drop=True))


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(9)
    pools = [["cat", "dog", "bird", "fish"], ["tax", "vote", "law", "court"]]
    docs = [(i, [rng.choice(pools[i % 2]) for _ in range(40)]) for i in range(60)] + [(60, []), (None, ["cat"])]
    df = spark.createDataFrame(docs, "doc int, words array<string>")
    return tp.fit_topics(*tp.document_cells(df, "doc"), "doc", k=2, iterations=12)


def test_topic_model_tables(fitted):
    beta, gamma = tp.topic_terms_beta(fitted).toPandas(), tp.doc_topics_gamma(fitted).toPandas()
    assert np.allclose(beta.groupby("topic").beta.sum(), 1) and len(beta) == 16
    assert np.allclose(gamma.groupby("doc", dropna=False).gamma.sum(), 1) and len(gamma) == 124
    assert set(gamma[gamma.doc == 60].gamma) == {0.5}
    assert abs(tp.topic_prevalence(tp.doc_topics_gamma(fitted)).toPandas().prevalence.sum() - 1) < 1e-9
    assert tp.gamma_histogram(tp.doc_topics_gamma(fitted)).toPandas().n.sum() == 124
    tops = tp.top_terms_per_topic(tp.topic_terms_beta(fitted), 4).toPandas().groupby("topic").term.agg(set)
    assert sorted(map(sorted, tops)) == [["bird", "cat", "dog", "fish"], ["court", "law", "tax", "vote"]]
    assert len(tp.topic_labels_frex(tp.topic_terms_beta(fitted), 4).toPandas()) == 8
