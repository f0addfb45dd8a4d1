"""Topic fits against numpy, and what a fit leaves behind."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.operators import topics as tp
from verbatim.plans import catalog
from verbatim.sources import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of one, two or three of three vocabularies that share some words, one without words and one without key."""
    rng = random.Random(3)
    pools = [[f"{c}{i}" for i in range(12)] + ["both", "all"] for c in "xyz"]
    rows = []
    for i in range(90):
        mix = rng.sample(range(3), rng.choice([1, 1, 2, 3]))
        rows.append((i, [rng.choice(pools[rng.choice(mix)]) for _ in range(rng.randrange(2, 60))]))
    df = spark.createDataFrame([*rows, (90, []), (None, ["x1", "both"])], "doc int, words array<string>")
    return tp.document_cells(df, "doc")


def table(df, key, columns):
    return {r[key]: np.array([r[c] for c in columns]) for r in df.collect()}


def test_steps_equal_numpy_and_gain(corpus):
    cells, documents = corpus
    k, topics = 3, ["t1", "t2", "t3"]
    got = tp.fit_topics(cells, documents, "doc", k, iterations=6, tolerance=None)
    weight = table(tp.hash_start(cells, k), "term", topics)
    rows = [(r.doc, r.term, r.n) for r in cells.collect()]
    share = {r.doc: np.full(k, 1 / k) for r in documents.collect()}
    history = []
    for _ in range(6):
        by_term, by_doc, total = {t: np.zeros(k) for t in weight}, {d: np.zeros(k) for d in share}, 0.0
        for d, t, n in rows:
            p = weight[t] * share[d]
            total += n * math.log(p.sum())
            by_term[t] += n * p / p.sum()
            by_doc[d] += n * p / p.sum()
        history.append(total)
        s = sum(by_term.values())
        weight = {t: (x + tp.TERM_PRIOR) / (s + tp.TERM_PRIOR * len(weight)) for t, x in by_term.items()}
        share = {d: (x + tp.DOCUMENT_PRIOR) / (x + tp.DOCUMENT_PRIOR).sum() for d, x in by_doc.items()}
    assert np.allclose(got.likelihood, history) and all(b > a for a, b in zip(got.likelihood[1:], got.likelihood[2:], strict=False))
    found = table(got.terms, "term", topics)
    assert all(np.allclose(found[t], weight[t]) for t in weight)
    found = table(got.documents, "doc", topics)
    assert all(np.allclose(found[d], share[d]) for d in share) and None in found


@pytest.mark.parametrize("prior", ["shares", "correlated"])
@pytest.mark.parametrize("start", ["hash", "spectral"])
def test_a_fit_stops_by_itself_and_separates(corpus, start, prior):
    cells, documents = corpus
    fit = tp.fit_topics(cells, documents, "doc", 3, tolerance=1e-4, start=start, prior=prior)
    assert 3 < len(fit.likelihood) < 100 and abs(fit.likelihood[-1] - fit.likelihood[-2]) <= 1e-4 * abs(fit.likelihood[-2])
    assert fit.likelihood[-1] > fit.likelihood[1]
    tops = {frozenset(t[0] for t in terms) for terms in (
        [r.term for r in tp.top_terms_per_topic(tp.topic_terms_beta(fit), 6).where(F.col("topic") == k).collect() if r.term not in ("both", "all")] for k in (1, 2, 3)
    )}
    assert tops == {frozenset("x"), frozenset("y"), frozenset("z")}
    assert np.allclose([r.s for r in tp.doc_topics_gamma(fit).groupBy("doc").agg(F.sum("gamma").alias("s")).collect()], 1)
    fit.remove()


def test_spectral_start_is_no_worse_than_the_hash(corpus):
    cells, documents = corpus
    last = {s: tp.fit_topics(cells, documents, "doc", 3, iterations=8, tolerance=None, start=s).likelihood for s in ("hash", "spectral")}
    assert last["spectral"][1] > last["hash"][1] and last["spectral"][-1] >= last["hash"][-1]


def test_cooccurrences_equal_all_pairs(corpus):
    cells, _ = corpus
    rows = [(r.doc, r.term, r.n) for r in cells.collect()]
    terms = sorted({t for _, t, _ in rows})
    place = {t: i for i, t in enumerate(terms)}
    whole = np.zeros((len(terms), len(terms)))
    for d in {d for d, _, _ in rows}:
        n = np.zeros(len(terms))
        for e, t, c in rows:
            if e == d:
                n[place[t]] += c
        size = n.sum()
        whole += (np.outer(n, n) - np.diag(n)) / (size * (size - 1))
    import hashlib

    bits = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in terms]
    signs = np.array([[1 if b >> i & 1 == 0 else -1 for i in range(tp.PROJECTION)] for b in bits])
    want = whole / whole.sum(1, keepdims=True) @ signs
    got = table(tp.projected_cooccurrences(cells, "doc"), "term", [f"x{i}" for i in range(1, tp.PROJECTION + 1)])
    assert all(np.allclose(got[t], want[place[t]]) for t in terms)


def test_logits_of_one_document(spark):
    """The stated steps equal plain ones, and many of them reach the mode."""
    mean, covariance = np.array([0.2, -0.1, 0.0]), np.array([[1.0, 0.3, 0.1], [0.3, 2.0, -0.4], [0.1, -0.4, 0.5]])
    counts, e = np.array([5.0, 0.5, 2.0]), np.array([0.1, 0.0, -0.2])
    df = spark.createDataFrame([(1, *counts.tolist(), *e.tolist())], "doc int, t1 double, t2 double, t3 double, e1 double, e2 double, e3 double")
    inverse = np.linalg.inv(covariance)
    steep, size = np.linalg.eigvalsh(inverse).max(), counts.sum()
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    objective = lambda x: counts @ x - size * math.log(np.exp(x).sum()) - (x - mean) @ inverse @ (x - mean) / 2
    values = [objective(e)]
    for _ in range(tp.LOGIT_STEPS):
        e = e + (counts - size * soft(e) - inverse @ (e - mean)) / (size / 2 + steep)
        values.append(objective(e))
    row = tp.logits_of(df, mean, covariance, ["t1", "t2", "t3"]).first()
    assert np.allclose([row.e1, row.e2, row.e3], e) and values == sorted(values)
    p = soft(e)
    assert np.allclose([row.v1, row.v2, row.v3], 1 / (size * p * (1 - p) + np.diag(inverse)))
    far = tp.logits_of(df, mean, covariance, ["t1", "t2", "t3"], steps=40).first()
    x = np.array([far.e1, far.e2, far.e3])
    assert np.abs(counts - size * soft(x) - inverse @ (x - mean)).max() < 1e-3


def test_correlations_follow_the_documents(spark):
    """Topics that share documents are correlated, those that exclude each other are not."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        pools = ["ab", "ab", "cd"][i % 3] if i % 3 < 2 else "cd"
        rows.append((i, [rng.choice(pools) + str(rng.randrange(8)) for _ in range(40)]))
    df = spark.createDataFrame(rows, "doc int, words array<string>")
    fit = tp.fit_topics(*tp.document_cells(df, "doc"), "doc", 2, start="spectral", prior="correlated")
    got = {(r.topic, r.other): r for r in tp.topic_correlations(fit).collect()}
    assert got[1, 1].correlation == pytest.approx(1) and got[1, 2].correlation < -0.3 and got[1, 1].covariance > 0
    with pytest.raises(ValueError, match="without correlated"):
        tp.topic_correlations(tp.fit_topics(*tp.document_cells(df, "doc"), "doc", 2, iterations=1))


def test_only_the_model_is_left(spark, corpus):
    cells, documents = corpus
    folder = Path(scratch.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    fit = tp.fit_topics(cells, documents, "doc", 2, iterations=3, tolerance=None, start="spectral")
    assert len(set(folder.iterdir()) - before) == 2 and fit.terms.count() > 0
    fit.remove()
    assert set(folder.iterdir()) == before


def test_no_words_and_too_few_anchors(spark, corpus):
    none = spark.createDataFrame([(1, []), (2, None)], "doc int, words array<string>")
    fit = tp.fit_topics(*tp.document_cells(none, "doc"), "doc", 2)
    assert fit.terms.count() == 0 and fit.likelihood == () and {(r.t1, r.t2) for r in fit.documents.collect()} == {(0.5, 0.5)}
    with pytest.raises(ValueError, match="fewer than"):
        tp.spectral_start(corpus[0], "doc", 3, least_documents=1000)


@pytest.mark.parametrize("prior", ["shares", "correlated"])
def test_rare_terms_are_fitted_like_common_ones(corpus, monkeypatch, prior):
    """However few terms are broadcast, the fit is the same."""
    cells, documents = corpus
    fits = []
    for most in (tp.COMMON_TERMS, 7, 0):
        monkeypatch.setattr(tp, "COMMON_TERMS", most)
        fits.append(tp.fit_topics(cells, documents, "doc", 2, iterations=2, tolerance=None, prior=prior))
    for key, of in (("term", "terms"), ("doc", "documents")):
        first, *others = [table(getattr(f, of), key, ["t1", "t2"]) for f in fits]
        assert all(set(o) == set(first) and all(np.allclose(o[x], first[x]) for x in first) for o in others)
    assert np.allclose(fits[0].likelihood, fits[1].likelihood) and np.allclose(fits[0].likelihood, fits[2].likelihood)


def test_common_terms_are_bounded_and_the_commonest(corpus, monkeypatch):
    cells, _ = corpus
    cells = cells.where("term is not null")
    monkeypatch.setattr(tp, "COMMON_TERMS", 7)
    counted, vocabulary, common, rare = tp._numbered(cells, "doc")
    size = {r.term: r.n for r in cells.groupBy("term").agg(F.count("*").alias("n")).collect()}
    often = {r.term for r in vocabulary.where("_common").collect()}
    assert 0 < len(often) <= 7 and min(size[t] for t in often) > max(n for t, n in size.items() if t not in often)
    assert common.count() == sum(size[t] for t in often) and common.count() + rare.count() == cells.count()
    scratch.discard(counted, common, rare)


def test_a_step_sums_both_ways_in_one_pass(spark, corpus, monkeypatch):
    """A step writes its sums once, reading common and rare cells once each; cells of common terms are not shuffled by term."""
    seen = []
    whole = tp._sums
    monkeypatch.setattr(tp, "_sums", lambda *a: seen.append(whole(*a)) or seen[-1])
    tp.fit_topics(*corpus, "doc", 2, iterations=1, tolerance=None).remove()
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and plan.count("Expand") == 1 and "rightHint=(strategy=broadcast)" in plan


def plain_fit(words, k):
    """Weights of terms and shares of documents after as many steps as the likelihood takes to settle, and its values."""
    n = {d: {t: ws.count(t) for t in sorted(set(ws))} for d, ws in words.items()}
    bits = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    weight = {t: np.array([1 + bits(f"{t}:{i}") / 2**32 for i in range(1, k + 1)]) for c in n.values() for t in c}
    share, history = {d: np.full(k, 1 / k) for d in n}, []
    while True:
        by_term, by_doc, total = {t: np.zeros(k) for t in weight}, {d: np.zeros(k) for d in n}, 0.0
        for d, c in n.items():
            for t, m in c.items():
                p = weight[t] * share[d]
                total += m * math.log(p.sum())
                by_term[t] += m * p / p.sum()
                by_doc[d] += m * p / p.sum()
        history.append(total)
        gains = np.abs(np.diff(history))
        if len(gains) > 1 and gains[-1] <= gains[-2] and all(gains[-2:] <= 1e-5 * np.abs(history[-3:-1])):
            return weight, share, history
        s = sum(by_term.values())
        weight = {t: (x + tp.TERM_PRIOR) / (s + tp.TERM_PRIOR * len(weight)) for t, x in by_term.items()}
        share = {d: (x + tp.DOCUMENT_PRIOR) / (x + tp.DOCUMENT_PRIOR).sum() for d, x in by_doc.items()}


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """A folder with documents of four subjects, one of them in two rows and one without words; and (document, source, words) of the rows."""
    rng = random.Random(8)
    rows = []
    for i in range(48):
        pool = [f"{'klmn'[i % 4]}{j}" for j in range(10)] + ["rain", "snow", "hail"]
        rows.append((i, f"src{i % 12}", [rng.choice(pool) for _ in range(rng.randrange(20, 60))]))
    rows += [(0, "src0", ["k1", "rain", "k2"]), (48, "src12", [])]
    folder = str(tmp_path_factory.mktemp("told"))
    texts = [(d, " ".join(ws), "en", s, len(" ".join(ws))) for d, s, ws in rows]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def words_by(rows, place):
    words = {}
    for row in rows:
        words.setdefault(row[place], []).extend(row[2])
    return words


@pytest.fixture(scope="module")
def responses(told):
    return plain_fit(words_by(told[1], 0), 2)


def test_only_small_gains_that_fall_are_the_end():
    assert not tp.settled([-9.0, -8.0], 1e-2) and not tp.settled([9.0, -100.0, -99.99], 1e-2)
    assert not tp.settled([-100.0, -99.99, -99.97, -99.9], 1e-2)  # topics nearly alike
    assert not tp.settled([-100.0, -90.0, -89.9], 1e-2) and tp.settled([-100.0, -90.0, -89.9, -89.85], 1e-2)
    assert tp.settled([-5.0, -5.0, -5.0], 1e-5) and tp.settled([0.0, 0.0, 0.0], 1e-5)


def test_shares_of_a_settled_fit(spark, told, responses):
    _, share, history = responses
    assert len(history) > 10
    got = {(r.doc_id, r.topic): r.gamma for r in catalog.queries()["doc_topics_gamma"](spark, told[0]).collect()}
    assert got.keys() == {(d, i) for d in share for i in (1, 2)}
    assert all(np.allclose([got[d, 1], got[d, 2]], s, atol=1e-8) for d, s in share.items())


def test_best_terms_of_a_settled_fit(spark, told, responses):
    want = set()
    for i in range(2):
        beta = {t: round(w[i], 10) for t, w in responses[0].items()}
        least = sorted(beta.values())[-10]
        want |= {(i + 1, t) for t, b in beta.items() if b >= least}
    got = {(r.topic, r.term): r.beta for r in catalog.queries()["fit_lda"](spark, told[0]).collect()}
    assert got.keys() == want and all(np.isclose(b, responses[0][t][i - 1], atol=1e-9) for (i, t), b in got.items())


def test_histogram_of_a_settled_fit(spark, told, responses):
    gamma = [(i + 1, round(s[i], 9)) for s in responses[1].values() for i in range(2)]
    low, high = min(g for _, g in gamma), max(g for _, g in gamma)
    want = {(i, b): 0 for i in (1, 2) for b in range(30)}
    for i, g in gamma:
        want[i, math.ceil((g - low) / ((high - low) / 29) - 0.5)] += 1
    got = {(r.topic, r.bin): r.n for r in catalog.queries()["gamma_histogram"](spark, told[0]).collect()}
    assert got == want


def test_weights_of_a_settled_fit(spark, told):
    weight, _, history = plain_fit(words_by(told[1], 1), 4)
    assert len(history) > 10
    got = {(r.topic, r.term): r.beta for r in catalog.queries()["topic_terms_beta"](spark, told[0]).collect()}
    assert got.keys() == {(i, t) for t in weight for i in range(1, 5)}
    assert all(np.isclose(got[i + 1, t], w[i], atol=1e-8) for t, w in weight.items() for i in range(4))
