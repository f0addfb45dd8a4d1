"""Queries for topic models and for the tables read from a beta table."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession, functions as F

from verbatim.operators import counts as ct, tokens as tk, topics as tp
from verbatim.operators.keyed import SALTS, attach
from verbatim.plans.base import ENGLISH, query, rounded, table, tokens


ITERATIONS = 2  # of the queries whose SQL twins write the steps out
TOLERANCE = 1e-3  # of the fits that stop by themselves and have no SQL twin
SETTLED = 1e-5  # of those that have one
_MODELS: WeakKeyDictionary[SparkSession, dict[tuple, tp.TopicModel]] = WeakKeyDictionary()


def _cells(spark, sf, document):
    arrays = tk.with_word_array(table(spark, sf, "documents", "text", document), "text", stop_words=ENGLISH)
    return tp.document_cells(arrays, document)


def _fitted(spark, sf, document, k, **how):
    """A model is fitted once in a session; all queries that read it share it."""
    models = _MODELS.setdefault(spark, {})
    key = (sf, document, k, *sorted(how.items()))
    if key not in models:
        cells, documents = _cells(spark, sf, document)
        models[key] = tp.fit_topics(cells, documents, document, k, **how)
    return models[key]


def _settled(spark, sf, document, k):
    """A fit of as many steps as the likelihood takes to settle."""
    return _fitted(spark, sf, document, k, iterations=None, tolerance=SETTLED)


def _per_response(spark, sf):
    """Two topics with one document per response."""
    return _settled(spark, sf, "doc_id", 2)


def _per_section(spark, sf):
    """Four topics with one document per source."""
    return _settled(spark, sf, "source", 4)


def _per_section_begun(spark, sf):
    """The same after the steps that the SQL twins of ``fit_topics`` and ``topic_prevalence`` write out."""
    return _fitted(spark, sf, "source", 4, iterations=ITERATIONS, tolerance=None)


def _steps(document: str, k: int) -> str:
    """The steps of the fit as common table expressions ``shares`` and ``weights``."""
    topics = [f"t{i}" for i in range(1, k + 1)]
    each = lambda form, sep=", ": sep.join(form.format(t=t, i=i + 1) for i, t in enumerate(topics))
    start = each("1e0 + CAST('0x' || substr(md5(term || ':{i}'), 1, 8) AS BIGINT) / 4294967296e0 AS {t}")
    sql = f""", cells AS MATERIALIZED (SELECT {document}, word AS term, count(*) AS n FROM nostop GROUP BY ALL),
    everyone AS (SELECT DISTINCT {document} FROM documents),
    weights0 AS (SELECT term, {start} FROM (SELECT DISTINCT term FROM cells)),
    shares0 AS (SELECT {document}, {each(f"{1 / k!r}::DOUBLE AS {{t}}")} FROM everyone)"""
    for step in range(ITERATIONS):
        whole = "(" + each("w.{t} * s.{t}", " + ") + ")"
        priors = " + ".join(f"coalesce(p.{t}, 0) + {tp.DOCUMENT_PRIOR}e0" for t in topics)
        sql += f""", parts{step} AS MATERIALIZED (SELECT c.{document}, c.term, {each(f"c.n * (w.{{t}} * s.{{t}}) / {whole} AS {{t}}")}
      FROM cells c JOIN weights{step} w USING (term) JOIN shares{step} s USING ({document})),
    byterm{step} AS MATERIALIZED (SELECT term, {each("sum({t}) AS {t}")} FROM parts{step} GROUP BY term),
    totals{step} AS (SELECT {each("sum({t}) AS s{t}")}, count(*) AS v FROM byterm{step}),
    weights{step + 1} AS MATERIALIZED (SELECT term, {each(f"({{t}} + {tp.TERM_PRIOR}e0) / (s{{t}} + {tp.TERM_PRIOR}e0 * v) AS {{t}}")} FROM byterm{step}, totals{step}),
    bydoc{step} AS (SELECT {document}, {each("sum({t}) AS {t}")} FROM parts{step} GROUP BY {document}),
    shares{step + 1} AS MATERIALIZED (SELECT e.{document}, {each(f"(coalesce(p.{{t}}, 0) + {tp.DOCUMENT_PRIOR}e0) / ({priors}) AS {{t}}")}
      FROM everyone e LEFT JOIN bydoc{step} p USING ({document}))"""
    beta = " UNION ALL ".join(f"SELECT {i} AS topic, term, round({t}, 10) AS beta FROM weights{ITERATIONS}" for i, t in enumerate(topics, 1))
    gamma = " UNION ALL ".join(f"SELECT {document}, {i} AS topic, round({t}, 9) AS gamma FROM shares{ITERATIONS}" for i, t in enumerate(topics, 1))
    return f"{sql}, fitted AS ({beta}), gammas AS ({gamma})"


def _whole(document: str, k: int) -> str:
    """The fit until the likelihood settles as common table expressions ``fitted`` and ``gammas``."""
    topics = [f"t{i}" for i in range(1, k + 1)]
    each = lambda form, sep=", ": sep.join(form.format(t=t, i=i) for i, t in enumerate(topics, 1))
    whole = "(" + each("w.{t} * s.{t}", " + ") + ")"
    priors = each(f"coalesce(p.{{t}}, 0) + {tp.DOCUMENT_PRIOR}e0", " + ")
    start = each("1e0 + CAST('0x' || substr(md5(term || ':{i}'), 1, 8) AS BIGINT) / 4294967296e0 AS {t}")
    names = ", ".join(topics)
    return f""", cells AS MATERIALIZED (SELECT {document}, word AS term, count(*) AS n FROM nostop GROUP BY ALL),
    everyone AS MATERIALIZED (SELECT DISTINCT {document} FROM documents),
    model AS MATERIALIZED (WITH RECURSIVE run AS (
      SELECT * FROM (SELECT 0 AS step, NULL::DOUBLE AS l0, NULL::DOUBLE AS l1, NULL::DOUBLE AS l2) first, (
        SELECT TRUE AS of_term, NULL AS {document}, term, {start} FROM (SELECT DISTINCT term FROM cells)
        UNION ALL SELECT FALSE, {document}, NULL, {each(f"{1 / k!r}::DOUBLE")} FROM everyone)
      UNION ALL SELECT * FROM (WITH
        parts AS MATERIALIZED (SELECT c.{document}, c.term, {each(f"c.n * (w.{{t}} * s.{{t}}) / {whole} AS {{t}}")}, c.n * ln({whole}) AS l
          FROM cells c JOIN (SELECT term, {names} FROM run WHERE of_term) w USING (term) JOIN (SELECT {document}, {names} FROM run WHERE NOT of_term) s USING ({document})),
        byterm AS MATERIALIZED (SELECT term, {each("sum({t}) AS {t}")}, sum(l) AS l FROM parts GROUP BY term),
        bydoc AS (SELECT {document}, {each("sum({t}) AS {t}")} FROM parts GROUP BY {document}),
        totals AS MATERIALIZED (SELECT {each("sum({t}) AS s{i}")}, sum(l) AS l, count(*) AS v FROM byterm),
        steps AS MATERIALIZED (SELECT b.step + 1 AS step, b.l1 AS l0, b.l2 AS l1, l AS l2 FROM (SELECT DISTINCT step, l1, l2 FROM run) b, totals WHERE v > 0),
        further AS MATERIALIZED (SELECT * FROM steps WHERE NOT coalesce(
          abs(l2 - l1) <= abs(l1 - l0) AND abs(l1 - l0) <= {SETTLED!r}::DOUBLE * abs(l0) AND abs(l2 - l1) <= {SETTLED!r}::DOUBLE * abs(l1), FALSE))
        SELECT f.*, TRUE, NULL, term, {each(f"({{t}} + {tp.TERM_PRIOR}e0) / (s{{i}} + {tp.TERM_PRIOR}e0 * v)")} FROM byterm, totals, further f
        UNION ALL SELECT f.*, FALSE, e.{document}, NULL, {each(f"(coalesce(p.{{t}}, 0) + {tp.DOCUMENT_PRIOR}e0) / ({priors})")}
          FROM everyone e LEFT JOIN bydoc p USING ({document}), further f))
      SELECT * FROM run WHERE step = (SELECT max(step) FROM run)),
    fitted AS ({each("SELECT {i} AS topic, term, round({t}, 10) AS beta FROM model WHERE of_term", " UNION ALL ")}),
    gammas AS ({each(f"SELECT {document}, {{i}} AS topic, round({{t}}, 9) AS gamma FROM model WHERE NOT of_term", " UNION ALL ")})"""


_RESPONSES, _SECTIONS, _SECTIONS_BEGUN = _whole("doc_id", 2), _whole("source", 4), _steps("source", 4)
_TOP = "SELECT * FROM fitted QUALIFY rank() OVER (PARTITION BY topic ORDER BY beta DESC) <= 10"


def _beta(fit):
    return rounded(tp.topic_terms_beta(fit), "beta", digits=10)


def _gamma(fit):
    return rounded(tp.doc_topics_gamma(fit), "gamma", digits=9)


@query("fit_lda", _RESPONSES + _TOP)
def fit_lda(spark, sf):
    """Best ten terms of each of the two topics."""
    return tp.top_terms_per_topic(_beta(_per_response(spark, sf)), 10)


@query("fit_topics", _SECTIONS_BEGUN + _TOP)
def fit_topics(spark, sf):
    """Best ten terms of each of the four section topics."""
    return tp.top_terms_per_topic(_beta(_per_section_begun(spark, sf)), 10)


def fit_lda_converged(spark, sf):
    """Best ten terms of two topics, fitted until the likelihood stops."""
    return tp.top_terms_per_topic(_beta(_fitted(spark, sf, "doc_id", 2, tolerance=TOLERANCE, start="spectral")), 10)


def fit_topics_converged(spark, sf):
    """Best ten terms of four correlated section topics from a spectral start, fitted until the likelihood stops."""
    return tp.top_terms_per_topic(_beta(_fitted(spark, sf, "source", 4, tolerance=TOLERANCE, start="spectral", prior="correlated")), 10)


#: Fits that stop by themselves; SQL cannot write their steps out, so they are no registered queries. The bench times one.
CONVERGED = {"fit_lda_converged": fit_lda_converged, "fit_topics_converged": fit_topics_converged}


def _spectral(document: str, k: int, least: int) -> str:
    """The spectral start as common table expressions, up to ``started``."""
    sign = "(1 - 2 * ((h >> {i}) & 1))"
    over = lambda form: ", ".join(form.format(i=i, j=i + 1, sign=sign.format(i=i)) for i in range(tp.PROJECTION))
    topics = range(1, k + 1)
    sql = f""", cells AS MATERIALIZED (SELECT {document}, word AS term, count(*) AS n FROM nostop GROUP BY ALL),
    bits AS (SELECT *, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h FROM cells),
    signs AS MATERIALIZED (SELECT {document}, sum(n) AS size, {over("sum(n * {sign}) AS s{i}")} FROM bits GROUP BY {document}),
    cooc AS (SELECT term, {over("coalesce(sum(n * (s{i} - {sign}) / CAST(nullif(size * (size - 1), 0) AS DOUBLE)), 0) AS x{j}")},
      sum(n / CAST(size AS DOUBLE)) AS mass, count(*) AS documents FROM bits JOIN signs USING ({document}) GROUP BY term),
    pts AS MATERIALIZED (SELECT term, mass, documents, [{over("x{j} / mass")}] AS x FROM cooc),
    a1 AS MATERIALIZED (SELECT term, x FROM pts WHERE documents >= {least} ORDER BY round(list_dot_product(x, x), 9) DESC, term LIMIT 1),
    d1 AS MATERIALIZED (SELECT p.term, p.x, p.documents, list_transform(range(1, {tp.PROJECTION + 1}), lambda i: p.x[i] - a1.x[i]) AS d FROM pts p, a1)"""
    for t in range(2, k + 1):
        sql += f""", a{t} AS MATERIALIZED (SELECT term, x, d FROM d{t - 1} WHERE documents >= {least}
      AND term NOT IN ({" UNION ALL ".join(f"SELECT term FROM a{u}" for u in range(1, t))})
      ORDER BY round(list_dot_product(d, d), 9) DESC, term LIMIT 1)"""
        if t < k:
            sql += f""", d{t} AS MATERIALIZED (SELECT o.term, o.x, o.documents, list_transform(range(1, {tp.PROJECTION + 1}),
      lambda i: o.d[i] - list_dot_product(o.d, b.d) / list_dot_product(b.d, b.d) * b.d[i]) AS d FROM d{t - 1} o, a{t} b)"""
    pairs = [(i, j) for i in topics for j in topics]
    sql += f""", gram AS MATERIALIZED (SELECT *, 0.5e0 / greatest({", ".join(f"g{i}_{j}" for i, j in pairs)}) AS rate FROM (
      SELECT {", ".join(f"list_dot_product(a{i}.x, a{j}.x) AS g{i}_{j}" for i, j in pairs)} FROM {", ".join(f"a{i}" for i in topics)})),
    mix0 AS MATERIALIZED (SELECT p.term, mass, {", ".join(f"list_dot_product(p.x, a{i}.x) AS b{i}, {1 / k!r}::DOUBLE AS t{i}" for i in topics)}
      FROM pts p, {", ".join(f"a{i}" for i in topics)})"""
    bs, ts = ", ".join(f"b{i}" for i in topics), " + ".join(f"t{i}" for i in topics)
    for step in range(tp.MIXING_STEPS):
        raised = ", ".join(f"t{i} * exp(-2e0 * rate * ({' + '.join(f't{j} * g{i}_{j}' for j in topics)} - b{i})) AS t{i}" for i in topics)
        sql += f""", mix{step + 1} AS MATERIALIZED (SELECT term, mass, {bs}, {", ".join(f"t{i} / ({ts}) AS t{i}" for i in topics)}
      FROM (SELECT term, mass, {bs}, {raised} FROM mix{step}, gram))"""
    return sql + f""", started AS (SELECT term, {", ".join(f"t{i} * mass / sum(t{i} * mass) OVER () AS t{i}" for i in topics)} FROM mix{tp.MIXING_STEPS})"""


@query("spectral_start", _spectral("source", 4, 5) + "SELECT term, round(t1, 9) AS t1, round(t2, 9) AS t2, round(t3, 9) AS t3, round(t4, 9) AS t4 FROM started")
def spectral_start(spark, sf):
    """Term weights of the four section topics before any step."""
    cells, _ = _cells(spark, sf, "source")
    return rounded(tp.spectral_start(cells, "source", 4, 5), "t1", "t2", "t3", "t4", digits=9)


def _correlated(document: str) -> str:
    """Two steps of a fit of two correlated topics, up to ``moments{ITERATIONS}``."""
    sql = f""", cells AS MATERIALIZED (SELECT {document}, word AS term, count(*) AS n FROM nostop GROUP BY ALL),
    everyone AS (SELECT DISTINCT {document} FROM documents),
    weights0 AS (SELECT term, 1e0 + CAST('0x' || substr(md5(term || ':1'), 1, 8) AS BIGINT) / 4294967296e0 AS t1,
      1e0 + CAST('0x' || substr(md5(term || ':2'), 1, 8) AS BIGINT) / 4294967296e0 AS t2 FROM (SELECT DISTINCT term FROM cells)),
    shares0 AS (SELECT {document}, 0e0 AS e1, 0e0 AS e2, 0.5e0 AS p1, 0.5e0 AS p2 FROM everyone),
    inverse0 AS (SELECT 0e0 AS m1, 0e0 AS m2, 1e0 AS i11, 0e0 AS i12, 1e0 AS i22, 1e0 AS steep)"""
    soft = "exp(e1 - greatest(e1, e2)) / (exp(e1 - greatest(e1, e2)) + exp(e2 - greatest(e1, e2))) AS p1, exp(e2 - greatest(e1, e2)) / (exp(e1 - greatest(e1, e2)) + exp(e2 - greatest(e1, e2))) AS p2"
    for step in range(ITERATIONS):
        sql += f""", parts{step} AS MATERIALIZED (SELECT c.{document}, c.term, c.n * (w.t1 * s.p1) / (w.t1 * s.p1 + w.t2 * s.p2) AS t1,
      c.n * (w.t2 * s.p2) / (w.t1 * s.p1 + w.t2 * s.p2) AS t2 FROM cells c JOIN weights{step} w USING (term) JOIN shares{step} s USING ({document})),
    byterm{step} AS MATERIALIZED (SELECT term, sum(t1) AS t1, sum(t2) AS t2 FROM parts{step} GROUP BY term),
    totals{step} AS (SELECT sum(t1) AS s1, sum(t2) AS s2, count(*) AS v FROM byterm{step}),
    weights{step + 1} AS MATERIALIZED (SELECT term, (t1 + {tp.TERM_PRIOR}e0) / (s1 + {tp.TERM_PRIOR}e0 * v) AS t1,
      (t2 + {tp.TERM_PRIOR}e0) / (s2 + {tp.TERM_PRIOR}e0 * v) AS t2 FROM byterm{step}, totals{step}),
    bydoc{step} AS (SELECT {document}, sum(t1) AS t1, sum(t2) AS t2 FROM parts{step} GROUP BY {document}),
    move{step}_0 AS MATERIALIZED (SELECT {document}, coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2, e1, e2, p1, p2
      FROM shares{step} LEFT JOIN bydoc{step} USING ({document}))"""
        for k in range(tp.LOGIT_STEPS):
            sql += f""", move{step}_{k + 1} AS MATERIALIZED (SELECT {document}, t1, t2, e1, e2, {soft} FROM (SELECT {document}, t1, t2,
      e1 + (t1 - (t1 + t2) * p1 - ((e1 - m1) * i11 + (e2 - m2) * i12)) / ((t1 + t2) / 2 + steep) AS e1,
      e2 + (t2 - (t1 + t2) * p2 - ((e1 - m1) * i12 + (e2 - m2) * i22)) / ((t1 + t2) / 2 + steep) AS e2 FROM move{step}_{k}, inverse{step}))"""
        sql += f""", shares{step + 1} AS MATERIALIZED (SELECT {document}, e1, e2, p1, p2, 1 / ((t1 + t2) * p1 * (1 - p1) + i11) AS v1,
      1 / ((t1 + t2) * p2 * (1 - p2) + i22) AS v2 FROM move{step}_{tp.LOGIT_STEPS}, inverse{step}),
    moments{step + 1} AS MATERIALIZED (SELECT avg(e1) AS m1, avg(e2) AS m2, avg(e1 * e1) - avg(e1) * avg(e1) + avg(v1) AS c11,
      avg(e1 * e2) - avg(e1) * avg(e2) AS c12, avg(e2 * e2) - avg(e2) * avg(e2) + avg(v2) AS c22 FROM shares{step + 1}),
    inverse{step + 1} AS MATERIALIZED (SELECT *, (i11 + i22 + sqrt((i11 - i22) * (i11 - i22) + 4 * i12 * i12)) / 2 AS steep FROM (
      SELECT m1, m2, c22 / (c11 * c22 - c12 * c12) AS i11, -c12 / (c11 * c22 - c12 * c12) AS i12, c11 / (c11 * c22 - c12 * c12) AS i22 FROM moments{step + 1}))"""
    return sql


@query(
    "topic_correlations",
    _correlated("doc_id") + f"""SELECT a::INTEGER AS topic, b::INTEGER AS other, round(c, 7) AS covariance, round(c / sqrt(x * y), 7) AS correlation FROM (
    SELECT 1 AS a, 1 AS b, c11 AS c, c11 AS x, c11 AS y FROM moments{ITERATIONS} UNION ALL SELECT 1, 2, c12, c11, c22 FROM moments{ITERATIONS}
    UNION ALL SELECT 2, 2, c22, c22, c22 FROM moments{ITERATIONS})""",
)
def topic_correlations(spark, sf):
    """Covariance of the two topics' logits after two steps."""
    fit = _fitted(spark, sf, "doc_id", 2, iterations=ITERATIONS, tolerance=None, prior="correlated")
    return rounded(tp.topic_correlations(fit), "covariance", "correlation", digits=7)


@query("topic_terms_beta", _SECTIONS + "SELECT * FROM fitted")
def topic_terms_beta(spark, sf):
    return _beta(_per_section(spark, sf))


@query("doc_topics_gamma", _RESPONSES + "SELECT * FROM gammas")
def doc_topics_gamma(spark, sf):
    return _gamma(_per_response(spark, sf))


@query(
    "gamma_histogram",
    _RESPONSES + """, frame AS (SELECT min(gamma) AS low, (max(gamma) - min(gamma)) / 29 AS w FROM gammas),
    filled AS (SELECT topic, ceil((gamma - low) / w - 0.5)::BIGINT AS bin, count(*) AS n FROM gammas, frame GROUP BY ALL)
    SELECT g.topic, g.bin, coalesce(f.n, 0) AS n, round(low + g.bin * w, 6) AS centre
    FROM (SELECT topic, unnest(range(0, 30)) AS bin FROM (SELECT DISTINCT topic FROM gammas)) g
    LEFT JOIN filled f ON g.topic = f.topic AND g.bin = f.bin, frame""",
)
def gamma_histogram(spark, sf):
    return rounded(tp.gamma_histogram(_gamma(_per_response(spark, sf))), "centre")


@query("topic_prevalence", _SECTIONS_BEGUN + "SELECT topic, round(avg(gamma), 9) AS prevalence FROM gammas GROUP BY topic")
def topic_prevalence(spark, sf):
    return rounded(tp.topic_prevalence(tp.doc_topics_gamma(_per_section_begun(spark, sf))), "prevalence", digits=9)


# The tables below are read from a beta table that SQL can build as well: the
# share of each word in each language.
_BETA = """, lw AS (SELECT lang AS topic, word AS term, count(*) AS n FROM nostop GROUP BY ALL),
beta AS (SELECT topic, term, n / CAST(sum(n) OVER (PARTITION BY topic) AS DOUBLE) AS beta FROM lw)
"""


def _language_beta(spark, sf):
    counts = ct.count_by(tokens(spark, sf, "lang"), "lang", "word")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return attach(counts, totals, "lang", salts=SALTS).select(
        F.col("lang").alias("topic"), F.col("word").alias("term"), (F.col("n") / F.col("total")).alias("beta")
    )


@query(
    "top_terms_per_topic",
    _BETA + """SELECT topic, term, round(beta, 12) AS beta FROM (SELECT * FROM beta
    QUALIFY rank() OVER (PARTITION BY topic ORDER BY beta DESC) <= 10)""",
)
def top_terms_per_topic(spark, sf):
    return rounded(tp.top_terms_per_topic(_language_beta(spark, sf), 10), "beta", digits=12)


@query(
    "topic_labels_frex",
    _BETA + """, ex AS (SELECT *, beta / list_reduce(list_sort(list(beta) OVER (PARTITION BY term)), lambda a, b: a + b) AS ex FROM beta),
    fr AS (SELECT topic, term, beta, 1 / (0.5e0 / cume_dist() OVER (PARTITION BY topic ORDER BY beta)
      + 0.5e0 / cume_dist() OVER (PARTITION BY topic ORDER BY ex)) AS frex FROM ex)
    SELECT topic, term, round(beta, 12) AS beta, round(frex, 12) AS frex FROM (
    SELECT * FROM fr QUALIFY rank() OVER (PARTITION BY topic ORDER BY frex DESC) <= 10)""",
)
def topic_labels_frex(spark, sf):
    return rounded(tp.topic_labels_frex(_language_beta(spark, sf), 10), "beta", "frex", digits=12)
