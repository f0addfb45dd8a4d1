"""Topic models as tables, fitted by expectation maximisation.

A model is two DataFrames: the weights of each (document, topic) and of each (term,
topic), one row per document or term with one column per topic. Every step joins
them with the (document, term, n) cells, splits each cell's count among the topics,
and sums the parts both ways in one pass with partial aggregation. Terms have numbers
in the cells; the weights of common terms, bounded in number, are broadcast, so only
cells of rare terms are shuffled by term. Nothing as long as the vocabulary is ever on
the driver or in one row; the driver sees a few numbers per topic and step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from verbatim.operators.keyed import attach, rank_levels
from verbatim.operators.stats import freq_polygon
from verbatim.operators.topn import top_n
from verbatim.sources.scratch import discard, written

# What is added to each count of a document's and of a topic's weights.
DOCUMENT_PRIOR, TERM_PRIOR = 0.1, 0.01
#: Numbers that stand for a term's row of co-occurrences: its products with as many rows of signs.
PROJECTION = 32
#: Steps towards the mixture of anchors that a term is, and of a document's logits in one step of the fit.
MIXING_STEPS, LOGIT_STEPS = 15, 4
#: Terms at most whose weights are broadcast in a step, and cells of a term from which only the power of two counts for that choice.
COMMON_TERMS, EXACT_CELLS = 1 << 18, 1024


@dataclass(frozen=True)
class TopicModel:
    """Weights per document and per term in the columns t1 ... tk, each topic's terms and each document's topics adding up to 1.

    ``likelihood`` has the log-likelihood of all words before each step (the first of a
    hash start is of weights that do not add up to 1). A fit with
    correlated topics also has the mean and the covariance of the documents' logits.
    """

    documents: DataFrame
    terms: DataFrame
    document: str
    k: int
    likelihood: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    covariance: tuple[tuple[float, ...], ...] = ()

    def topics(self) -> list[str]:
        return [f"t{i}" for i in range(1, self.k + 1)]

    def remove(self) -> None:
        """Delete the written tables of the model."""
        discard(self.documents, self.terms)


def document_cells(docs: DataFrame, document: str, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """(document, term, n) counts of the word arrays, and all documents, also those without words."""
    cells = docs.select(document, F.explode(words).alias("term")).groupBy(document, "term").agg(F.count("*").alias("n"))
    return cells, docs.select(document).distinct()


def _bits(text: Column) -> Column:
    """The first 32 bits of an md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10)


def start_weight(term: Column | str, topic: int) -> Column:
    """A number from 1 to 2 that depends on term and topic alone: the first 32 bits of an md5."""
    text = F.concat(F.col(term) if isinstance(term, str) else term, F.lit(f":{topic}"))
    return 1.0 + _bits(text).cast("double") / float(1 << 32)


def hash_start(cells: DataFrame, k: int) -> DataFrame:
    """Term weights near 1 from a hash, the same in every run."""
    return cells.select("term").distinct().select("term", *[start_weight("term", i).alias(f"t{i}") for i in range(1, k + 1)])


def _total(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0])


# --- spectral start ---------------------------------------------------------

def projected_cooccurrences(cells: DataFrame, document: str) -> DataFrame:
    """(term, x1 ... x32, mass, documents): each term's row of co-occurrences, as shares, times 32 rows of signs.

    Two words of a document co-occur with weight one over its number of word pairs.
    The product with a term's signs needs the document's sum of signs only, so no
    pair of terms is ever formed. Signs come from a hash of the term.
    """
    names = [f"x{i}" for i in range(1, PROJECTION + 1)]
    bits = cells.where("term is not null").withColumn("_h", _bits(F.col("term")).cast("long"))
    sign = lambda i: F.when(F.shiftright("_h", i).bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)
    sums = [F.sum(F.col("n") * sign(i)).alias(f"_s{i}") for i in range(PROJECTION)]
    documents = bits.groupBy(F.col(document).alias("_d")).agg(F.sum("n").alias("_size"), *sums)
    both = bits.join(documents, F.col(document).eqNullSafe(F.col("_d")))
    pairs = F.nullif(F.col("_size") * (F.col("_size") - 1), F.lit(0)).cast("double")
    rows = both.groupBy("term").agg(
        *[F.coalesce(F.sum(F.col("n") * (F.col(f"_s{i}") - sign(i)) / pairs), F.lit(0.0)).alias(x) for i, x in enumerate(names)],
        F.sum(F.col("n") / F.col("_size")).alias("mass"), F.count("*").alias("documents"),
    )
    return rows.select("term", *[(F.col(x) / F.col("mass")).alias(x) for x in names], "mass", "documents")


def anchors(rows: DataFrame, k: int, least_documents: int = 5) -> tuple[list[str], np.ndarray]:
    """``k`` terms whose rows lie farthest apart, and those rows.

    The first is farthest from the origin, each next one from the span of those
    before; equal distances (to nine digits) go to the first term. Terms of few
    documents are no candidates.
    """
    names = [c for c in rows.columns if c.startswith("x")]
    able = rows.where(F.col("documents") >= least_documents)
    found: list[str] = []
    points: list[np.ndarray] = []
    base: list[np.ndarray] = []
    for _ in range(k):
        origin = points[0] if points else np.zeros(len(names))
        apart = [F.col(x) - float(o) for x, o in zip(names, origin, strict=True)]
        left = _total([d * d for d in apart])
        for b in base:
            along = _total([d * float(v) for d, v in zip(apart, b, strict=True)])
            left = left - along * along
        far = able.where(~F.col("term").isin(found)) if found else able
        best = far.agg(F.max(F.round(left, 9)).alias("_most")).first()["_most"]
        if best is None:
            raise ValueError(f"fewer than {k} terms occur in {least_documents} documents")
        row = far.where(F.round(left, 9) == best).agg(F.min(F.struct("term", *names)).alias("r")).first()["r"]
        point = np.array([row[x] for x in names])
        if points:
            direction = point - points[0]
            for b in base:
                direction = direction - (direction @ b) * b
            size = float(np.linalg.norm(direction))
            base.append(direction / size if size > 1e-9 else np.zeros(len(names)))
        found.append(row["term"])
        points.append(point)
    return found, np.array(points)


def mixtures(rows: DataFrame, points: np.ndarray, steps: int = MIXING_STEPS) -> DataFrame:
    """(term, mass, t1 ... tk): how much of each anchor a term's row is, by exponentiated gradient steps."""
    k = len(points)
    names, topics = [c for c in rows.columns if c.startswith("x")], [f"t{i}" for i in range(1, k + 1)]
    gram = points @ points.T
    rate = 0.5 / max(float(gram.max()), 1e-12)
    inner = [_total([F.col(x) * float(v) for x, v in zip(names, p, strict=True)]).alias(f"_b{t}") for p, t in zip(points, topics, strict=True)]
    out = rows.select("term", "mass", *inner, *[F.lit(1.0 / k).alias(t) for t in topics])
    carried = [F.col(c) for c in ("term", "mass", *[f"_b{t}" for t in topics])]
    for _ in range(steps):
        slope = [_total([F.col(u) * float(gram[i, j]) for j, u in enumerate(topics)]) - F.col(f"_b{t}") for i, t in enumerate(topics)]
        raised = [(F.col(t) * F.exp(-2.0 * rate * s)).alias(t) for t, s in zip(topics, slope, strict=True)]
        out = out.select(*carried, *raised)
        out = out.select(*carried, *[(F.col(t) / _total([F.col(u) for u in topics])).alias(t) for t in topics])
    return out.select("term", "mass", *topics)


def spectral_start(cells: DataFrame, document: str, k: int, least_documents: int = 5) -> DataFrame:
    """Term weights (term, t1 ... tk) from anchor terms.

    A term is a mixture of the anchors' rows of co-occurrences; its weight in a topic
    is its part of that anchor times how often it is used.
    """
    topics = [f"t{i}" for i in range(1, k + 1)]
    rows = written(projected_cooccurrences(cells, document), "topic-rows")
    _, points = anchors(rows, k, least_documents)
    mixed = written(mixtures(rows, points), "topic-mixtures")
    totals = mixed.agg(*[F.sum(F.col(t) * F.col("mass")).alias(t) for t in topics]).first()
    out = written(mixed.select("term", *[(F.col(t) * F.col("mass") / totals[t]).alias(t) for t in topics]), "topic-start")
    discard(rows, mixed)
    return out


# --- fit --------------------------------------------------------------------

def _numbered(cells: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The table written for the vocabulary, the vocabulary (term, _id, _common), and the cells (document, _id, n) of its common and of its rare terms.

    Common are the terms of most cells: all from the least number of cells on that
    leaves no more than ``COMMON_TERMS`` of them. The driver sees one count per number of cells,
    at most ``EXACT_CELLS`` and one per power of two.
    """
    counted = cells.groupBy("term").agg(F.count("*").alias("_cells"))
    counted = written(counted.withColumn("_id", F.monotonically_increasing_id()), "topic-terms")
    level = F.when(F.col("_cells") < EXACT_CELLS, F.col("_cells")).otherwise(EXACT_CELLS + F.length(F.bin("_cells")))
    least, room = EXACT_CELLS + 65, COMMON_TERMS
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= row["n"]
        if room < 0:
            break
        least = row["level"]
    vocabulary = counted.withColumn("_common", level >= least)
    often = F.broadcast(vocabulary.where("_common").select("term", "_id"))
    common = written(cells.join(often, "term").select(document, "_id", "n"), "topic-cells", codec="zstd")
    seldom = vocabulary.where(~F.col("_common")).select("term", "_id")
    rare = written(cells.join(often, "term", "left_anti").join(seldom, "term").select(document, "_id", "n"), "topic-cells", codec="zstd")
    return counted, vocabulary.select("term", "_id", "_common"), common, rare


def _sums(common: DataFrame, rare: DataFrame, terms: DataFrame, shares: DataFrame, document: str, topics: list[str]) -> DataFrame:
    """Each cell's count split among the topics and summed per document and per term (``_of_term``), with what the cells add to the log-likelihood."""
    left = shares.select(F.col(document).alias("_d"), *[F.col(t).alias(f"d{t}") for t in topics])
    parts = []
    for cells, often in ((common, True), (rare, False)):
        weights = terms.where(F.col("_common") == often).drop("_common")
        # the shares first: what is shuffled by document has no weights yet
        both = cells.join(left, F.col(document).eqNullSafe(F.col("_d"))).join(F.broadcast(weights) if often else weights, "_id")
        part = [F.col(t) * F.col(f"d{t}") for t in topics]
        whole = _total(part)
        each = [(F.col("n") * p / whole).alias(t) for t, p in zip(topics, part, strict=True)]
        parts.append(both.select("_d", "_id", F.lit(often).alias("_common"), *each, (F.col("n") * F.ln(whole)).alias("_l")))
    rows = parts[0].union(parts[1])
    sums = rows.groupingSets([[F.col("_d")], [F.col("_id"), F.col("_common")]], "_d", "_id", "_common")
    return sums.agg(F.grouping("_d").alias("_of_term"), *[F.sum(t).alias(t) for t in topics], F.sum("_l").alias("_l"))


def _shares_of(counts: DataFrame, documents: DataFrame, document: str, topics: list[str]) -> DataFrame:
    joined = documents.join(counts, F.col(document).eqNullSafe(F.col("_d")), "left")
    filled = [F.coalesce(F.col(t), F.lit(0.0)) + DOCUMENT_PRIOR for t in topics]
    return joined.select(document, *[(c / _total(filled)).alias(t) for t, c in zip(topics, filled, strict=True)])


def logits_of(counts: DataFrame, mean: np.ndarray, covariance: np.ndarray, topics: list[str], steps: int = LOGIT_STEPS) -> DataFrame:
    """Move each document's logits e1 ... ek towards their mode, given its words per topic t1 ... tk.

    The posterior is concave with curvature at most size / 2 plus the largest of the
    inverse covariance, so steps of that length never lose. Adds the variances v1 ... vk.
    """
    k = len(topics)
    inverse = np.linalg.inv(covariance)
    steep = float(np.linalg.eigvalsh(inverse).max())
    logits, soft = [f"e{i}" for i in range(1, k + 1)], [f"_p{i}" for i in range(1, k + 1)]
    carried = [c for c in counts.columns if c not in logits]
    size = _total([F.col(t) for t in topics])

    def with_soft(df: DataFrame) -> DataFrame:
        top = F.greatest(*logits) if k > 1 else F.col(logits[0])
        df = df.select(*carried, *logits, *[F.exp(F.col(e) - top).alias(p) for e, p in zip(logits, soft, strict=True)])
        return df.select(*carried, *logits, *[(F.col(p) / _total([F.col(q) for q in soft])).alias(p) for p in soft])

    out = with_soft(counts)
    for _ in range(steps):
        pull = [_total([(F.col(e) - float(m)) * float(inverse[i, j]) for j, (e, m) in enumerate(zip(logits, mean, strict=True))]) for i in range(k)]
        moved = [
            (F.col(e) + (F.col(t) - size * F.col(p) - g) / (size / 2 + steep)).alias(e) for e, t, p, g in zip(logits, topics, soft, pull, strict=True)
        ]
        out = with_soft(out.select(*carried, *moved))
    spread = [(1.0 / (size * F.col(p) * (1.0 - F.col(p)) + float(inverse[i, i]))).alias(f"v{i + 1}") for i, p in enumerate(soft)]
    return out.select(*carried, *logits, *soft, *spread)


def _moments(documents: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the documents' logits, from one row of partial sums."""
    e = [F.col(f"e{i}") for i in range(1, k + 1)]
    row = documents.agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(e)], *[F.sum(f"v{i + 1}").alias(f"v{i}") for i in range(k)],
        *[F.sum(e[i] * e[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    mean = np.array([row[f"s{i}"] for i in range(k)]) / row["n"]
    product = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / row["n"]
    return mean, product - np.outer(mean, mean) + np.diag([row[f"v{i}"] / row["n"] for i in range(k)])


def settled(history: Sequence[float], tolerance: float) -> bool:
    """Whether the last two changes of the log-likelihood are within ``tolerance`` of it and the later one is not the larger.

    Topics that are nearly alike gain little, but more with each step; this is no end.
    """
    if len(history) < 3:
        return False
    early, late = (abs(b - a) for a, b in zip(history[-3:], history[-2:], strict=False))
    return late <= early and early <= tolerance * abs(history[-3]) and late <= tolerance * abs(history[-2])


def fit_topics(
    cells: DataFrame, documents: DataFrame, document: str, k: int, iterations: int | None = 100, tolerance: float | None = 1e-5, start: str = "hash",
    prior: str = "shares", least_documents: int = 5,
) -> TopicModel:
    """Fit ``k`` topics until the log-likelihood is ``settled`` within ``tolerance``, or for ``iterations`` steps; None is no bound.

    ``start`` is "hash" (term weights from a hash) or "spectral" (from anchor terms
    that occur in ``least_documents`` documents or more). A hash start has topics that
    are nearly alike, and gains little in its first steps. ``prior`` is "shares" (a
    constant added to each document's counts) or "correlated": the logits of the
    documents' shares are normal, and their mean and covariance are fitted as well.
    All documents start with equal shares, and one without words keeps the mean's.
    The start and each step are written to the shared folder; what is no longer
    needed is removed there, and the model's own ``remove`` removes the rest.
    """
    topics = [f"t{i}" for i in range(1, k + 1)]
    cells = written(cells.where(F.col("term").isNotNull()), "topic-cells", codec="zstd")
    counted, vocabulary, common, rare = _numbered(cells, document)
    started = None
    if start == "hash":
        terms = vocabulary.select("_id", "_common", *[start_weight("term", i).alias(t) for i, t in enumerate(topics, 1)])
    else:
        started = spectral_start(cells, document, k, least_documents)
        terms = vocabulary.join(started, "term").select("_id", "_common", *topics)
    discard(cells)
    logits = [F.lit(0.0).alias(f"e{i}") for i in range(1, k + 1)] if prior == "correlated" else []
    shares = written(documents.select(document, *[F.lit(1.0 / k).alias(t) for t in topics], *logits), "topic-shares")
    mean, covariance = np.zeros(k), np.eye(k)
    history: list[float] = []
    kept = [started] if started is not None else []  # what the terms are read from
    for _ in count() if iterations is None else range(iterations):
        sums = written(_sums(common, rare, terms, shares, document, topics), "topic-sums")
        by_term, by_document = (sums.where(F.col("_of_term") == of) for of in (1, 0))
        totals = by_term.agg(*[F.sum(t).alias(t) for t in topics], F.sum("_l").alias("l"), F.count("*").alias("v")).first()
        if not totals["v"]:  # no words at all
            discard(sums)
            break
        history.append(totals["l"])
        if tolerance is not None and settled(history, tolerance):  # the weights of the step before are the fitted ones
            discard(sums)
            break
        by_document = by_document.select("_d", *topics)
        if prior == "correlated":
            left = shares.select(F.col(document).alias("_k"), *[f"e{i}" for i in range(1, k + 1)])
            counts = left.join(by_document, F.col("_k").eqNullSafe(F.col("_d")), "left").select(
                F.col("_k").alias(document), *[F.coalesce(F.col(t), F.lit(0.0)).alias(t) for t in topics], *[f"e{i}" for i in range(1, k + 1)]
            )
            moved = logits_of(counts, mean, covariance, topics)
            new = moved.select(document, *[F.col(f"_p{i}").alias(t) for i, t in enumerate(topics, 1)], *[f"{c}{i}" for c in "ev" for i in range(1, k + 1)])
        else:
            new = _shares_of(by_document, shares.select(document), document, topics)
        new = written(new, "topic-shares")
        if prior == "correlated":
            mean, covariance = _moments(new, k)
        terms = by_term.select("_id", "_common", *[((F.col(t) + TERM_PRIOR) / (totals[t] + TERM_PRIOR * totals["v"])).alias(t) for t in topics])
        discard(shares, *kept)
        shares, kept = new, [sums]
    fitted = written(terms.join(vocabulary.select("_id", "term"), "_id").select("term", *topics), "topic-terms")
    discard(counted, common, rare, *kept)
    found = (tuple(mean.tolist()), tuple(map(tuple, covariance.tolist()))) if prior == "correlated" else ((), ())
    return TopicModel(shares, fitted, document, k, tuple(history), *found)


def topic_correlations(fit: TopicModel) -> DataFrame:
    """(topic, other, covariance, correlation) of the documents' logits, each pair once and each topic with itself."""
    c = fit.covariance
    if not c:
        raise ValueError("the model was fitted without correlated topics")
    rows = [(i + 1, j + 1, c[i][j], c[i][j] / math.sqrt(c[i][i] * c[j][j])) for i in range(fit.k) for j in range(i, fit.k)]
    return fit.terms.sparkSession.createDataFrame(rows, "topic int, other int, covariance double, correlation double")


def _long(wide: DataFrame, key: str, topics: list[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("topic"), F.col(t).alias(value)) for i, t in enumerate(topics)])
    return wide.select(key, F.inline(pairs))


def topic_terms_beta(fit: TopicModel) -> DataFrame:
    """(topic, term, beta): probability of each term in each topic."""
    return _long(fit.terms, "term", fit.topics(), "beta").select("topic", "term", "beta")


def doc_topics_gamma(fit: TopicModel) -> DataFrame:
    """(document, topic, gamma): share of each topic in each document."""
    return _long(fit.documents, fit.document, fit.topics(), "gamma")


def top_terms_per_topic(beta: DataFrame, k: int = 10) -> DataFrame:
    return top_n(beta, k, "beta", by="topic")


def topic_prevalence(gamma: DataFrame) -> DataFrame:
    """Expected share of each topic."""
    return gamma.groupBy("topic").agg(F.avg("gamma").alias("prevalence"))


def gamma_histogram(gamma: DataFrame, bins: int = 30) -> DataFrame:
    """Documents per topic and bin of the topic's share."""
    return freq_polygon(gamma, "gamma", "topic", bins, few_values=False)


def frex_scores(beta: DataFrame, weight: float = 0.5) -> DataFrame:
    """(topic, term, beta, frex): harmonic mean of the rank fractions of frequency and exclusivity.

    Exclusivity is beta over its sum across topics.
    """
    # one value per topic, added in sorted order so that the sum is reproducible
    values = F.array_sort(F.collect_list("beta"))
    sums = beta.groupBy("term").agg(F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("_all"))
    rows = attach(beta, sums, "term").withColumn("_ex", F.col("beta") / F.nullif(F.col("_all"), F.lit(0.0)))
    often, own = rank_levels(rows, "beta", "topic", "_f"), rank_levels(rows, "_ex", "topic", "_e")
    rows = attach(attach(rows, often, ["topic", "beta"]), own, ["topic", "_ex"])
    frex = 1.0 / ((1.0 - weight) / F.col("_f") + weight / F.col("_e"))
    return rows.select("topic", "term", "beta", frex.alias("frex"))


def topic_labels_frex(beta: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best terms per topic by FREX; ties kept."""
    return top_n(frex_scores(beta), k, "frex", by="topic")
