"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes look-alike letters, digit substitutions and accents. The lexicon
(words and word starts with a weight each) and its exception phrases are learned
from a bounded sample of labelled rows; every document is then scored in one scan.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verbatim.llm.common import map_slices, saved, slices, text_of

#: Most labelled rows of each kind that the lexicon is learned from, taken in hash order of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 6000
#: A clean row that is taken for toxic weighs as much as so many toxic rows that are missed.
FALSE_ALARM = 2.0
#: An entry needs this many toxic training rows.
LEAST_ROWS = 3
#: An entry is proven if toxic rows have it more than LEAST_RATIO times as often as clean ones, by a likelihood ratio
#: of LEAST_PROOF or more: chance brings a word of even use into the lexicon once in some hundred thousand.
LEAST_RATIO, LEAST_PROOF = 2.0, 15.0
#: Lengths of word starts that are tried as entries.
STEMS = range(3, 9)
#: A row is toxic from this score on.
THRESHOLD = 0.3

# Letters that look alike, and signs written for letters.
LOOK_ALIKE = dict(zip("аеорсхуікмнтвοαερντικυ", "aeopcxyikmhtboaepvtiku", strict=True))
SUBSTITUTES = dict(zip("0134578@$!|", "oieastbasii", strict=True))


class _Fold(dict):
    """Folding of one character, worked out once: a letter, or a space for what is none."""

    def __missing__(self, code: int) -> str:
        low = chr(code).lower()
        plain = unicodedata.normalize("NFKD", low)
        out = "".join(LOOK_ALIKE.get(c, SUBSTITUTES.get(c, c)) for c in plain if not unicodedata.combining(c))
        out = "".join(c if c.isalpha() else " " for c in out)
        if unicodedata.category(chr(code)) in ("Cf", "Mn"):
            out = ""
        self[code] = out
        return out


FOLD = _Fold()


def folded(text: str) -> str:
    """Folded words, each with one space before it and one after the last."""
    return f" {' '.join(text.translate(FOLD).split())} "


def entries_of(words: set[str]) -> set[str]:
    """Possible lexicon entries of a text: its words, and their starts."""
    out = {f" {w} " for w in words}
    for n in STEMS:
        out.update([f" {w[:n]}" for w in words if len(w) >= n])
    return out


@dataclass(frozen=True)
class Lexicon:
    """Entry weights, exception phrases and the scale of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    scale: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        made = ahocorasick.Automaton()
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in self.weights.items():
            made.add_word(entry, (len(entry), weight))
        made.make_automaton()
        return made

    def score_of(self, text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int]:
        """Score and number of hits of one text."""
        plain = folded(text)
        found = hits(plain, automaton)
        a, b = _features(sum(w for _, w in found.values()), max(plain.count(" ") - 1, 0))
        low, by_sum, by_share = self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, low + by_sum * a + by_share * b)))), len(found)


def hits(text: str, automaton: ahocorasick.Automaton | None) -> dict[int, tuple[int, float]]:
    """Heaviest entry by the place of the word in folded text; words inside an exception phrase are left out."""
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    if automaton is None:
        return found
    for end, (length, weight) in automaton.iter(text):
        start = end - length + 1
        if not weight:
            spared.append((start, end))
        elif start not in found or found[start][1] < weight:
            found[start] = (end, weight)
    if spared:
        # Phrases by start, and how far any of them reaches so far: one look for each hit.
        spared.sort()
        starts = [a for a, _ in spared]
        reach = list(accumulate((b for _, b in spared), max))
        for start in [s for s, (end, _) in found.items() if (k := bisect_right(starts, s)) and reach[k - 1] >= end]:
            del found[start]
    return found


def _features(total: float, n_words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(1000 * total / (n_words + 50))


def _fit_scale(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two features, each row weighing as much as the rows it stands for, by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    keep = np.diag([1e-3, 1e-2, 1e-2]) * times.sum()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (times * p * (1 - p))[:, None]).T @ a + keep, a.T @ (times * (y - p)) - keep @ w)
        w += np.clip(step, -3, 3)
    return tuple(float(v) for v in w)


def training_rows(df: DataFrame, labels: DataFrame, usable: Column, key: str, text: str, label: str) -> DataFrame:
    """A bounded sample of labelled texts (``_text``, ``_y``), written once; ``usable`` says which keys may be learned from.

    ``_w`` is the number of labelled keys of its kind that a row stands for.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("_y"))
    ranked = lambda y, n: known.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(n)
    # At most TRAIN_TOXIC + TRAIN_CLEAN keys.
    all_ = {r._y: r.n for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = F.when(F.col("_y") == 1, max(1.0, all_.get(1, 0) / TRAIN_TOXIC)).otherwise(max(1.0, all_.get(0, 0) / TRAIN_CLEAN))
    sample = saved(ranked(1, TRAIN_TOXIC).union(ranked(0, TRAIN_CLEAN)).withColumn("_w", stands).coalesce(1), "toxic-sample")
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    return saved(rows.join(F.broadcast(sample.withColumnRenamed(key, "_k")), "_k").select("_text", F.col("_y").cast("int").alias("_y"), "_w"), "toxic-train")


def _counts(rows: DataFrame, of) -> DataFrame:
    """Toxic and clean texts by feature; each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(text_of(part, "_text").to_pylist(), part.column(1).to_pylist(), strict=True):
                sums[int(y == 1)].update(of(folded(t)))
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([sums[y][n] for n in names], pa.int64()) for y in (1, 0))], ["f", "t", "c"]
            )

    return rows.mapInArrow(run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def proof(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio of t toxic and c clean rows against a use that is LEAST_RATIO times as frequent in toxic ones; 0 below that."""
    even = LEAST_RATIO * toxic / (LEAST_RATIO * toxic + clean)
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((t + c) * share))).otherwise(0.0) if share else F.lit(0.0)
    return F.when(t > even * (t + c), 2 * (part(t, even) + part(c, 1 - even))).otherwise(0.0)


def shortest(weights: dict[str, float]) -> dict[str, float]:
    """Entries without those that a start of theirs, of at least their weight, finds as well."""
    return {f: w for f, w in weights.items() if not any(weights.get(f[:n], -math.inf) >= w for n in range(2, len(f)))}


def learn(rows: DataFrame) -> Lexicon:
    """Lexicon of a training sample (``_text``, ``_y``, ``_w``); without toxic rows it is empty.

    All entries that are proven and all exception phrases are taken: the sample bounds them.
    """
    if "_w" not in rows.columns:
        rows = rows.withColumn("_w", F.lit(1.0))
    n = {r._y: r.n for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    counts = _counts(rows, lambda text: entries_of(set(text.split())))
    t, c = F.col("t"), F.col("c")
    proven = counts.where((t >= LEAST_ROWS) & (proof(t, c, toxic, clean) >= LEAST_PROOF)) if toxic else counts.limit(0)
    # For the scale, a row must not profit from having been counted itself.
    alone = (t > LEAST_ROWS) & (proof(t - 1, c, toxic, clean) >= LEAST_PROOF) if toxic else F.lit(False)
    found = proven.withColumn("alone", alone).collect()
    weights = shortest({r.f: odds(r.t, r.c) for r in found})
    found = [r for r in found if r.f in weights]
    own = {1: {r.f: odds(r.t - 1, r.c) for r in found if r.alone}, 0: {r.f: odds(r.t, max(r.c - 1, 0)) for r in found}}

    def phrases(text: str) -> set[str]:
        automaton, out = Lexicon(weights, (), (0, 0, 0)).automaton() if not cache else cache[0], set()
        cache[:] = [automaton]
        for start in hits(text, automaton):
            stop = text.index(" ", start + 1)
            out.add(text[text.rfind(" ", 0, start) if start else 0 : stop + 1])
            out.add(text[start : text.find(" ", stop + 1) + 1 or stop + 1])
        return out

    cache: list = []
    spared = ()
    if weights:
        apart = _counts(rows, phrases).where((F.col("t") == 0) & (F.col("c") >= LEAST_ROWS))
        spared = tuple(sorted(r.f for r in apart.collect() if r.f.strip().count(" ")))

    def scales(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {y: Lexicon(own[y], spared, (0, 0, 0)).automaton() for y in own}
        for part in slices(batches, "_text"):
            out = []
            for t, y, times in zip(text_of(part, "_text").to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                text = folded(t)
                out.append((*_features(sum(w for _, w in hits(text, made[int(y == 1)]).values()), text.count(" ") - 1), y, times))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.float64()) for k in range(4)], ["a", "b", "y", "w"])

    # One small row for each training row: bounded by the sample.
    seen = np.array([tuple(r) for r in rows.select("_text", "_y", "_w").mapInArrow(scales, "a double, b double, y double, w double").collect()]).reshape(-1, 4)
    seen = seen[np.lexsort(seen.T)]
    toxic_row = seen[:, 2] == 1
    times = seen[:, 3] * np.where(toxic_row, 1.0, FALSE_ALARM)
    scale = _fit_scale(seen[:, :2], toxic_row.astype(float), times) if toxic and clean else (-5.0, 0.0, 0.0)
    return Lexicon(weights, spared, scale)


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score between 0 and 1, predicted, and number of hits of every text.

    Null and empty texts have no hit and get the lowest score. Rows are scored one
    by one; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    made: list = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(lexicon.automaton())
        rows = [lexicon.score_of(t, made[0]) for t in text_of(batch, "_text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], ["_key", "score", "n_hits"])

    rows = map_slices(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", f"_key {kind}, score double, n_hits long", step)
    return rows.select(F.col("_key").alias(key), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that are not toxic; null and empty texts are not."""
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            if not made:
                made.append(lexicon.automaton())
            yield part.filter(pa.array([not t or lexicon.score_of(t, made[0])[0] < THRESHOLD for t in text_of(part, text).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
