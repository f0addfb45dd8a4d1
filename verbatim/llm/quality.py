"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken from word hashes in numpy, and
the characters inside n-grams, lines or runs of signs that occur twice or more in a
text are measured. Texts are independent: the job is one scan without shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verbatim.llm.common import Words, map_slices, mix, per_row, text_of

#: N-gram length in words, and the largest share of characters that repeated ones may cover. They fall with
#: the length, as a longer repeat says more; that of five words lies where the base rule is, so that longer words count.
COVERAGE_LIMITS = {2: 0.45, 3: 0.30, 5: 0.20, 7: 0.18, 10: 0.15}
#: The same for repeated lines, and for repeated runs of the signs that are no prose.
LINE_LIMIT, SIGN_LIMIT = 0.30, 0.05
#: Fewest words, and percent of words in repeated five-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Repeats count only in texts of so many words; short ones repeat by chance.
LEAST_FOR_COVERAGE = 20

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_sign_share double, " + ", ".join(
    f"dup_{n}gram_share double" for n in COVERAGE_LIMITS
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    if len(k) > 1:
        eq = k[1:] == k[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(k), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out


def covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any of the windows of n words that start at ``first``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Measures of each text of a slice."""
    w = Words(texts)
    data, total = w.data, len(w.start)
    lead = (data & 0xC0) != 0x80
    salt = mix(np.arange(1, len(w.count) + 1, dtype=np.uint64))
    chars_to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=chars_to[1:])
    word_chars = chars_to[w.end] - chars_to[w.start]
    chars = per_row(word_chars, w.first)
    out = {"n_words": w.count.astype(np.int64), "word_chars": chars}
    symbol = np.zeros(256, bool)
    symbol[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
    out["n_symbols"] = per_row(symbol[data], w.rows)

    # Lines: cut at row starts and after each line feed.
    breaks = np.unique(np.concatenate([w.rows[:-1], np.flatnonzero(data == 10) + 1, w.rows[-1:]]))
    start, end = breaks[:-1], breaks[1:]
    row = np.searchsorted(w.rows, start, "right") - 1
    stop = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10))
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, stop)
    full = hi > lo
    row, start, stop, lo, hi = row[full], start[full], stop[full], lo[full], hi[full]
    keys = w.spans.hash(start, stop) ^ salt[row]
    dup = later(keys)
    out["n_dup_lines"] = np.bincount(row[dup], minlength=len(w.count)).astype(np.int64)
    so_far = np.zeros(total + 1, np.int64)
    np.cumsum(word_chars, out=so_far[1:])
    dup_chars = np.bincount(row[dup], weights=(so_far[hi] - so_far[lo])[dup], minlength=len(w.count))
    share = lambda part: np.divide(part, chars, out=np.zeros(len(chars)), where=chars > 0)
    out["dup_line_share"] = share(dup_chars)
    # Runs of signs within a text.
    signs = symbol[data]
    opens, shuts = signs.copy(), signs.copy()
    opens[1:] &= ~signs[:-1]
    shuts[:-1] &= ~signs[1:]
    edge = w.rows[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] |= signs[edge]
    shuts[edge - 1] |= signs[edge - 1]
    begin, finish = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    row = np.searchsorted(w.rows, begin, "right") - 1
    again = repeated(w.spans.hash(begin, finish) ^ salt[row])
    out["dup_sign_share"] = share(np.bincount(row[again], (finish - begin)[again], len(w.count)))
    for n in COVERAGE_LIMITS:
        at, grams = w.grams(n)
        again = at[repeated(grams ^ salt[w.row[at]])] if len(at) else at
        inside = covered(again, n, total)
        if n == 5:
            out["n_repeat_words"] = per_row(inside, w.first)
        out[f"dup_{n}gram_share"] = share(per_row(np.where(inside, word_chars, 0), w.first).astype(float))
    return out


def quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every text.

    Null and empty texts have no words and fail. Rows are judged one by one, so
    repeated rows give repeated results; other columns are ignored.
    """
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = measure(text_of(batch, "_text"))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c]) for c in names)], ["_key", *names])

    kind = df.schema[key].dataType.simpleString()
    rows = map_slices(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", f"_key {kind}, {MEASURES}", step)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    repeats = (F.col("dup_line_share") > LINE_LIMIT) | (F.col("dup_sign_share") > SIGN_LIMIT)
    for n, limit in COVERAGE_LIMITS.items():
        repeats |= F.col(f"dup_{n}gram_share") > limit
    fine = ~((F.col("n_words") >= LEAST_FOR_COVERAGE) & repeats)
    return rows.select(F.col("_key").alias(key), *names, failed.alias("base_failed"), (~failed & fine).alias("kept"))
