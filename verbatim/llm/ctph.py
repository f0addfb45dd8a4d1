"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes decides where a chunk ends, so boundaries move with
the content; every chunk gives one character. Fingerprints are compared by edit
distance where their block sizes are equal or one doubling apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verbatim.llm.common import Spans, slices, text_of

WINDOW = 7
LEAST_BLOCK = 3
#: Most characters of the signature at the block size, and at twice that.
LENGTH, HALF = 64, 32
_SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Likeness of unrelated signatures of full length, by chance; it counts as 0.
CHANCE = 0.15
_U32 = np.uint32


def block_size(n: int) -> int:
    """Smallest doubling of LEAST_BLOCK at which about LENGTH chunks cover n bytes; it is halved again where boundaries are few."""
    size = LEAST_BLOCK
    while size * LENGTH < n:
        size *= 2
    return size


def rolling(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at each byte, not reaching back beyond its row."""
    factor = [_U32((1 + WINDOW - k + (1 << 5 * k)) & 0xFFFFFFFF) for k in range(WINDOW)]
    wide = data.astype(np.uint32)
    out = wide * factor[0]
    for k in range(1, min(WINDOW, len(data))):
        out[k:] += wide[:-k] * factor[k]
    start, end = rows[1:-1], rows[2:]
    for k in range(1, WINDOW):
        for j in range(k):
            at = start[(start + j < end) & (start + j - k >= 0)] + j
            out[at] -= wide[at - k] * factor[k]
    return out


def fingerprints(texts: list[bytes]) -> list[str]:
    """``block:signature:signature at twice the block`` of each text."""
    rows = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=rows[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [f"{LEAST_BLOCK}::"] * len(texts)
    hashes, spans, out = rolling(data, rows), Spans(data), []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        size = block_size(int(b - a))
        part = hashes[a:b]
        ends = np.flatnonzero(part % _U32(size) == size - 1)
        # A text with few boundaries gets smaller blocks, until its signature says enough.
        while size > LEAST_BLOCK and len(ends) + 1 < HALF:
            size //= 2
            ends = np.flatnonzero(part % _U32(size) == size - 1)
        signatures = []
        for most, keep in ((LENGTH, ends), (HALF, ends[part[ends] % _U32(2 * size) == 2 * size - 1])):
            stop = keep[: most - 1] + 1
            edges = np.concatenate([[0], stop, [b - a] if not len(stop) or stop[-1] < b - a else []]).astype(np.int64) + a
            picked = spans.hash(edges[:-1], edges[1:]) >> np.uint64(58) if b > a else np.zeros(0, np.uint64)
            signatures.append(_SIGNS[picked.astype(np.int64)].tobytes().decode())
        out.append(f"{size}:{signatures[0]}:{signatures[1]}")
    return out


def likeness(left: str, right: str) -> Column:
    """Likeness of two fingerprint columns, 0 to 1; 1 for equal ones, 0 if either is null.

    It depends on the two alone, whatever the length of the texts and however often
    rows repeat; fingerprints of empty texts are like nothing but each other.
    """
    a, b = F.split(left, ":"), F.split(right, ":")

    def alike(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        share = 1 - F.levenshtein(x, y) / longest
        return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(F.greatest((share - CHANCE) / (1 - CHANCE), F.lit(0.0)))

    block_a, block_b = a[0].cast("long"), b[0].cast("long")
    return (
        F.when(F.col(left) == F.col(right), 1.0)
        .when(block_a == block_b, F.greatest(alike(a[1], b[1]), alike(a[2], b[2])))
        .when(block_a == 2 * block_b, alike(a[1], b[2]))
        .when(2 * block_a == block_b, alike(a[2], b[1]))
        .otherwise(0.0)
    )


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in ranges of keys, sorted, each range followed by the first rows of the next one (``_copy``).

    The ends of the ranges are quantiles, as many as four for each shuffle partition;
    only they reach the driver. Rows without key come first.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("_id"), F.col(text).alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    cuts = np.array(sorted(set(rows.select("_id").approxQuantile("_id", [k / ranges for k in range(ranges)], 0.25 / ranges))), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            place = np.maximum(np.searchsorted(cuts, ids, "right") - 1, 0)
            heads = np.flatnonzero(ids == cuts[place])
            take = pa.array(np.concatenate([np.arange(len(ids)), heads]))
            range_ = np.concatenate([place, (place[heads] - 1) % len(cuts)]).astype(np.int32)
            copy = np.concatenate([np.zeros(len(ids), bool), np.ones(len(heads), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(range_), pa.array(copy), *(c.take(take) for c in batch.columns)], ["_range", "_copy", "_key", "_id", "_text"])

    kind = df.schema[key].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"_range int, _copy boolean, _key {kind}, _id long, _text string")
    return dealt.repartition(parts, "_range").sortWithinPartitions("_range", "_copy", "_id", F.col("_text").asc_nulls_first())


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, whose last half is the start of the next text.

    Texts follow each other by key, then text, rows without key first; after the last
    comes the first. Null counts as empty. Equal texts have equal fingerprints. A
    single row follows itself. Other columns are ignored; an empty table gives no
    rows. Rows are streamed in order: a task holds two texts besides its slice.

    Returns the key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.
    """
    names = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for part in slices(batches, "_text"):
            if last is not None:
                part = pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0]
            last = part.slice(part.num_rows - 1)
            texts, place, copy = text_of(part, "_text").to_pylist(), part.column(0).to_pylist(), part.column(1).to_pylist()
            own = [k for k in range(len(texts) - 1) if not copy[k]]
            edited = []
            for k in own:
                if place[k] != place[k + 1]:
                    raise AssertionError("a range must end with the first row of the next one")
                half = len(texts[k]) // 2
                edited.append((texts[k][: len(texts[k]) - half] + texts[k + 1][:half]).encode())
            plain = fingerprints([t.encode() for t in texts])
            changed = fingerprints(edited)
            columns = [
                pa.array([len(texts[k]) for k in own], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([plain[k] for k in own], pa.string()), pa.array(changed, pa.string()), pa.array([plain[k + 1] for k in own], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(own, pa.int64())), *columns], names)

    kind = df.schema[key].dataType.simpleString()
    rows = with_next(df, key, text).mapInArrow(run, f"_key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return rows.select(
        F.col("_key").alias(key), *names[1:5], likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next")
    )
