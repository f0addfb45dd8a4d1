"""Packing token pieces into sequences of a fixed length by length patterns.

Patterns of two or three lengths that fill a sequence exactly get repeat counts by
non-negative least squares on the histogram of lengths. Counts are rounded down and
filled; what is left over is packed best-fit, longest first, on its histogram. The
driver sees the histogram and the plan only, whose sizes depend on the sequence
length and not on the table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verbatim.llm.common import map_slices, saved, text_of

# Fixed value: how byte-level tokenizers split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Steps of the least-squares fit.
FIT_STEPS = 300
#: Counters that number the pieces of one length: of full pieces, and of any other length.
FULL_SALTS, SALTS = 512, 16


def byte_signs() -> dict[str, int]:
    """Bytes by the letters that stand for them in vocabulary files: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Byte-level BPE of a tokenizer file, run by its ranks.

    Ids are those of the file's own library without added special tokens; strings of
    special tokens in a text get the special id there, and so they do here.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        if made["normalizer"] is not None or made["pre_tokenizer"]["type"] != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level tokenizers without normalizer and prefix space are known")
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        byte = byte_signs()
        ranks = {bytes(byte[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.path = path
        self.model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.library = None

    def numbers(self, text: str, plain: bool = False) -> np.ndarray:
        """Ids of a text; ``plain`` takes strings of special tokens as ordinary text."""
        try:
            return self.model.encode_to_numpy(text, allowed_special=set() if plain else "all", disallowed_special=()).astype("<u4", copy=False)
        except ValueError:
            # Its splitting has a limit on runs of blanks (below a million); the file's own library has none.
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = plain
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian bytes."""
        return self.numbers(text).tobytes()


def pieces(df: DataFrame, tokenizer: str, length: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut the ids of every text, end id included, into pieces of ``length``; the first of several may be shorter."""
    made: list[Tokens] = []
    end = np.array([end_id], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Tokens(tokenizer))
        row, piece, start, size, crc = [], [], [], [], []
        for r, t in enumerate(text_of(batch, "_text").to_pylist()):
            ids = made[0].ids(t) + end
            n = len(ids) // 4
            first = (n - 1) % length + 1
            cuts = [0, *range(first, n + 1, length)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row.append(r)
                piece.append(k)
                start.append(a)
                size.append(b - a)
                crc.append(zlib.crc32(ids[4 * a : 4 * b]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc))],
            ["_key", "piece", "start", "length", "ids_crc32"],
        )

    kind = df.schema[key].dataType.simpleString()
    columns = f"_key {kind}, piece int, start long, length long, ids_crc32 long"
    return map_slices(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", columns, step)


@dataclass(frozen=True)
class Plan:
    """Runs of equal pieces: ranks from ``rank`` on go to sequences from ``sequence`` on, all at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def patterns(length: int) -> np.ndarray:
    """All patterns of two or three lengths that fill a sequence, unused third parts being 0."""
    a, b = np.meshgrid(np.arange(0, length), np.arange(1, length), indexing="ij")
    c = length - a - b
    keep = (a <= b) & (b <= c)
    return np.column_stack([a[keep], b[keep], c[keep]])


def fit(histogram: np.ndarray, parts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts of the patterns by non-negative least squares (accelerated projected gradient).

    Long pieces weigh more: what is left of short ones is easy to place.
    """
    length = len(histogram) - 1
    weight = 0.2 + 0.8 * np.arange(length + 1) / length
    weight[0] = 0.0
    put = lambda x: sum(np.bincount(parts[:, k], x, length + 1) for k in range(3))
    pull = lambda r: sum(r[parts[:, k]] for k in range(3))
    v = np.ones(len(parts))
    for _ in range(20):
        v = pull(weight**2 * put(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        grad = pull(weight**2 * (put(y) - histogram))
        new = np.maximum(y - grad / (1.02 * norm), 0.0)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
    return x


def plan(histogram: np.ndarray) -> Plan:
    """Where the pieces of a histogram go; entry n counts pieces of length n, the last is a full sequence."""
    length = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[int, int, int, int]] = []
    used = np.zeros(length + 1, np.int64)
    sequences = 0

    def place(size: int, count: int, sequence: int, offset: int) -> None:
        runs.append((size, int(used[size]), sequence, offset))
        used[size] += count
        left[size] -= count

    if left[length]:
        count = int(left[length])
        place(length, count, 0, 0)
        sequences = count
    parts = patterns(length)
    repeat = np.floor(fit(np.append(left[:-1], 0).astype(float), parts) + 1e-9).astype(np.int64)
    for k in np.argsort(-repeat, kind="stable"):
        if repeat[k] <= 0:
            break
        sizes, need = np.unique(parts[k][parts[k] > 0], return_counts=True)
        count = int(min(repeat[k], (left[sizes] // need).min()))
        if count <= 0:
            continue
        offset = 0
        for size in parts[k][parts[k] > 0][::-1]:
            place(int(size), count, sequences, offset)
            offset += int(size)
        sequences += count

    # The rest: best fit, longest first, many equal pieces at once.
    open_: dict[int, list[tuple[int, int]]] = {}
    for size in range(length - 1, 0, -1):
        while left[size]:
            fitting = [f for f in sorted(open_) if f >= size]
            if not fitting:
                break
            free = fitting[0]
            at, count = open_[free].pop()
            take = int(min(count, left[size]))
            place(size, take, at, length - free)
            if take < count:
                open_[free].append((at + take, count - take))
            if not open_[free]:
                del open_[free]
            if free > size:
                open_.setdefault(free - size, []).append((at, take))
        while left[size]:
            each = min(length // size, int(left[size]))
            count = int(left[size]) // each
            for k in range(each):
                place(size, count, sequences, k * size)
            if length > each * size:
                open_.setdefault(length - each * size, []).append((sequences, count))
            sequences += count
    got = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(got[:, 0], got[:, 1], got[:, 2], got[:, 3], sequences)


def pack(df: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and place.

    Null text: the end id alone. Equal rows give equal pieces, each with a place of
    its own. An empty table gives no rows; other columns are ignored. The texts are
    tokenized once; what follows works on one small row for each piece.

    Returns the key, piece, start, length, ids_crc32, sequence_id and offset.
    """
    spark = df.sparkSession
    salts = F.when(F.col("length") == length, F.lit(FULL_SALTS)).otherwise(F.lit(SALTS))
    cut = saved(
        pieces(df, tokenizer, length, end_id, key, text).withColumn("_salt", F.pmod(F.xxhash64("_key", "piece", "ids_crc32"), salts).cast("int")), "pieces"
    )
    # At most SALTS rows for each length.
    counts = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(length + 1, np.int64)
    base = np.zeros((length + 1, max(FULL_SALTS, SALTS)), np.int64)
    for r in sorted(counts, key=lambda r: (r.length, r._salt)):
        base[r.length, r._salt] = histogram[r.length]
        histogram[r.length] += r.n
    made = plan(histogram)
    shared = spark.sparkContext.broadcast((base, made))
    wide = 1 << 44

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = shared.value
        keys = made.length * wide + made.rank
        for batch in batches:
            size, salt, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_n"))
            rank = base[size, salt] + number - 1
            run = np.searchsorted(keys, size * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(made.sequence[run] + rank - made.rank[run]), pa.array(made.offset[run])],
                ["_key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = cut.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_key", "piece", "ids_crc32")))
    kind = df.schema[key].dataType.simpleString()
    return numbered.mapInArrow(
        assign, f"_key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("_key", key)
