"""Alignment of two tokenizers, once for each distinct text.

Rows are shuffled by their full text; each distinct text is tokenized both ways and
aligned once, and its measures and links are written out with its multiplicity. Pair
counts are sums over the distinct texts, weighed by multiplicity. The counts of the
commonest pairs, a number with a fixed bound, go to every task; links of the other
pairs meet their counts in a shuffle join, where no pair is frequent. Measures are
joined to the keys by a digest of the text; texts with very many rows, again a
bounded number, by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from verbatim.llm.common import saved, slices, text_of
from verbatim.llm.packing import Tokens
from verbatim.llm.pieces import BLANK, PARTS_KEPT, Codec

#: A pair is common if it holds one in so many links, and a text if it has one in so many rows; at most as many are broadcast.
COMMON_PAIRS, COMMON_TEXTS = 1 << 18, 1 << 10
_ROWS = "text_no long, digest string, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"


class ByteTokens:
    """First tokenizer: ids of a blank and a text, with the bytes that each covers."""

    def __init__(self, path: str) -> None:
        self.tokens = Tokens(path)
        model = self.tokens.model
        self.width = np.array([len(model.decode_single_token_bytes(i)) for i in range(model.n_vocab)], np.int32)

    def encode(self, text: str) -> np.ndarray | None:
        """Ids, or none if they leave out bytes of the text."""
        ids = self.tokens.numbers(" " + text, plain=True)
        return ids if int(self.width[ids].sum()) == 1 + len(text.encode()) else None


class PieceTokens:
    """Second tokenizer: ids by parts between blanks, which are kept, with the bytes that each covers."""

    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        codec = self.codec
        self.bytes = [
            bytes([codec.byte[i]]) if codec.byte[i] is not None else codec.model.id_to_piece(i).replace(BLANK, " ").encode() for i in range(len(codec.byte))
        ]
        self.width = np.array([len(b) for b in self.bytes], np.int32)
        self.blank = np.array([codec.model.piece_to_id(BLANK)], "<i4").tobytes()
        #: Ids of each part as bytes, and the parts that their ids do not spell.
        self.kept: dict[str, bytes] = {}
        self.bad: set[str] = set()

    def learn(self, parts: list[str]) -> None:
        """Segment parts in one call of the library, which puts the first blank mark in front of each."""
        for part, ids in zip(parts, self.codec.model.encode(parts, num_threads=1), strict=True):
            if not part:
                self.kept[part] = self.blank
                continue
            self.kept[part] = np.array(ids, "<i4").tobytes()
            if b"".join([self.bytes[i] for i in ids]) != (" " + part.replace(BLANK, " ")).encode():
                self.bad.add(part)

    def encode(self, text: str) -> np.ndarray | None:
        """Ids, or none if they do not spell a blank and the text: a blank mark in the text is taken for a blank."""
        if BLANK in text:
            return None
        parts = self.codec.parts_of(BLANK + text.replace(" ", BLANK))
        new = [p for p in set(parts) if p not in self.kept]
        if new:
            if len(self.kept) > PARTS_KEPT:
                self.kept.clear()
                self.bad.clear()
                new = list(set(parts))
            self.learn(new)
        if self.bad and not self.bad.isdisjoint(parts):
            return None
        return np.frombuffer(b"".join([self.kept[p] for p in parts]), "<i4")


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, first: str, second: str) -> None:
        self.a, self.b = ByteTokens(first), PieceTokens(second)
        # Ids with what follows them in the listing of groups: within a side, and at its end.
        n, m = len(self.a.width), len(self.b.width)
        self.listed = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Numbers of tokens of both sides, groups and links, digest of the groups, and each linked id pair with its number of links."""
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        a = self.a.encode(text) if text else None
        b = self.b.encode(text) if a is not None else None
        if b is None:
            return nothing
        end_a, end_b = np.cumsum(self.a.width[a]), np.cumsum(self.b.width[b])
        ends = np.zeros((2, int(end_a[-1]) + 1), bool)
        ends[0, end_a] = True
        ends[1, end_b] = True
        last_a, last_b = ends[1, end_a], ends[0, end_b]
        # Group of each token: how many cuts lie before it.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = len(self.a.width)
        codes = np.concatenate([a.astype(np.int64) + n * last_a, 2 * n + b.astype(np.int64) + len(self.b.width) * last_b])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        listed = "".join([self.listed[c] for c in codes[order].tolist()])[:-1]
        # No token is empty, so each common end has one token of either side.
        pairs, counts = np.unique(a[last_a].astype(np.int64) << 32 | b[last_b].astype(np.int64), return_counts=True)
        groups = int(last_a.sum())
        return len(a), len(b), groups, groups, hashlib.sha256(listed.encode()).hexdigest(), pairs, counts.astype(np.int32)


def aligned(df: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """Distinct texts that are not empty, with multiplicity, measures and links, in the shared folder."""
    whole = df.select(F.col(text).alias("_text")).where(F.length("_text") > 0).groupBy("_text").agg(F.count(F.lit(1)).alias("times"))
    made: list[Aligner] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for part in slices(batches, "_text"):
            if not made:
                made.append(Aligner(first, second))
            rows = [made[0].align(t) for t in text_of(part, "_text").to_pylist()]
            lists = lambda k, kind: pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[k] for r in rows]), kind)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(rows)), pa.int64()), part.column(1), part.column(2),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.string()),
                    lists(5, pa.int64()), lists(6, pa.int32()),
                ],
                [c.split(" ")[0] for c in _ROWS.split(", ")],
            )
            number += len(rows)

    return saved(whole.select("_text", F.sha2("_text", 256).alias("digest"), "times").mapInArrow(run, _ROWS), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """Every linked id pair with its number of links in all rows, and whether that is the highest of its second id."""
    links = texts.select("times", F.explode(F.arrays_zip("pairs", "counts")).alias("l"))
    counts = saved(links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum(F.col("l.counts") * F.col("times")).alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << 32) - 1)
    # At most one row for each entry of the second vocabulary.
    highest = counts.groupBy(second.alias("_second")).agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(highest), second == F.col("_second")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _scored(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Links at their second id's highest count and sum of counts, for each distinct text."""
    spark = texts.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * COMMON_PAIRS >= total)
    # At most COMMON_PAIRS rows, as their counts add up to no more than the total.
    rows = sorted((r.pair, r.n, r.best) for r in common.collect())
    table = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool)))

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, pair and count of every link, whether the pair is common, and its place in the table."""
        lists, counted = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("counts"))
        sizes = np.diff(np.asarray(lists.offsets))
        pair, count = lists.flatten().to_numpy(), counted.flatten().to_numpy()
        known = table.value[0]
        place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        return np.repeat(np.arange(batch.num_rows), sizes), pair, count, (known[place] == pair) if len(known) else np.zeros(len(pair), bool), place

    def of_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = table.value
        for batch in batches:
            row, _, count, hit, place = parts(batch)
            row, count, place = row[hit], count[hit].astype(np.int64), place[hit]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, count * best[place])
            np.add.at(sums[1], row, count * n[place])
            kept = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1])], [*batch.schema.names[:-2], "n_best", "count_sum"])

    def of_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, count, hit, _ = parts(batch)
            number = batch.column(0).to_numpy()[row[~hit]]
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(pair[~hit]), pa.array(count[~hit])], ["_no", "pair", "count"])

    measured = texts.mapInArrow(of_common, _ROWS.split(", pairs")[0] + ", n_best long, count_sum long")
    rest = texts.select("text_no", "pairs", "counts").mapInArrow(of_rest, "_no long, pair long, count int")
    rare = counts.where(F.col("n") * COMMON_PAIRS < total)
    more = rest.join(rare, "pair").groupBy("_no").agg(
        F.sum(F.when(F.col("best"), F.col("count")).otherwise(0)).alias("_best"), F.sum(F.col("count") * F.col("n")).alias("_sum")
    )
    return measured.join(more, F.col("text_no") == F.col("_no"), "left").select(
        "digest", "times", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def align(df: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How the tokens of two tokenizers lie on every text.

    ``first`` is a byte-level file, applied to a blank and the text; ``second`` is a
    model that puts the blank in front itself. Strings of special tokens are ordinary
    text. Null and empty texts, and texts that the tokens of either side do not spell
    (those with the blank mark U+2581), have zeros and an empty digest. Repeated rows
    and rows without key give a row each, with equal measures, and count each in the
    pair counts. An empty table gives no rows; other columns are ignored. One text is
    aligned in one piece, in memory of some hundred bytes for each of its tokens.

    Returns the key, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the
    highest of their second id), count_sum (over links) and groups_sha256.
    """
    texts = aligned(df, first, second, text)
    found = saved(_scored(texts, pair_counts(texts)), "scored")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    result = F.struct(*numbers, "groups_sha256")
    rows = found.agg(F.sum("times")).first()[0] or 0
    # At most COMMON_TEXTS rows, as their multiplicities add up to no more than the rows.
    often = found.where(F.col("times") * COMMON_TEXTS >= rows).select(F.col("digest").alias("_often"), result.alias("_near"))
    seldom = found.where(F.col("times") * COMMON_TEXTS < rows).select(F.col("digest").alias("_seldom"), result.alias("_far"))
    digest = F.when(F.length(F.col(text)) > 0, F.sha2(F.col(text), 256))
    asked = df.select(F.col(key).alias("_key"), digest.alias("_digest")).join(F.broadcast(often), F.col("_digest") == F.col("_often"), "left")
    # Rows that need no answer any more get keys that differ, so that they do not meet in one task.
    open_ = F.when(F.col("_near").isNull() & F.col("_digest").isNotNull(), F.col("_digest")).otherwise(F.monotonically_increasing_id().cast("string"))
    answered = asked.withColumn("_open", open_).join(seldom, F.col("_open") == F.col("_seldom"), "left").withColumn("_r", F.coalesce("_near", "_far"))
    return answered.select(
        F.col("_key").alias(key), *(F.coalesce(F.col(f"_r.{c}"), F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce(F.col("_r.groups_sha256"), F.lit("")).alias("groups_sha256"),
    )
