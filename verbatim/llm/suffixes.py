"""Removal of repeated byte strings by threshold-bounded interval expansion.

Equal texts are settled by their hash. In the others, content picks anchors: of all
q-grams that start in a string of the threshold length, the one of least hash, so
equal strings have equal anchors. Anchors that occur once cannot lie in a repeated
string. For the others, the surroundings in which a string around the anchor can lie
are compared: equal surroundings by hash, and the distinct ones as a block of text
whose Burrows-Wheeler transform is expanded breadth first. Backward extension of the
intervals yields common prefixes by increasing length and stops at the threshold;
suffixes that no boundary separates by then share a string of that length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from verbatim.llm.common import Spans, bytes_of, discard, grouped, map_slices, mix, node_key, saved, slices, text_of

#: Bytes of an anchor.
ANCHOR = 32
#: Bytes of surroundings that one transform takes in.
BLOCK_BYTES = 1 << 18
#: Distinct surroundings of one anchor that a block may hold. Beyond it, the strings around
#: that anchor are compared one by one through a shuffle, which gives the same result.
GROUP_ROWS = 20_000

_U = np.uint64


def anchors(data: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of ``length`` in each row, and their hashes.

    Of equal hashes in a string the last one counts.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(data) - ANCHOR + 1)
    hashes = Spans(data).hash(starts, starts + ANCHOR)
    width = length - ANCHOR + 1
    # Least hash of each window of ``width`` q-grams, by doubling, with its last place in the low bits.
    bits = _U(int(len(data)).bit_length())
    packed = (hashes >> bits << bits) | (_U(len(data)) - starts.astype(np.uint64))
    least, size = packed, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    first = np.arange(len(data) - length + 1)
    row = np.searchsorted(rows, first, "right") - 1
    inside = first + length <= rows[row + 1]
    # Windows that reach into the next row are no strings of a text; texts do not influence each other.
    places = np.unique(len(data) - (least[inside] & ((_U(1) << bits) - _U(1))).astype(np.int64))
    return places, hashes[places]


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of a block sorted by their first ``length`` bytes at least, by ranks of ever longer prefixes; equal ones in any order."""
    n = len(data)
    bits = n.bit_length()
    each = 63 // bits  # ranks that fit into one key
    padded = np.concatenate([data.astype(np.uint64) + _U(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key * _U(257) + padded[k : n + k]
    done = 7
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(sorted_[1:] != sorted_[:-1], out=new[1:])
        if done >= length or new[-1] == n - 1:
            return order
        # Ranks from 1 on; 0 stands for what is past the end.
        rank = np.zeros(n, np.int64)
        rank[order] = new + 1
        key = rank.copy()
        times = min(each, -(-length // done))
        for k in range(1, times):
            key <<= bits
            key[: max(n - k * done, 0)] |= rank[k * done :]
        done *= times


def boundaries(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a block, and which suffixes differ from the one before within ``length`` bytes.

    Breadth first over intervals of the transform: an interval holds the suffixes that
    start with one string; extending it by each preceding byte gives the strings one
    byte longer. The first time an interval ends at a place, the common prefix there is
    the length of the string before extension. Each interval is followed only if it
    sets a new boundary, so a block costs a number of intervals that is linear in it.
    """
    signs = np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0))  # the end sign is smaller than every byte
    n = len(signs)
    order = np.concatenate([[n - 1], suffix_order(data, length + 1)])
    before, head = signs[order - 1], signs[order]  # the transform, and the first byte of each suffix
    step = np.empty(n, np.int32)
    step[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)  # last-to-first mapping
    cut = np.zeros(n + 1, bool)
    cut[[0, n]] = True
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    owner = np.zeros(n, np.int32)
    for _ in range(length):
        if not len(low):
            break
        size = high - low + 1
        ends = np.cumsum(size, dtype=np.int32)
        item = np.arange(ends[-1], dtype=np.int32) + np.repeat(low - ends + size, size)
        to = step[item]
        owner[to] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        to.sort()
        of, sign = owner[to], head[to]
        last = np.ones(len(to), bool)
        last[:-1] = (of[1:] != of[:-1]) | (sign[1:] != sign[:-1])
        first = np.ones(len(to), bool)
        first[1:] = last[:-1]
        new_low, new_high = to[first], to[last]
        fresh = ~cut[new_high + 1]
        cut[new_high + 1] = True
        low, high = new_low[fresh], new_high[fresh]
    return order[1:], cut[1:-1]


def repeats(texts: list[bytes], ids: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text of a block, whether the string at each place also starts earlier in the table.

    Text k starts at byte ``places[k]`` of document ``ids[k]``. Texts may overlap: the
    same place is not earlier than itself.
    """
    sizes = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(sizes)])
    order, cut = boundaries(np.frombuffer(b"".join(texts), np.uint8), length)
    group = np.cumsum(cut)
    text = np.searchsorted(start, order, "right") - 1
    whole = order + length <= start[text + 1]
    whole &= np.bincount(group, whole)[group] > 1
    order, group, text = order[whole], group[whole], text[whole]
    doc, place = ids[text], places[text] + order - start[text]
    by = np.lexsort((place, doc, group))
    order, group, text, doc, place = order[by], group[by], text[by], doc[by], place[by]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    head = np.repeat(first, np.diff(np.append(first, len(group))))
    again = (doc != doc[head]) | (place != place[head])
    out = [np.zeros(max(int(s) - length + 1, 0), bool) for s in sizes]
    flat = np.zeros(start[-1] + 1, bool)
    flat[order[again]] = True
    return [flat[a : a + len(o)] for a, o in zip(start, out, strict=False)]


def runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the flagged strings."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) + length - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


#: Low bits of a place, which hold the tag of its text.
_TAG = 0x7FFFFFFF


def _ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """Id of each text and 31 bits of its hash; together they name a text."""
    tag = F.xxhash64(F.lit(3), F.col(text)).bitwiseAND(F.lit(_TAG)).cast("long")
    return df.select(F.col(key).alias("_key"), node_key(key, text).alias("_id"), tag.alias("_tag"), F.col(text).alias("_text"))


def _sides(spans: Spans, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Hashes of what surrounds an anchor closely on the left and on the right, 31 bits each; 0 where the text is too short.

    A string of ``length`` bytes around the anchor has half of its other bytes, or
    more, on one side of it.
    """
    half = (length - ANCHOR + 1) // 2
    short = _U(33)
    left = (spans.hash(np.maximum(at - half, lo), at) >> short) | _U(1)
    right = (spans.hash(at + ANCHOR, np.minimum(at + ANCHOR + half, hi)) >> short) | _U(1)
    left = np.where(at - half >= lo, left, _U(0))
    right = np.where(at + ANCHOR + half <= hi, right, _U(0))
    return (left << _U(32) | right).view(np.int64)


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Anchor hash, hash of surroundings and of their sides, document, and place of each anchor (with the text's tag in the low bits)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, rows = bytes_of(text_of(batch, "_text"))
        at, hashes = anchors(data, rows, length)
        spans = Spans(data)
        row = np.searchsorted(rows, at, "right") - 1
        lo, hi = np.maximum(at - (length - ANCHOR), rows[row]), np.minimum(at + length, rows[row + 1])
        around = spans.hash(lo, hi) ^ mix((at - lo).astype(np.uint64))
        place = ((at - rows[row]) << 31) | batch.column(1).to_numpy()[row]
        sides = _sides(spans, at, rows[row], rows[row + 1], length)
        ids = batch.column(0).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(around.view(np.int64)), pa.array(sides), ids, pa.array(place)], ["a", "c", "sides", "_id", "p"]
        )

    return map_slices(docs.select("_id", "_tag", "_text"), "_text", "a long, c long, sides long, _id long, p long", step)


def _surroundings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes around the wanted anchors (a, k, _id, p), and the place where they start."""
    tag = F.col("p").bitwiseAND(F.lit(_TAG)).alias("_tag")
    lists = wanted.groupBy("_id", tag).agg(F.collect_list(F.struct("a", "k", "p")).alias("at"))  # at most a text's anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = text_of(part, "_text")
            data, rows = bytes_of(texts)
            out: list[list] = [[], [], [], [], []]
            for r, (i, items) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                raw = data[rows[r] : rows[r + 1]].tobytes()
                for item in items:
                    at = item["p"] >> 31
                    lo = max(at - (length - ANCHOR), 0)
                    for column, value in zip(out, (item["a"], item["k"], i, lo << 31 | item["p"] & _TAG, raw[lo : at + length]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["a", "k", "_id", "p", "around"])

    texts = docs.join(lists, ["_id", "_tag"]).select("_id", "_text", "at")
    return texts.mapInArrow(run, "a long, k long, _id long, p long, around binary")


def _by_expansion(around: DataFrame, length: int) -> DataFrame:
    """Repeated ranges within blocks that hold all distinct surroundings of their anchors."""

    def solve(block: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(block)
        ids, p = table["_id"].to_numpy(), table["p"].to_numpy()
        found = [(ids[k], p[k] & 0x7FFFFFFF, (p[k] >> 31) + a, (p[k] >> 31) + b) for k, flags in enumerate(repeats(table["around"].to_pylist(), ids, p >> 31, length)) for a, b in runs(flags, length)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["_id", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for group in grouped(batches, 1):
            block.append(group)
            size += group["around"].nbytes
            if size >= BLOCK_BYTES:
                yield solve(block)
                block, size = [], 0
        if block:
            yield solve(block)

    return around.repartition("a").sortWithinPartitions("a").mapInArrow(run, "_id long, tag long, lo long, hi long")


def _by_hash(around: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many surroundings: each string by its own hash, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                raw = part.column(4).to_pylist()
                sizes = np.array([len(t) for t in raw])
                start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                count = np.maximum(sizes - length + 1, 0)
                owner = np.repeat(np.arange(len(raw)), count)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                joined = np.frombuffer(b"".join(raw), np.uint8)
                at = start[owner] + step
                one = Spans(joined).hash(at, at + length)
                two = Spans(joined ^ np.uint8(0x5A)).hash(at, at + length)
                p = part.column(3).to_numpy()[owner] + (step << 31)
                ids = part.column(2).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), ids, pa.array(p)], ["w1", "w2", "_id", "p"])

    strings = around.mapInArrow(run, "w1 long, w2 long, _id long, p long").distinct()
    first = strings.groupBy("w1", "w2").agg(F.min(F.struct("_id", F.col("p").bitwiseAND(F.lit(~_TAG)).alias("p"))).alias("f"))
    place = F.col("p").bitwiseAND(F.lit(~_TAG))
    later = strings.join(first, ["w1", "w2"]).where((F.col("_id") != F.col("f._id")) | (place != F.col("f.p")))
    lo = F.shiftright("p", 31)
    return later.select("_id", F.col("p").bitwiseAND(F.lit(_TAG)).alias("tag"), lo.alias("lo"), (lo + length).alias("hi"))


def _alike(distinct: DataFrame) -> DataFrame:
    """Of the distinct surroundings of an anchor, those that have a side in common with another one.

    Two surroundings that share a string of the threshold length around the anchor
    agree on half of its other bytes on the left or on the right. All others, which
    are most of those of a common phrase, are left out before any text is fetched.
    """
    left, right = F.shiftright("sides", 32), F.col("sides").bitwiseAND(F.lit((1 << 32) - 1))
    both = distinct.select("a", "c", "f", F.explode(F.array(left, -right)).alias("side")).where("side != 0")
    shared = both.groupBy("a", "side").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("a", "side")
    return both.join(shared, ["a", "side"]).groupBy("a", "c").agg(F.first("f").alias("f"))


def repeated_ranges(docs: DataFrame, length: int, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """Ranges (``_id``, ``tag``, lo, hi) whose strings of ``length`` bytes also start earlier, and the tables they are read from.

    The ranges may overlap and pass a text's ends.
    """
    # One shuffle; an anchor is one of many of each text, so even the commonest is a small share of all rows.
    often = F.count(F.lit(1)).over(Window.partitionBy("a"))
    again = saved(_anchor_rows(docs, length).withColumn("_n", often).where("_n > 1").drop("_n"), "anchors")
    distinct = saved(again.groupBy("a", "c").agg(F.min(F.struct("_id", "p")).alias("f"), F.first("sides").alias("sides"), F.count(F.lit(1)).alias("n")), "surroundings")
    copies = again.join(distinct.where("n > 1").select("a", "c", "f"), ["a", "c"]).where((F.col("_id") != F.col("f._id")) | (F.col("p") != F.col("f.p")))
    at = F.shiftright("p", 31)
    whole = copies.select("_id", F.col("p").bitwiseAND(F.lit(_TAG)).alias("tag"), (at - (length - ANCHOR)).alias("lo"), (at + length).alias("hi"))
    alike = saved(_alike(distinct), "alike")
    several = alike.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    wanted = alike.join(several, "a").select("a", "k", "f._id", "f.p")
    around = saved(_surroundings(docs, wanted, length), "around")
    some, many = around.where(F.col("k") <= group_rows), around.where(F.col("k") > group_rows)
    return whole.union(_by_expansion(some, length)).union(_by_hash(many, length)), [again, distinct, alike, around]


def _merged(items: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal ranges of one text."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(x["lo"], 0), min(x["hi"], size)) for x in items or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _lists(docs: DataFrame, length: int, group_rows: int) -> DataFrame:
    """The repeated ranges of each text."""
    ranges, tables = repeated_ranges(docs, length, group_rows)
    lists = saved(ranges.groupBy("_id", F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("lo", "hi")).alias("_cut")), "ranges")  # at most a text's anchors
    discard(*tables)
    return lists


def deduplicated(df: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """What is removed from every text, and a digest of what is left.

    Every byte in a string of ``length`` bytes that also starts earlier goes: at a
    smaller key, or in the same text at an earlier place. Null counts as empty. Rows
    without key come last, ordered by a number made from their text. Rows equal in key
    and text are one text, with equal results; texts that share a key are at the same
    places, so that only an earlier start counts between them. Other columns are
    ignored; an empty table gives no rows.

    Returns the key, n_bytes, n_removed, n_spans and kept_sha256.
    """
    docs = _ids(df, key, text)
    lists = _lists(docs, length, group_rows)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            data, rows = bytes_of(text_of(part, "_text"))
            out: list[list] = [[], [], [], []]
            for r, items in enumerate(part.column(2).to_pylist()):
                raw = data[rows[r] : rows[r + 1]].tobytes()
                gone, at, kept = _merged(items, len(raw)), 0, hashlib.sha256()
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for column, value in zip(out, (len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    rows = docs.join(lists, ["_id", "_tag"], "left").select("_key", "_text", "_cut")
    return rows.mapInArrow(run, f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_key", key)


def cut_texts(df: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """All columns, with the repeated strings cut out of ``text``; a character only partly inside stays.

    What is cut is what ``deduplicated`` removes; null texts stay null. Rows equal in
    key and text are cut alike. The columns of ``df`` may have any names.
    """
    docs = _ids(df, key, text)
    lists = _lists(docs, length, group_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            data, rows = bytes_of(text_of(part, "_text"))
            out = []
            for r, items in enumerate(part.column(2).to_pylist()):
                raw = data[rows[r] : rows[r + 1]].tobytes()
                kept, at = [], 0
                for a, b in _merged(items, len(raw)):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[at:a])
                    at = max(at, b)
                out.append(b"".join(kept + [raw[at:]]).decode())
            values = pa.array(out, pa.string())
            old = part.column(1)
            if old.null_count:
                values = pa.compute.if_else(old.is_valid(), values, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], ["_row", "_text"])

    others = [c for c in df.columns if c != text]
    whole = df.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("_row"), node_key(key, text).alias("_id"), F.col(text).alias("_text"))
    whole = whole.withColumn("_tag", F.xxhash64(F.lit(3), F.col("_text")).bitwiseAND(F.lit(_TAG)).cast("long"))
    marked = whole.join(lists, ["_id", "_tag"], "left").select("_row", "_text", "_cut")
    cut = marked.mapInArrow(run, marked.select("_row", "_text").schema)
    return cut.select(*[F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in df.columns])
