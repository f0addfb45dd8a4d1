"""Secret scan: fixed patterns, and a linear-chain conditional random field.

The field tags the words of a text as begin, inside or outside of a secret from
their shape, their neighbours and features of the whole text, and is decoded by
Viterbi. It is trained on the spans that the patterns find in a bounded sample.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from verbatim.llm.common import Words, map_slices, per_row, saved, slices, text_of

# The patterns, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Texts that windows without a secret are taken from: those with the smallest text hashes.
TRAIN_TEXTS = 6000
#: Most words of a training sequence, cut around the words of interest.
TRAIN_WORDS = 24
#: Most training sequences with a secret, of all texts that have any, and as many without.
TRAIN_SEQUENCES = 3000

#: Bytes of text that are tagged at once: the features take many times as much.
SLICE = 1 << 18

O, B, I = 0, 1, 2
#: Buckets of word hashes; the features are tables of weights over bucket numbers.
BUCKETS = 1 << 12
SHAPES = 1 << 11
FEATURES = ("shape", "signs", "own", "before", "before2", "after", "file")
SIZES = (SHAPES, 32, BUCKETS, BUCKETS, BUCKETS, BUCKETS, 64)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches of one text, leftmost and non-overlapping per kind, in code points."""
    out = []
    low = None
    if "=" in text or ":" in text:
        low = text.lower()
        if any(c in low for c in _CUES):
            out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5


def features(w: Words) -> list[np.ndarray]:
    """Bucket numbers of each feature for all words of a slice."""
    total = len(w.start)
    kind = _CLASS[w.data]
    length = w.end - w.start
    sums = {}
    for k in (1, 2, 3, 5):
        c = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(kind == k, out=c[1:])
        sums[k] = c[w.end] - c[w.start]
    change = np.zeros(len(w.data) + 1, np.int32)
    if len(kind) > 1:
        flips = ((kind[1:] == 1) != (kind[:-1] == 1)) & (kind[1:] != 0) & (kind[:-1] != 0)
        np.cumsum(flips, out=change[2:])
    turns = change[w.end] - change[w.start + 1]
    hexes = np.zeros(len(w.data) + 1, np.int32)
    np.cumsum((kind == 1) | ((w.data >= 97) & (w.data <= 102)), out=hexes[1:])
    only_hex = hexes[w.end] - hexes[w.start] >= length - 2
    size = np.searchsorted(np.array([4, 8, 12, 16, 20, 32, 64]), length, "right")
    twist = np.minimum(np.searchsorted(np.array([1, 3, 6]), turns, "right"), 3)
    shape = (sums[1] > 0) | ((sums[2] > 0).astype(int) << 1) | ((sums[3] > 0).astype(int) << 2) | ((sums[5] > 0).astype(int) << 3)
    shape = shape | (only_hex.astype(int) << 4) | (size << 5) | (twist << 8)
    plain = (sums[1] == 0) & (length <= 16)
    own = np.where(plain, (w.hash % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, 0)

    def shifted(by: int) -> np.ndarray:
        out = np.zeros(total, np.int64)
        if total > abs(by):
            src, dst = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
            same = w.row[src] == w.row[dst]
            out[dst] = np.where(same, own[src], 0)
        return out

    digits = per_row(sums[1] > 0, w.first)
    share = np.searchsorted(np.array([0.01, 0.05, 0.2]), digits / np.maximum(w.count, 1), "right")
    long_text = np.searchsorted(np.array([50, 300, 2000]), w.count, "right")
    file = (share | (long_text << 2))[w.row] | ((sums[1] > 0).astype(int) << 4)
    # The signs of a word without its length, so that a length never seen is no obstacle.
    return [shape, shape & 31, own, shifted(1), shifted(2), shifted(-1), file]


@dataclass(frozen=True)
class Field:
    """Weights of each feature's buckets for the three tags, and of tag pairs."""

    tables: tuple[np.ndarray, ...]
    moves: np.ndarray

    def emissions(self, found: list[np.ndarray]) -> np.ndarray:
        return sum(t[f] for t, f in zip(self.tables, found, strict=True))

    def decode(self, scores: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Best tags by Viterbi.

        Where "outside" leads by more than the pair weights can make up for, it is
        certain, and the words on either side no longer depend on each other. Only
        the runs between such words are decoded, all of them in step.
        """
        n = len(scores)
        tags = np.zeros(n, np.int8)
        m = self.moves
        swing = max(
            m[a, x] + m[x, b] - m[a, O] - m[O, b] for a in (O, B, I) for b in (O, B, I) for x in (B, I)
        )
        open_ = np.flatnonzero(scores[:, O] - scores[:, 1:].max(axis=1) <= max(swing, 0.0) + max(float(np.abs(m).max()), 0.0))
        if not len(open_):
            return tags
        split = np.ones(len(open_), bool)
        split[1:] = (np.diff(open_) > 1) | (row[open_[1:]] != row[open_[:-1]])
        start = open_[split]
        ends = np.append(np.flatnonzero(split)[1:], len(open_))
        length = ends - np.flatnonzero(split)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        before_o = (start > 0) & (row[start] == row[start - 1])
        best = scores[start] + np.where(before_o[:, None], m[O], 0.0)
        back = [None]
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))
            path = best[:live, :, None] + m[None]
            back.append(path.argmax(axis=1).astype(np.int8))
            best[:live] = path.max(axis=1) + scores[start[:live] + t]
        last = start + length - 1
        after_o = (last + 1 < n) & (row[last] == row[np.minimum(last + 1, n - 1)])
        final = (best + np.where(after_o[:, None], m[:, O], 0.0)).argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            tags[start[:live] + t] = final[:live]
            if t:
                final[:live] = back[t][np.arange(live), final[:live]]
        return tags


def _char_starts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Code point places of word starts and ends within their text."""
    to = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=to[1:])
    base = to[w.rows[:-1]][w.row]
    return to[w.start] - base, to[w.end] - base


def _training(rows: DataFrame) -> list:
    """Windows of words with tags, from the chosen texts (``_text``, ``_plain``); at most the stated number of each kind.

    Windows with a secret come from every chosen text, those without one from the
    texts marked as plain.
    """
    columns = ", ".join(f"{f} array<long>" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE):
            texts = text_of(part, "_text")
            plain = part.column(1).to_pylist()
            w = Words(texts)
            lo, hi = _char_starts(w)
            found = features(w)
            tags = np.zeros(len(lo), np.int64)
            at, secret = [], []
            for r, text in enumerate(texts.to_pylist()):
                a, b = w.first[r], w.first[r + 1]
                reach = 0
                for _, s, e in base_spans(text):
                    if s < reach:
                        reach = max(reach, e)
                        continue
                    reach = e
                    i, j = a + np.searchsorted(hi[a:b], s, "right"), a + np.searchsorted(lo[a:b], e, "left")
                    tags[i], tags[i + 1 : j] = B, I
                    at.append(max(a, i - TRAIN_WORDS // 2))
                    secret.append(True)
                if b > a and plain[r]:  # the word with most digits, and one in the middle
                    for i in (a + int(np.argmax(found[0][a:b] & 1)), (a + b) // 2):
                        at.append(max(a, i - TRAIN_WORDS // 2))
                        secret.append(False)
            at_, stop = np.array(at, np.int64), [min(x + TRAIN_WORDS, w.first[w.row[x] + 1]) for x in at]
            lists = [pa.array([f[x:y].tolist() for x, y in zip(at_, stop, strict=True)], pa.list_(pa.int64())) for f in (*found, tags)]
            yield pa.RecordBatch.from_arrays([pa.array(secret, pa.bool_()), *lists], ["secret", *FEATURES, "tags"])

    all_ = saved(rows.mapInArrow(run, f"secret boolean, {columns}, tags array<long>"), "crf-train")
    hashed = F.xxhash64("shape", "own", "tags")
    pick = lambda kind: all_.where(F.col("secret") == kind).orderBy(hashed, "tags").limit(TRAIN_SEQUENCES)
    return pick(True).union(pick(False)).collect()


def train(df: DataFrame, text: str = "text", steps: int = 80) -> Field:
    """Fit the field by gradient steps on the log-likelihood; where no text of the table has a secret it tags nothing."""
    hashed = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE):
            yield part.select(["_h"]).filter(pa.array([bool(base_spans(t)) for t in text_of(part, "_text").to_pylist()], pa.bool_()))

    # Texts with a secret are looked for in the whole table: a sample may hold none of the few.
    least = lambda rows, n, plain: rows.distinct().orderBy("_h").limit(n).withColumn("_plain", F.lit(plain))
    wanted = least(hashed.mapInArrow(labelled, "_h long"), TRAIN_SEQUENCES, False).union(least(hashed.select("_h"), TRAIN_TEXTS, True))
    # At most TRAIN_SEQUENCES + TRAIN_TEXTS hashes.
    chosen = F.broadcast(saved(wanted.groupBy("_h").agg(F.max("_plain").alias("_plain")).coalesce(1), "crf-sample"))
    rows = hashed.join(chosen, "_h").dropDuplicates(["_h"]).select("_text", "_plain")
    sample = _training(rows)
    tables = [np.zeros((n, 3)) for n in SIZES]
    moves = np.zeros((3, 3))
    if not any(r.secret for r in sample):
        tables[0][:, O] = 50.0
        return Field(tuple(tables), moves)
    n, longest = len(sample), max(len(r.tags) for r in sample)
    there = np.zeros((n, longest), bool)
    found = np.zeros((len(FEATURES), n, longest), np.int64)
    tags = np.zeros((n, longest), np.int64)
    for k, r in enumerate(sample):
        there[k, : len(r.tags)] = True
        tags[k, : len(r.tags)] = r.tags
        for f, name in enumerate(FEATURES):
            found[f, k, : len(r.tags)] = r[name]
    pair = there[:, 1:] & there[:, :-1]
    hot = np.eye(3)[tags] * there[:, :, None]
    # Few windows with a secret weigh as much as the many without.
    secret = np.array([r.secret for r in sample])
    weight = np.where(secret, max(1.0, (n - secret.sum()) / secret.sum()), 1.0)
    first = [np.zeros_like(p) for p in (*tables, moves)]
    second = [np.zeros_like(p) for p in (*tables, moves)]
    for step in range(1, steps + 1):
        e = sum(t[found[f]] for f, t in enumerate(tables)) * there[:, :, None]
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            s = ahead[:, t - 1, :, None] + moves
            top = s.max(axis=1)
            go = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) + e[:, t]
            ahead[:, t] = np.where(there[:, t, None], go, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            s = moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :]
            top = s.max(axis=2)
            behind[:, t] = np.where(there[:, t + 1, None], top + np.log(np.exp(s - top[:, :, None]).sum(axis=2)), 0.0)
        z = ahead[:, -1].max(axis=1)
        z = z + np.log(np.exp(ahead[:, -1] - z[:, None]).sum(axis=1))
        unary = np.exp(ahead + behind - z[:, None, None]) * there[:, :, None]
        push = (hot - unary) * weight[:, None, None]
        both = np.exp(ahead[:, :-1, :, None] + moves + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None])
        seen = np.einsum("nti,ntj,nt,n->ij", hot[:, :-1], hot[:, 1:], pair, weight)
        grads = [np.stack([np.bincount(found[f].ravel(), push[:, :, c].ravel(), size) for c in range(3)], axis=1) for f, size in enumerate(SIZES)]
        grads.append(seen - (both * (pair * weight[:, None])[:, :, None, None]).sum(axis=(0, 1)))
        for k, (p, g) in enumerate(zip((*tables, moves), grads, strict=True)):
            g = g / weight.sum() - 1e-4 * p
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += 0.25 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    # A bucket never seen gives no evidence; words are outside unless something speaks for a secret.
    return Field(tuple(t.astype(np.float32) for t in tables), moves.astype(np.float32))


#: Letters and digits of a span that the field may add: as many as the shortest value of the patterns has.
LEAST_SIGNS = 6
_TRIM = "\"'`()[]{}<>,;:!?."


def found_spans(batch_texts: pa.Array, field: Field) -> list[list[tuple[str, int, int]]]:
    """Base spans of each text, and those of the field that touch none of them."""
    w = Words(batch_texts)
    tags = field.decode(field.emissions(features(w)), w.row) if len(w.start) else np.zeros(0, np.int8)
    lo, hi = _char_starts(w)
    out = []
    tagged = per_row(tags > 0, w.first) if len(tags) else np.zeros(len(batch_texts), np.int64)
    for r, text in enumerate(batch_texts.to_pylist()):
        spans = base_spans(text)
        if tagged[r]:
            added, a = [], w.first[r]
            # Base spans are sorted by start; how far any of them reaches so far settles a touch with one look.
            starts, reach = [x for _, x, _ in spans], list(accumulate((y for _, _, y in spans), max))
            own = tags[a : w.first[r + 1]]
            at = 0
            while at < len(own):
                if not own[at]:
                    at += 1
                    continue
                to = at + 1
                while to < len(own) and own[to] == I:
                    to += 1
                s, e = int(lo[a + at]), int(hi[a + to - 1])
                while s < e and text[s] in _TRIM:
                    s += 1
                while e > s and text[e - 1] in _TRIM:
                    e -= 1
                before = bisect_left(starts, e)
                if sum(map(str.isalnum, text[s:e])) >= LEAST_SIGNS and not (before and reach[before - 1] > s):
                    added.append(("crf", s, e))
                at = to
            spans = sorted(spans + added, key=lambda s: (s[1], KINDS.index(s[0])))
        out.append(spans)
    return out


def scan(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and secret spans (kind, start, end) of every text, in code points, end exclusive.

    Null and empty texts have no spans. Rows are scanned one by one; other columns
    are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = found_spans(text_of(batch, "_text"), field)
        spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], span)
        return pa.RecordBatch.from_arrays([batch.column(0), spans], ["_key", "spans"])

    rows = map_slices(
        df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text",
        f"_key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", step, SLICE,
    )
    return rows.withColumnRenamed("_key", key)


def redacted(df: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All columns, with every secret in ``text`` replaced by a mark; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            texts = text_of(part, text)
            out = []
            for t, spans in zip(texts.to_pylist(), found_spans(texts, field), strict=True):
                done, at = [], 0
                for _, a, b in spans:
                    if a >= at:
                        done += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join(done) + t[at:] if spans else t)
            place = part.schema.get_field_index(text)
            values = pa.array(out, pa.string())
            old = part.column(place)
            if old.null_count:
                values = pa.compute.if_else(old.is_valid(), values, pa.scalar(None, pa.string()))
            yield part.set_column(place, pa.field(text, pa.string()), values)

    return df.mapInArrow(run, df.schema)
