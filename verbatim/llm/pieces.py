"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

Normalisation follows the model: the longest prefix found in its compiled character
map is replaced, blanks become the blank mark, and each byte of the result remembers
which source byte it came from. Pieces never join across the start of a run of blank
marks, so a text is cut there, and each part is segmented once per worker and kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from verbatim.llm.common import map_slices, text_of

BLANK = "▁"
_BLANK = BLANK.encode()
#: Most parts that a worker keeps; the table is emptied when full, which changes no result.
PARTS_KEPT = 300_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """Compiled character map: a double-array trie of UTF-8 keys, and their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, found = self.units, None
        base = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = base(units[0])
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= base(unit)
            if unit >> 8 & 1:
                place = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.texts[place : self.texts.index(0, place)])
        return found


@dataclass(frozen=True)
class Spec:
    """What a model file says about normalisation."""

    char_map: CharMap
    dummy_prefix: bool
    trim: bool
    cuts: bool

    @staticmethod
    def of(blob: bytes) -> Spec:
        norm, inner = {1: b"", 2: b"", 3: 1, 4: 1}, False
        for number, value in fields(blob):
            if number == 3:
                norm |= dict(fields(value))
            elif number == 1:
                piece = dict(fields(value)).get(1, b"").lstrip(_BLANK) if isinstance(value, bytes) else b""
                inner |= piece.find(_BLANK) >= 0 if isinstance(piece, bytes) else False
        return Spec(CharMap(norm[2]), bool(norm[3]), bool(norm[4]), not inner)


def _steps(data: bytes, char_map: CharMap) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while at < len(data):
        found = char_map.longest(data, at)
        if found is None:
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            found = (size, data[at : at + size])
        yield at, found[0], found[1]
        at += found[0]


def normalised(text: str, spec: Spec) -> tuple[bytes, np.ndarray]:
    """Normal form, and for each of its bytes and its end the source byte that it came from."""
    source = text.encode()
    if not spec.char_map and not spec.trim:
        # Nothing is replaced: only blanks grow to the three bytes of their mark.
        if not source:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(source, np.uint8)
        width = np.where(data == 32, 3, 1)
        origin = np.repeat(np.arange(len(data), dtype=np.int32), width)
        out = source.replace(b" ", _BLANK)
        if spec.dummy_prefix:
            out, origin = _BLANK + out, np.concatenate([np.zeros(3, np.int32), origin])
        return out, np.append(origin, len(data))
    out, origin = bytearray(), []
    steps = list(_steps(source, spec.char_map))
    if spec.trim:
        while steps and steps[0][2].strip(b" ") == b"":
            steps.pop(0)
        while steps and steps[-1][2].strip(b" ") == b"":
            steps.pop()
    if not steps:
        return b"", np.array([len(source)])
    if spec.dummy_prefix:
        out += _BLANK
        origin += [steps[0][0]] * 3
    for at, _, value in steps:
        for byte in value:
            if byte == 32 and spec.trim and out.endswith(_BLANK):
                continue
            part = _BLANK if byte == 32 else bytes([byte])
            out += part
            origin += [at] * len(part)
    end = steps[-1][0] + steps[-1][1]
    if spec.trim and out.endswith(_BLANK):
        del out[-3:]
        end = origin[-3]
        del origin[-3:]
    return bytes(out), np.append(np.array(origin, np.int64), end)


class Part(NamedTuple):
    """What is kept of one part: ids, the same as text, normalised bytes of each piece, and decoded text."""

    ids: list[int]
    listed: str
    widths: bytes
    decoded: str


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: str) -> None:
        blob = open(model, "rb").read()
        self.spec = Spec.of(blob)
        if not self.spec.cuts or not self.spec.dummy_prefix:
            raise ValueError("this model joins pieces across blanks or puts none in front; cutting at blanks would change its ids")
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        self.byte = [int(self.model.id_to_piece(i)[3:5], 16) if self.model.is_byte(i) else None for i in range(n)]
        self.bare = ["" if self.model.is_control(i) else " ⁇ " if self.model.is_unknown(i) else self.model.id_to_piece(i) for i in range(n)]
        self.width = [1 if self.byte[i] is not None else len(self.bare[i].encode()) for i in range(n)]
        self.name = [str(i) for i in range(n)]
        #: Ids that are not simply their text.
        self.odd = frozenset(i for i in range(n) if self.byte[i] is not None or self.model.is_control(i) or self.model.is_unknown(i))
        self.end = self.model.eos_id()
        #: Parts by the text after their first blank mark.
        self.kept: dict[str, Part] = {}

    def learn(self, parts: Iterable[str]) -> None:
        """Segment the parts that are not known yet, in one call of the library.

        The library itself puts the first blank mark in front of each.
        """
        new = list({p for p in parts if p not in self.kept})
        if len(self.kept) + len(new) > PARTS_KEPT:
            new = list(set(parts))
            self.kept.clear()
        for part, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            ids = ids if part else [self.model.piece_to_id(BLANK)]
            widths = array("I", [self.width[i] for i in ids])
            if self.odd.isdisjoint(ids):
                decoded = " " + part.replace(BLANK, " ")
            else:
                short = 3 + len(part.encode()) - sum(widths)
                if short:  # an unknown piece takes what the others leave
                    widths[next(k for k, i in enumerate(ids) if self.model.is_unknown(i))] += short
                decoded = self._decoded(ids)
            self.kept[part] = Part(ids, " ".join([self.name[i] for i in ids]), widths.tobytes(), decoded)

    def _decoded(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if self.byte[i] is not None:
                run.append(self.byte[i])
                continue
            out.append(bytes(run).decode("utf-8", "replace") + self.bare[i])
            run.clear()
        return "".join(out + [bytes(run).decode("utf-8", "replace")]).replace(BLANK, " ")

    def parts_of(self, normal: str) -> list[str]:
        """Parts of a normalised text, each a run of blank marks and what follows; the first mark is left out."""
        chunks = normal.split(BLANK)[1:]
        if "" not in chunks:
            return chunks
        out, marks = [], 0
        for chunk in chunks:
            if chunk:
                out.append(BLANK * marks + chunk)
                marks = 0
            else:
                marks += 1
        return out + [BLANK * (marks - 1)] * bool(marks)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[Part], np.ndarray]]:
        """For each text its parts, and the source byte where each piece starts, one more entry for the end."""
        normal = [normalised(t, self.spec) for t in texts]
        cut = [self.parts_of(data.decode()) for data, _ in normal]
        self.learn([p for parts in cut for p in parts])
        for parts, (_, origin) in zip(cut, normal, strict=True):
            known = [self.kept[p] for p in parts]
            widths = np.frombuffer(b"".join([k.widths for k in known]), "<u4")
            places = np.zeros(len(widths) + 1, np.int64)
            np.cumsum(widths, out=places[1:])
            yield known, origin[places]

    def decode(self, parts: list[Part]) -> str:
        """Text of the parts; the blank in front, which normalisation added, goes."""
        return "".join([p.decoded for p in parts]).removeprefix(" ")


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids with the end id, source byte span of each piece, and decoded text.

    ``starts`` has the first source byte of each piece and, last, the end of the
    text, so that piece k spans ``starts[k]`` to ``starts[k + 1]``; the blank put in
    front takes no byte. Null texts count as empty: the end id alone. Rows are
    encoded one by one; other columns are ignored.
    """
    made: list[Codec] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Codec(model))
        ids, starts, texts = [], [], []
        for parts, places in made[0].encode(text_of(batch, "_text").to_pylist()):
            ids.append([i for p in parts for i in p.ids] + [made[0].end])
            starts.append(places)
            texts.append(made[0].decode(parts))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(texts, pa.string())],
            ["_key", "ids", "starts", "decoded"],
        )

    kind = df.schema[key].dataType.simpleString()
    rows = map_slices(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", f"_key {kind}, ids array<int>, starts array<long>, decoded string", step)
    return rows.withColumnRenamed("_key", key)


def digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, digests of ids and of decoded text, and whether every piece spans the source in order.

    The same encoding as ``encode``, without sending the ids themselves out of the task.
    """
    made: list[Codec] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Codec(model))
        codec, rows = made[0], []
        for parts, places in codec.encode(text_of(batch, "_text").to_pylist()):
            listed = " ".join([p.listed for p in parts] + [str(codec.end)])
            rows.append((
                len(places), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(parts).encode()).hexdigest(),
                int(places[-1]), bool((np.diff(places) >= 0).all()),
            ))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
            ["_key", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "in_order"],
        )

    kind = df.schema[key].dataType.simpleString()
    columns = f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, in_order boolean"
    rows = map_slices(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", columns, step)
    return rows.withColumnRenamed("_key", key)
