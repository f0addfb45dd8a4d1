"""Token counts by finite-state transducers compiled from a tokenizer file.

Two deterministic transducers run in a row. The first reads classes of characters and
marks where pieces start. The second reads the bytes of one piece; each transition
says how many tokens more (or fewer) the piece read so far has, and a last transition
ends the piece. Its states are compiled when first met: the longest end of the bytes
read that some token begins with, and the last token and the count at each place in
it. That is enough, because a merged sequence is the right one exactly if each two
neighbours stay apart when merged alone, and because its beginnings are right as well.

Texts become one stream, cut into chunks without regard to pieces. For the first
transducer each chunk yields a map from every state to the state after it, maps are
composed by a parallel prefix scan, and every chunk then runs from its true state.
Pieces longer than a chunk are cut likewise; as the second transducer has too many
states for whole maps, a chunk's map has the entry states that are tried: the one
after some bytes of the chunk before, and then what the composition asks for.
"""

from __future__ import annotations

import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verbatim.llm.common import map_slices, text_of
from verbatim.llm.packing import byte_signs

#: Characters of the stream that are worked on at once; a longer text is cut at white space.
STREAM = 1 << 18
#: Characters of a chunk of the stream, and bytes of a chunk of a long piece.
CHUNK, PIECE_CHUNK = 256, 64
#: Bytes of pieces between two looks at the number of states, and the number that empties the table.
BLOCK_BYTES, MOST_STATES = 1 << 16, 200_000
END = 256

# Fixed value: how the file must say that text is normalised and split; other files are refused.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: normalizers of such a file, by type.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

# Classes of characters. Letters that end or go on with a suffix after an apostrophe have their own.
BLANK, NUMBER, OTHER, APOSTROPHE, LETTER, ENDS, R, V, L, E = range(10)
# States: after a blank, in letters, in other signs, after a whole piece, after an apostrophe that starts a piece, and after that and r, v or l.
OUT, LETTERS, OTHERS, WHOLE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(8)
# Marks: a piece starts here; a piece started one character ago.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each state and class."""
    to, mark = np.zeros((8, 10), np.uint8), np.zeros((8, 10), np.uint8)
    for state in range(8):
        for cls in range(10):
            letter = cls >= LETTER
            if cls == BLANK:
                to[state, cls] = OUT
            elif state == OTHERS and cls in (OTHER, APOSTROPHE):
                to[state, cls] = OTHERS
            else:
                to[state, cls] = WHOLE if cls == NUMBER else OTHERS if cls == OTHER else QUOTE if cls == APOSTROPHE else LETTERS
                mark[state, cls] = 0 if state == LETTERS and letter else HERE
    to[QUOTE, [OTHER, APOSTROPHE]], mark[QUOTE, [OTHER, APOSTROPHE]] = OTHERS, 0
    to[QUOTE, [ENDS, R, V, L]], mark[QUOTE, [ENDS, R, V, L]] = [WHOLE, QUOTE_R, QUOTE_V, QUOTE_L], 0
    for state, last in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        # Not a suffix after all: the letter before started a run of letters.
        to[state], mark[state] = to[LETTERS], mark[LETTERS] | BEFORE
        to[state, last], mark[state, last] = WHOLE, 0
    return to, mark


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Compositions of each row with all rows before it, in a logarithmic number of steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


class Splitter:
    """First transducer: where the pieces of a stream of classes start."""

    def __init__(self) -> None:
        self.to, self.mark = splitter()

    def marks(self, classes: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each character; the stream begins after a blank and ends with one."""
        n = len(classes)
        rows = -(-n // CHUNK)
        chunk = np.zeros(rows * CHUNK, np.uint8)
        chunk[:n] = classes
        columns = np.ascontiguousarray(chunk.reshape(rows, CHUNK).T)
        maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
        flat = self.to.ravel()
        for column in columns:
            maps = flat[maps * np.uint8(10) + column[:, None]]
        state = np.full(rows, OUT, np.uint8)
        state[1:] = prefix_scan(maps)[:-1, OUT]
        made = np.empty((CHUNK, rows), np.uint8)
        marks = self.mark.ravel()
        for k, column in enumerate(columns):
            at = state * np.uint8(10) + column
            made[k] = marks[at]
            state = flat[at]
        made = np.ascontiguousarray(made.T).ravel()[:n]
        starts = (made & HERE).astype(bool)
        starts[:-1] |= (made[1:] & BEFORE).astype(bool)
        return starts


class Merges:
    """Merge rules of a file, on numbers of symbols."""

    def __init__(self, model: dict) -> None:
        suffix = model["end_of_word_suffix"] or ""
        vocab, byte = model["vocab"], byte_signs()
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(rules)}
        self.single = [vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        self.single_end = [vocab[c + suffix] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        #: Bytes of every token, and tokens by bytes, inside and at the end of a piece.
        self.bytes: dict[int, bytes] = {}
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for token, number in vocab.items():
            ends = bool(suffix) and token.endswith(suffix)
            value = bytes(byte[c] for c in (token.removesuffix(suffix) if ends else token))
            self.bytes[number] = value
            (self.last if ends else self.inner)[value] = number
        if not suffix:
            self.last = self.inner
        self.ending = frozenset(self.last.values()) if suffix else frozenset()

    def symbols(self, token: int) -> list[int]:
        value = self.bytes[token]
        out = [self.single[b] for b in value]
        if token in self.ending:
            out[-1] = self.single_end[value[-1]]
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost of equal ones."""
        while len(symbols) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(pairwise(symbols)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            symbols = [*symbols[:k], self.rank[symbols[k], symbols[k + 1]][1], *symbols[k + 2 :]]
        return symbols


#: A state: the bytes that matter, the last token at each place in them (-1: the piece starts there), and the count there less the count now.
State = tuple[bytes, tuple[int, ...], tuple[int, ...]]
START: State = (b"", (-1,), (0,))


class Counter:
    """Second transducer: tokens of pieces, from states that are compiled when first met."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.apart: dict[tuple[int, int], bool] = {}
        alive = lambda tokens: {b: t for b, t in tokens.items() if merges.merged(merges.symbols(t)) == [t]}
        self.inner, self.last = alive(merges.inner), alive(merges.last)
        self.begun = {b[:k] for b in self.inner for k in range(len(b))} | {b[:k] for b in self.last for k in range(len(b) + 1)}
        self.reach = max(map(len, [*self.inner, *self.last]))
        self.clear()

    def clear(self) -> None:
        self.states: list[State] = [START]
        self.number: dict[State, int] = {START: 0}
        # Bytes get a column of the tables when first met, most texts have few of the 256.
        self.column = np.full(END + 1, -1, np.int64)
        self.columns = 0
        self.to, self.more = np.full((1024, 32), -1, np.int32), np.zeros((1024, 32), np.int8)

    def bound(self) -> None:
        """Forget the states when there are too many; they are compiled again when met."""
        if len(self.states) > MOST_STATES:
            self.clear()

    def numbered(self, state: State) -> int:
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            if number >= len(self.to):
                self.grow(0)
        return number

    def grow(self, axis: int) -> None:
        self.to = np.concatenate([self.to, np.full_like(self.to, -1)], axis)
        self.more = np.concatenate([self.more, np.zeros_like(self.more)], axis)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when their symbols are merged together."""
        if a < 0:
            return True
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 1 << 20:
                self.apart.clear()
            found = self.apart[a, b] = self.merges.merged(self.merges.symbols(a) + self.merges.symbols(b)) == [a, b]
        return found

    def _last(self, state: State, word: bytes, tokens: dict[bytes, int]) -> tuple[int, int]:
        """The one token that can end ``word``, and the count with it."""
        _, before, counts = state
        for size in range(len(word), 0, -1):
            token = tokens.get(word[len(word) - size :])
            if token is not None and self.may_follow(before[len(word) - size], token):
                return token, counts[len(word) - size] + 1
        raise ValueError("the file's merges give no tokens for some bytes")

    def compile(self, number: int, symbol: int) -> None:
        state, column = self.states[number], self.column[symbol]
        if symbol == END:
            self.to[number, column], self.more[number, column] = 0, self._last(state, state[0], self.last)[1]
            return
        word = state[0] + bytes([symbol])
        token, more = self._last(state, word, self.inner)
        cut = next(k for k in range(len(word) + 1) if word[k:] in self.begun)
        word, before, counts = word[cut:], [*state[1], token][cut:], [*state[2], more][cut:]
        # Only places where some token may still start and go on are remembered.
        alive = [word[k:] in self.begun for k in range(len(word) + 1)]
        new = (word, tuple(b if a else -2 for a, b in zip(alive, before, strict=True)), tuple(c - more if a else 0 for a, c in zip(alive, counts, strict=True)))
        target = self.numbered(new)
        self.to[number, column], self.more[number, column] = target, more

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the counts of many lanes at once."""
        column = self.column[symbol]
        if (column < 0).any():
            for s in set(symbol[column < 0].tolist()):
                if self.columns == self.to.shape[1]:
                    self.grow(1)
                self.column[s], self.columns = self.columns, self.columns + 1
            column = self.column[symbol]
        new = self.to[state, column]
        missing = np.flatnonzero(new < 0)
        if len(missing):
            for s, c in sorted(set(zip(state[missing].tolist(), symbol[missing].tolist(), strict=True))):
                self.compile(s, c)
            new = self.to[state, column]
        return new, self.more[state, column]

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last states and changes of the counts of byte ranges read from given states, side by side."""
        order = np.argsort(-size, kind="stable")
        start, size, state = start[order], size[order], state[order].copy()
        count = np.zeros(len(order), np.int64)
        lanes = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for k, n in enumerate(lanes.tolist()):
            state[:n], more = self.step(state[:n], data[start[:n] + k].astype(np.int64))
            count[:n] += more
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def long(self, data: np.ndarray, start: int, end: int, first: int) -> tuple[int, int]:
        """Last state and count of a long byte range read from one state, by chunks with maps of the entry states that matter."""
        at = np.arange(start, end, PIECE_CHUNK)
        size = np.minimum(PIECE_CHUNK, end - at)
        # First guess: as if the piece started some bytes before the chunk.
        warm = np.minimum(at - start, self.reach)
        entry = self.run(data, at - warm, warm, np.zeros(len(at), np.int64))[0].tolist()
        entry[0] = first
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in entry]
        while True:
            todo = np.array([k for k, e in enumerate(entry) if e not in maps[k]], np.int64)
            if len(todo):
                left, more = self.run(data, at[todo], size[todo], np.array(entry)[todo])
                for k, s, c in zip(todo.tolist(), left.tolist(), more.tolist(), strict=True):
                    maps[k][entry[k]] = (s, c)
            # Composed so far: one chunk more at least has its true entry state now.
            follow = [first, *(m[e][0] for m, e in zip(maps[:-1], entry, strict=False))]
            if follow == entry:
                return maps[-1][entry[-1]][0], sum(m[e][1] for m, e in zip(maps, entry, strict=True))
            entry = follow

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of tokens of each piece, given by byte ranges."""
        out = np.zeros(len(start), np.int64)
        size = end - start
        short = np.flatnonzero(size <= 4 * PIECE_CHUNK)
        block = np.cumsum(size[short]) // BLOCK_BYTES
        for part in np.split(short, np.flatnonzero(np.diff(block)) + 1) if len(short) else []:
            self.bound()
            state, count = self.run(data, start[part], size[part], np.zeros(len(part), np.int64))
            out[part] = count + self.step(state, np.full(len(part), END))[1]
        for k in np.flatnonzero(size > 4 * PIECE_CHUNK).tolist():
            state, at = START, 0
            for at in range(int(start[k]), int(end[k]), BLOCK_BYTES):
                self.bound()
                number, count = self.long(data, at, min(at + BLOCK_BYTES, int(end[k])), self.numbered(state))
                state = self.states[number]
                out[k] += count
            out[k] += int(self.step(np.array([number]), np.array([END]))[1][0])
        return out


class Tokenizer:
    """The compiled transducers of one worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        steps = made["pre_tokenizer"].get("pretokenizers", [])
        known = (
            [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])] == NORMALIZERS
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": SPLIT}
            and not steps[1]["add_prefix_space"]
            and made["model"]["type"] == "BPE"
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        )
        if not known:
            raise ValueError("only tokenizers that lower-case, drop white space and split into letters, digits and other signs are known")
        library = Library.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.counter = Counter(Merges(made["model"]))
        self.splitter = Splitter()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or r"(?!)")
        self.classes = np.full(0x110000, 255, np.uint8)
        for cls, letters in ((APOSTROPHE, "'"), (ENDS, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
            self.classes[[ord(c) for c in letters]] = cls

    def class_of(self, char: str) -> int:
        """What the library's own splitting makes of a character."""
        around = [p for p, _ in self.split.pre_tokenize_str(f"a{char}a")]
        if len(around) < 3:
            return LETTER if len(around) == 1 else BLANK
        return OTHER if len(self.split.pre_tokenize_str(f"!{char}!")) == 1 else NUMBER

    def segments(self, text: str) -> tuple[list[str], int]:
        """Normalised parts of a text, cut at special strings and in long texts at blanks, and the number of special strings."""
        parts = self.special.split(text)
        out = []
        for part in parts:
            at = 0
            while len(part) - at > STREAM:
                blank = _BLANKS.search(part, at + STREAM)
                to = blank.start() if blank else len(part)
                out.append(self.normalised(part[at:to]))
                at = to
            out.append(self.normalised(part[at:]))
        return out, len(parts) - 1

    def normalised(self, part: str) -> str:
        # Up to U+02FF nothing composes, and lower case does not depend on neighbours.
        return part.lower() if not _COMPOSING.search(part) else self.normal.normalize_str(part)

    def pieces(self, stream: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a stream, byte ranges of its pieces, and the character where each starts."""
        points = np.frombuffer(stream.encode("utf-32-le"), "<u4")
        classes = self.classes[points]
        for point in np.unique(points[classes == 255]).tolist():
            self.classes[point] = self.class_of(chr(point))
        classes = self.classes[points]
        marks = self.splitter.marks(classes)
        starts = np.flatnonzero(marks)
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64), out=place[1:])
        # A piece ends before the next blank or piece.
        stops = np.flatnonzero(marks | (classes == BLANK))
        ends = stops[np.searchsorted(stops, starts, "right")]
        return np.frombuffer(stream.encode(), np.uint8), place[starts], place[ends], starts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            parts, special = self.segments(text)
            out[k] += special
            for part in parts:
                held.append((k, part))
                size += len(part) + 1
                if size >= STREAM:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, str]]) -> None:
        if not held:
            return
        data, start, end, first = self.pieces("\n".join([part for _, part in held]) + "\n")
        begins = np.cumsum([0, *(len(part) + 1 for _, part in held)])
        row = np.array([k for k, _ in held])[np.searchsorted(begins, first, "right") - 1]
        out += np.bincount(row, self.counter.counts(data, start, end), len(out)).astype(np.int64)


_COMPOSING = re.compile("[^\x00-\u02ff]")
_BLANKS = re.compile(r"[ \t-\r]")


def token_counts(df: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every text as the file's own library counts them, without added special tokens.

    One scan without a shuffle; rows are counted one by one, so repeated rows and
    rows without key give a row each. Null text counts as empty: 0 tokens. Strings of
    special tokens in a text count as one token each, the library's default. Very
    long texts and very long words are counted in bounded parts. An empty table gives
    no rows; other columns are ignored.

    Returns the key, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).
    """
    made: list[Tokenizer] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Tokenizer(tokenizer))
        counts = made[0].count(text_of(batch, "_text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["_key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = map_slices(
        df.select(F.struct(F.col(key).alias("k"), size.alias("n")).alias("_key"), F.col(text).alias("_text")), "_text",
        f"_key struct<k:{kind},n:bigint>, n_tokens long", step,
    )
    return rows.select(F.col("_key.k").alias(key), F.col("_key.n").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
