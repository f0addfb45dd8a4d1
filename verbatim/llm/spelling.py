"""Spelling variants: words that differ by one letter, found by a frontier that walks a trie as joins.

The trie of all words is a table of edges: the letters read so far name a node, and an
edge has a letter, which letters may follow it, and the count of the word that ends
there. A state is a word, a position in it, a node and the number of edits so far.
Level by level, the states at nodes of that depth are joined with the edges from
there: without an edit, a state takes an edge with another letter, put in front of its
own or in its place; with one, only the edge of its own letter. A state that ends with
its word at the end of another has found a neighbour.

One letter more or another letter is enough, as a letter less is the same pair seen
from the other side. Near the root nodes have many edges and kill few states, so the
first half of each word is walked without an edit; edits there are found by the same
walk over words read backwards.

Words longer than the trie is deep are compared by hashes of what is before and after
each letter, and then letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verbatim.llm.common import Spans, discard, saved, slices, text_of
from verbatim.llm.graph import roots

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Depth of the trie.
DEPTH = 40
#: Letters per set of following letters; there are 90 letters, so two sets.
_SET = 45


def counted_words(df: DataFrame, least_length: int, least_count: int, every: int, key: str, text: str) -> DataFrame:
    """Words of all texts with their counts.

    A word is a run of letters, A to Z in lower case; where ``every`` divides the
    checksum of key and run, the letter at checksum modulo length is left out.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit("[a-zÀ-ÿ]{%d,}" % least_length), F.lit(0))
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("_key", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _letter(at: Column) -> Column:
    """Number of a letter, from 0 to 89."""
    code = F.ascii(at)
    return F.when(code < 128, code - 97).otherwise(code - 192 + 26)


def _sets(letter: Column) -> tuple[Column, Column]:
    """The set of one letter in two parts."""
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, k.cast("int"))
    nothing = F.lit(0).cast("long")
    return F.when(letter < _SET, bit(letter)).otherwise(nothing), F.when(letter >= _SET, bit(letter - _SET)).otherwise(nothing)


def _edges(ways: DataFrame, least: int) -> DataFrame:
    """Edges from nodes of depth ``least`` on: way, node, level, letter, count of the word that ends there, and the letters that follow.

    Words are sorted first, so that edges that they share combine before the shuffle.
    """
    word, k = F.col("word"), F.col("level")
    steps = ways.repartitionByRange("way", "word").select("way", "word", "n", F.explode(F.sequence(F.lit(least), F.length(word) - 1)).alias("level"))
    low, high = _sets(_letter(F.substring(word, k + 2, F.lit(1))))
    more = F.length(word) > k + 1
    return (
        steps.select(
            "way", "level", F.substring(word, F.lit(1), k).alias("node"), F.substring(word, k + 1, F.lit(1)).alias("letter"),
            F.when(~more, F.col("n")).alias("ends"), F.when(more, low).otherwise(F.lit(0).cast("long")).alias("low"),
            F.when(more, high).otherwise(F.lit(0).cast("long")).alias("high"),
        )
        .groupBy("way", "level", "node", "letter")
        .agg(F.max("ends").alias("ends"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    )


def _near_short(words: DataFrame) -> DataFrame:
    """Pairs of words of at most ``DEPTH`` letters: a, n_a, b, n_b, each once, b not shorter than a."""
    if words.isEmpty():
        return words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    half = F.floor(F.length("word") / 2).cast("int")
    # Edits at a word's place ``half`` or later are found forward, the others backward.
    forward = words.select(F.lit(0).alias("way"), "word", "n", half.alias("from"))
    backward = words.select(F.lit(1).alias("way"), F.reverse("word").alias("word"), "n", (F.length("word") - half).cast("int").alias("from"))
    ways = saved(forward.union(backward), "spelling-ways")
    bounds = ways.agg(F.min("from"), F.max(F.length("word"))).first()
    edges = saved(_edges(ways, bounds[0]), "spelling-edges", by="level")
    letter = lambda at: F.substring("word", at + 1, F.lit(1))
    found: list[DataFrame] = []
    for level in range(bounds[0], bounds[1] + 1):
        k = F.lit(level)
        states = ways.where((F.col("from") <= k) & (F.length("word") >= k)).select(
            "way", "word", "n", k.alias("position"), F.substring("word", F.lit(1), k).alias("node"), F.lit(0).alias("edits")
        )
        if found:
            states = states.union(found[-1].where(F.col("position") < F.length("word")).select("way", "word", "n", "position", "node", F.lit(1).alias("edits")))
        at = F.col("position")
        own, other = letter(at), F.col("letter")
        fits = F.when(F.col("edits") == 1, other == own).otherwise(other != own)
        met = states.join(edges.where(F.col("level") == level).drop("level"), ["way", "node"]).where(fits)
        # With an edit: past the letter. Without: before it (one put in front), and past it (another in its place, of each pair once).
        to = F.when(F.col("edits") == 1, F.array(at + 1)).when((at < F.length("word")) & (other > own), F.array(at, at + 1)).otherwise(F.array(at))
        moved = met.select("way", "word", "n", F.explode(to).alias("position"), F.concat("node", "letter").alias("node"), "ends", "low", "high")
        low, high = _sets(_letter(letter(at)))
        goes_on = (F.col("low").bitwiseAND(low) != 0) | (F.col("high").bitwiseAND(high) != 0)
        moved = moved.where(F.when(at == F.length("word"), F.col("ends").isNotNull()).otherwise(goes_on))
        found.append(saved(moved.select("way", "word", "n", "position", "node", F.when(at == F.length("word"), F.col("ends")).alias("ends")), "spelling-frontier"))
    done = found[0]
    for more in found[1:]:
        done = done.union(more)
    spelled = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = done.where(F.col("ends").isNotNull()).select("way", spelled("word").alias("a"), F.col("n").alias("n_a"), spelled("node").alias("b"), F.col("ends").alias("n_b"))
    # A letter put into a run of it is found both ways; forward is enough.
    same = F.substring("a", F.lit(1), F.floor(F.length("a") / 2).cast("int")) == F.substring("b", F.lit(1), F.floor(F.length("a") / 2).cast("int"))
    out = saved(pairs.where((F.col("way") == 0) | ~same).drop("way"), "spelling-pairs")
    discard(ways, edges, *found)
    return out


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each place of a word, hashes of what is before it and after it.

    Kind 0: the letter there is left out, of a run of one letter the first only;
    kind 1: likewise, all letters; kind 2: no letter is left out.
    """
    for batch in slices(batches, "word"):
        for number, word in zip(batch.column(0).to_pylist(), text_of(batch, "word").to_pylist(), strict=True):
            data = np.frombuffer(word.encode("latin-1"), np.uint8)
            n, spans = len(data), Spans(data)
            place = np.arange(n + 1)
            before, after = spans.hash(np.zeros(n + 1, np.int64), place), spans.hash(place, np.full(n + 1, n))
            first = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
            for kind, x, y in ((0, before[first], after[first + 1]), (1, before[:-1], after[1:]), (2, before, after)):
                for a in range(0, len(x), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    size = len(x[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, number)), pa.array(np.full(size, kind, np.int32)), pa.array(x[part].view(np.int64)), pa.array(y[part].view(np.int64))],
                        ["id", "kind", "x", "y"],
                    )


def _near_long(words: DataFrame) -> DataFrame:
    """Pairs of which the longer word has more than ``DEPTH`` letters, as ``_near_short`` gives them.

    Words that differ in one place only are at most as many as letters, so no group of
    equal hashes is large.
    """
    long = saved(words.where(F.length("word") >= DEPTH).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "long-words")
    places = saved(long.select("id", "word").mapInArrow(_around, "id long, kind int, x long, y long"), "long-places")
    of = lambda kind, name: places.where(F.col("kind") == kind).select("x", "y", F.col("id").alias(name))
    pairs = of(2, "i").join(of(0, "j"), ["x", "y"]).union(of(1, "i").join(of(1, "j"), ["x", "y"]).where(F.col("i") < F.col("j"))).select("i", "j").distinct()
    side = lambda name: long.select(F.col("id").alias(f"_{name}"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    both = pairs.join(side("a"), F.col("i") == F.col("_a")).join(side("b"), F.col("j") == F.col("_b")).where(F.length("b") > DEPTH)
    return both.select("a", "n_a", "b", "n_b")


def neighbours(words: DataFrame) -> DataFrame:
    """All pairs of words that differ by one letter put in, left out or replaced; ``words`` has distinct words and counts.

    Returns word, n, near and n_near, each pair from both sides.
    """
    pairs = _near_short(words.where(F.length("word") <= DEPTH)).union(_near_long(words))
    return pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).union(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("n_near"))
    )


def variants(
    df: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, every: int = 31, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Words of a table, each with the much commoner word that it is a variant of.

    Words are runs of the letters A to Z (in lower case) and U+00C0 to U+00FF with at
    least ``least_length`` letters, that occur ``least_count`` times or more; see
    ``counted_words`` for the letters left out. Two words are near if they differ by
    one letter put in, left out or replaced. The form of a word is its near word with
    the highest count (of equal ones the first in code point order), if that is
    ``factor`` times the word's own or more; the root is where the forms lead.

    Null and empty texts have no words. A null key counts as an empty one. Each row
    counts, repeated ones too. Very long runs are words like all others. An empty table gives
    no rows; other columns are ignored.

    Returns word, form, root, n, n_near (number of near words) and form_n.
    """
    words = saved(counted_words(df, least_length, least_count, every, key, text), "spelling-words")
    best = F.min(F.struct((-F.col("n_near")).alias("k"), "near"))
    around = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    most = -F.col("_best.k")
    formed = words.join(around, "word", "left").withColumn("form_n", F.when(most >= factor * F.col("n"), most))
    formed = saved(
        formed.select("word", F.when(F.col("form_n").isNotNull(), F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"),
        "spelling-forms",
    )
    # Counts rise by the factor at each step, so the forest is shallow.
    root = roots(formed.where(F.col("form").isNotNull()).select(F.col("word").alias("a"), F.col("form").alias("b")))
    return formed.join(root.withColumnRenamed("node", "word"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
