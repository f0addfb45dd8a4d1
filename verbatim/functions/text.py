"""Text expressions: tokens, n-grams, sentences, cleaning and label rules.

Everything here is a ``Column -> Column`` function built from Spark's own
expressions, so it runs inside the scan stage and never needs a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# The token, sentence and pause definitions shared with the SQL checks.
WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
# The same words, but possessive: no piece is ever given back, so a long chain of pieces takes no stack.
TOKEN_POSSESSIVE = r"[\p{L}\p{M}\p{N}_]++(?:['’.][\p{L}\p{M}\p{N}_]++)*+"
SENTENCE = r"[^.!?]+[.!?]*"
CLAUSE = r"[^,;:]+"
# Pieces of a text that may have a period, and what stands between them: runs of pieces without one and of blanks. Possessive, so it takes no stack.
DOTTED = r"(?:[^ .\t\n\f\r]*+[ \t\n\f\r]++)++|[^ \t\n\f\r]++"
# A piece that is a word, which may have periods inside and one at its end.
WORD_PIECE = r"^[\"'(\[]*([\p{L}]+(?:\.[\p{L}]+)*)(\.?)[,;:!?)\"'\]]*$"
#: Slots by hash that a table of words is kept in for lookups.
WORD_SLOTS = 4096
#: What may follow the period in ``WORD_PIECE``; its end also stands before a last line separator.
MARKS_AFTER = ",;:!?)\"']\u0085\u2028\u2029"
#: Stands for a period that is no sentence bound while a text is cut (a private character).
HIDDEN = "\ue000"
PATH_BREAK = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# --- tokens -----------------------------------------------------------------

def word_array(text: Column | str) -> Column:
    """Lower-cased words in text order; null text gives null, no word gives an empty array."""
    return _extract_all(F.lower(_col(text)), TOKEN_POSSESSIVE)


def without_words(words: Column | str, drop: Iterable[str]) -> Column:
    """Words of the array that are not in the literal ``drop`` list."""
    drop = sorted(set(drop))
    return F.filter(_col(words), lambda w: ~w.isin(drop)) if drop else _col(words)


def run_starts(words: Column | str) -> Column:
    """Where the runs of equal words begin, from 0; in a sorted array there is one run for each distinct word."""
    starts = lambda s: F.transform(s, lambda w, i: F.when((i == 0) | ~w.eqNullSafe(F.get(s, i - 1)), i))
    # Bound to a variable, so that the array is made once and not for each of its words.
    return F.filter(F.transform(F.array(_col(words)), starts)[0], lambda i: i.isNotNull())


def ngram_array(words: Column | str, n: int) -> Column:
    """Adjacent ``n``-grams; fewer than ``n`` words (or null) give one null n-gram."""
    words = _col(words)
    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]),
    )
    return F.when(F.size(words) >= n, grams).otherwise(F.array(F.lit(None).cast("string")))


def only_lettered(words: Column | str, drop: Iterable[str]) -> Column:
    """The words with those that hold no letter a-z, or are in the literal ``drop`` list, set to null."""
    drop = sorted(set(drop))
    return F.transform(_col(words), lambda w: F.when((w.rlike("[a-z]") & ~w.isin(drop)) if drop else w.rlike("[a-z]"), w))


def adjacent(words: Column | str, n: int) -> Column:
    """(w1, ..., wn) for each ``n`` adjacent words, made by zipping the array with its own rest; nulls past the end."""
    words = _col(words)
    rests = [words, *[F.slice(words, F.lit(k + 1), F.size(words)) for k in range(1, n)]]
    return F.arrays_zip(*rests).cast(f"array<struct<{', '.join(f'w{k}: string' for k in range(1, n + 1))}>>")


def sentence_array(text: Column | str) -> Column:
    """Trimmed non-blank sentences in text order, case kept."""
    pieces = F.transform(_extract_all(_col(text), SENTENCE), strip_blanks)
    return F.filter(pieces, lambda s: s != "")


def bounded_sentences(text: Column | str, abbreviations: Column | Iterable[str]) -> Column:
    """Sentences of which no bound is a period between digits or one that belongs to an abbreviation, case kept.

    ``abbreviations`` are lower-case words without their last period: a list, or a
    column with ``WORD_SLOTS`` arrays of them by ``slot_of``, so that a lookup compares
    few. Such periods are hidden while the text is cut. Only pieces with a period are looked up.
    """
    listed = None if isinstance(abbreviations, Column) else sorted(set(abbreviations))
    known = lambda w: F.array_contains(F.get(abbreviations, slot_of(w)), w) if listed is None else w.isin(listed)
    hidden = lambda p: F.transform(F.array(abbreviation_core(p)), lambda w: F.when(known(w), F.replace(p, F.lit("."), F.lit(HIDDEN))).otherwise(p))[0]
    decimal = _col(text)
    for _ in range(2):  # the second time for digits that the first one has used, as in 1.2.3
        decimal = F.regexp_replace(decimal, r"([0-9])\.([0-9])", f"$1{HIDDEN}$2")
    if listed is None or listed:
        pieces = F.transform(_extract_all(decimal, DOTTED), lambda p: F.when(F.contains(p, F.lit(".")), hidden(p)).otherwise(p))
        decimal = F.array_join(pieces, "")
    return F.transform(sentence_array(decimal), lambda s: F.replace(s, F.lit(HIDDEN), F.lit(".")))


def slot_of(word: Column | str) -> Column:
    """Which of ``WORD_SLOTS`` slots a word is in."""
    return F.pmod(F.xxhash64(_col(word)), F.lit(WORD_SLOTS)).cast("int")


def abbreviation_core(piece: Column) -> Column:
    """The word of a piece between blanks, in lower case and without its last period; empty if the piece is no word."""
    return F.lower(F.regexp_extract(piece, WORD_PIECE, 1))


def clause_array(sentence: Column | str) -> Column:
    """Pieces of a sentence between ``,`` ``;`` ``:``."""
    return _extract_all(_col(sentence), CLAUSE)


# --- measures ---------------------------------------------------------------

def word_count(text: Column | str) -> Column:
    """Number of word-character runs (an apostrophe splits a word here)."""
    return F.regexp_count(_col(text), F.lit(WORD)).cast("long")


def char_length(text: Column | str) -> Column:
    return F.char_length(_col(text)).cast("long")


def squeezed_char_length(text: Column | str) -> Column:
    """Length after turning every run of white space into one blank."""
    return char_length(squeeze_blanks(text))


# --- cleaning ---------------------------------------------------------------

def squeeze_blanks(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[ \t\n\f\r]+", " ")


def strip_blanks(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(" \t\n\f\r"))


def strip_reply_prefix(text: Column | str) -> Column:
    """On the first line that has a colon, drop what stands before its last colon.

    Made of searches for single characters, so the cost grows with the length of
    the text; a text without colon stays as it is.
    """
    text = _col(text)
    lines = F.translate(text, "\r\u0085\u2028\u2029", "\n\n\n\n")
    before = F.substring_index(lines, ":", 1)
    line_start = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    from_colon = F.substring_index(F.substring(lines, F.length(before) + 1, F.length(text)), "\n", 1)
    last_colon = F.length(before) + F.length(from_colon) - F.length(F.substring_index(from_colon, ":", -1))
    cut = F.concat(F.substring(text, F.lit(1), line_start), F.substring(text, last_colon, F.length(text)))
    return F.when(F.contains(text, F.lit(":")), cut).otherwise(text)


def clean_corpus(text: Column | str, stop_words: Iterable[str]) -> Column:
    """Punctuation out, blanks squeezed, digits out, lower case, stop words out."""
    bare = F.regexp_replace(_col(text), r"[!-/:-@\[-`{-~]+", "")
    lowered = F.lower(F.regexp_replace(squeeze_blanks(bare), "[0-9]+", ""))
    kept = F.filter(F.split(lowered, " +"), lambda w: w != "")
    return F.array_join(without_words(kept, stop_words), " ")


# --- labels -----------------------------------------------------------------

def relabel(value: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply ``(pattern, replacement)`` rules in turn, each to every match."""
    out = _col(value)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def base_name(value: Column | str, names: Iterable[str], suffixes: Iterable[str]) -> Column:
    """Turn ``<name>_<suffix>`` into ``<name>`` for the listed names and suffixes."""
    heads = "|".join(re.escape(n) for n in names)
    tails = "|".join(re.escape(s) for s in suffixes)
    return F.regexp_replace(_col(value), f"({heads})_(?:{tails})", "$1")


def split_path(path: Column | str) -> tuple[Column, Column]:
    """First two pieces between runs of non-alphanumerics; a missing piece is null."""
    pieces = F.split(_col(path), PATH_BREAK)
    return F.get(pieces, 0), F.get(pieces, 1)


def facet_label(term: Column | str, facet: Column | str) -> Column:
    return F.concat_ws("__", _col(term), _col(facet))


def strip_facet(label: Column | str) -> Column:
    return F.regexp_replace(_col(label), "__.+$", "")
