"""Token counts by compiled transducers against the tokenizer's own library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verbatim.llm import transducers

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def odd_texts():
    rng = random.Random(5)
    say = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    texts = ["", " ", "it's they're 'save we'll 'vx 'r 'l '' !'s", "a" * 1000, "ab" * 700, "İstanbul ΣΑΣ é ́x y z", "<|endoftext|>a<|startoftext|>b"]
    texts += ["<|ENDOFTEXT|>", "😂" * 300, "中文字符" * 50, "１２３ ²³ ⅷ", "'" * 500 + "s", "\x00\x1c\x85 q", "ſ K Å"]
    texts += [say("abcdefghijklmnopqrstuvwxyz'''  ..!!0189éßäÖΣσ😂中́\n\t", 400) for _ in range(300)] + [say("'strevmld !", 60) for _ in range(500)]
    return texts + [say("abcdehiort", 3000) for _ in range(5)] + [say("😀😂🇺🇸", 900) for _ in range(5)]


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, documents, nothing, library):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = sorted((k or -1, len((t or "").encode()), n, n > 40) for (k, t), n in zip(rows, counted(library, [t or "" for _, t in rows]), strict=True))
    got = transducers.token_counts(documents, FILE, 40)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert transducers.token_counts(nothing, FILE).count() == 0
    own = spark.createDataFrame([("a", None, 1), ("a", "one two", 2)], "k string, n string, _text int")
    assert [tuple(r) for r in transducers.token_counts(own, FILE, 2, "k", "n").collect()] == [("a", 0, 0, False), ("a", 7, 2, False)]


def test_odd_texts(library):
    texts = odd_texts()
    assert transducers.Tokenizer(FILE).count(texts).tolist() == counted(library, texts)


def test_bounds_change_nothing(library, monkeypatch):
    texts = odd_texts()
    for name, value in (("STREAM", 700), ("CHUNK", 3), ("PIECE_CHUNK", 5), ("BLOCK_BYTES", 64), ("MOST_STATES", 50)):
        monkeypatch.setattr(transducers, name, value)
    assert transducers.Tokenizer(FILE).count(texts).tolist() == counted(library, texts)


def test_very_long_texts(library):
    texts = ["a" * 2_000_000, " " * 2_000_000, "\n" * 2_000_000, "'s" * 500_000, "some words é " * 100_000]
    got = transducers.Tokenizer(FILE).count(texts)
    # The library itself is quadratic in the first one's length: runs of one letter are counted by length there.
    one = transducers.Tokenizer(FILE).count(["a" * n for n in (2000, 4000)])
    assert got[0] == one[0] + (one[1] - one[0]) * 999 and got[1:].tolist() == counted(library, texts[1:])


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    want, now = [], np.arange(8)
    for row in maps:
        now = row[now]
        want.append(now)
    assert (transducers.prefix_scan(maps) == np.array(want)).all()


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="only tokenizers"):
        transducers.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
