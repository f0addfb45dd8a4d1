"""Alignment of two tokenizers against a plain version that uses the libraries on whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from verbatim.llm import alignment
from verbatim.llm.packing import byte_signs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    byte, made, linked = byte_signs(), [], Counter()
    for text in texts:
        text = text or ""
        source = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != source or b"".join(b_bytes) != source:
            made.append((0, 0, [], []))
            continue
        ends = [[], []]
        for side, tokens in enumerate((a_bytes, b_bytes)):
            at = 0
            for t in tokens:
                at += len(t)
                ends[side].append(at)
        links = [(x, y) for x, p in zip(a, ends[0], strict=True) for y, q in zip(b, ends[1], strict=True) if p == q] if len(a) < 400 else [
            (x, dict(zip(ends[1], b, strict=True))[p]) for x, p in zip(a, ends[0], strict=True) if p in set(ends[1])
        ]
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        groups = [
            ",".join(str(i) for i, e in zip(a, ends[0], strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, ends[1], strict=True) if lo < e <= hi)
            for lo, hi in zip(cuts, cuts[1:], strict=False)
        ]
        linked.update(links)
        made.append((len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in linked.items():
        most[y] = max(most[y], n)
    return [
        (
            a, b, len(groups), len(links), sum(linked[p] == most[p[1]] for p in links), sum(linked[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for a, b, groups, links in made
    ]


@pytest.fixture(scope="module")
def texts(corpus):
    more = ["<|endoftext|> and </s> <s> <unk> <0x41>", "a▁b", "▁", " lead", "trail ", "  two  blanks\n\n\tand\r\n", "\x00\x01", "😀é中", "<0xE4>", "same"] + ["same"] * 40
    return [t if t is None or len(t) < 2000 else t[:2000] for _, t in corpus] + more


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("common_pairs, common_texts", [(alignment.COMMON_PAIRS, alignment.COMMON_TEXTS), (5, 2), (0, 0)])
def test_measures_equal_the_plain_version(spark, texts, monkeypatch, common_pairs, common_texts):
    monkeypatch.setattr(alignment, "COMMON_PAIRS", common_pairs)
    monkeypatch.setattr(alignment, "COMMON_TEXTS", common_texts)
    keyed = [(None if k % 9 == 8 else k // 2, t, "x", "y") for k, t in enumerate(texts)]
    df = spark.createDataFrame(keyed, "doc_id long, text string, digest string, _key string")
    want = sorted(((k, *m) for (k, *_), m in zip(keyed, plain(texts), strict=True)), key=str)
    assert rows(alignment.align(df, A, B)) == want
    assert alignment.align(df, A, B).columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_nothing_and_null_only(spark, nothing):
    assert alignment.align(nothing, A, B).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(alignment.align(df, A, B)) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_very_long_texts(spark):
    long = [" " * 2_000_000, "a" * 1_000_000, "some words é " * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = rows(alignment.align(df, A, B))
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    for k in (0, 2):
        assert got[k][2] == len(second.encode(long[k]))
    assert all(r[3] == r[4] > 0 and r[7] for r in got)
