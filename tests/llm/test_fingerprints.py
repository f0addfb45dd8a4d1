"""Fingerprints and their likeness against a plain version."""

import random

import pytest

from verbatim.llm import ctph

M = (1 << 64) - 1
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def mixed(x):
    x &= M
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


BYTE = [mixed((b + 1) * 0xD1B54A32D192ED03) for b in range(256)]


def sign(chunk):
    total, power = 0, 1
    for b in chunk:
        total = (total + BYTE[b] * power) & M
        power = power * (0x9E3779B97F4A7C15 | 1) & M
    return SIGNS[mixed(total + len(chunk) * 0xA24BAED4963EE407) >> 58]


def plain(data):
    if not data:
        return "3::"
    rolling = [sum(data[i - k] * (8 - k + (1 << 5 * k)) for k in range(min(7, i + 1))) & 0xFFFFFFFF for i in range(len(data))]
    size = 3
    while size * 64 < len(data):
        size *= 2
    ends = lambda n: [i for i, r in enumerate(rolling) if r % n == n - 1]
    while size > 3 and len(ends(size)) + 1 < 32:
        size //= 2
    out = []
    for most, n in ((64, size), (32, 2 * size)):
        stops = [i + 1 for i in ends(size) if rolling[i] % n == n - 1][: most - 1]
        if not stops or stops[-1] < len(data):
            stops.append(len(data))
        out.append("".join(sign(data[a:b]) for a, b in zip([0, *stops], stops, strict=False)))
    return f"{size}:{out[0]}:{out[1]}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def alike(a, b):
    if not a or not b:
        return 0.0
    return max((1 - distance(a, b) / max(len(a), len(b)) - ctph.CHANCE) / (1 - ctph.CHANCE), 0.0)


def near(left, right):
    if left == right:
        return 1.0
    (n, a, c), (m, b, d) = (x.split(":") for x in (left, right))
    n, m = int(n), int(m)
    return max(alike(a, b), alike(c, d)) if n == m else alike(a, d) if n == 2 * m else alike(c, b) if m == 2 * n else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    say = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    made = ["", "a", "ab" * 300, "x" * 5000, "é" * 100, "word " * 700]
    made += [say(rng.randrange(1, 6000), "abcdefgh ijklmn\n") for _ in range(40)] + [say(2000, "ab") for _ in range(5)]
    base = say(3000, "abcdefgh ijklmn")
    return made + [base, base[:1500] + "changed" + base[1507:], base[200:], base + say(600, "xyz")]


def test_fingerprints_equal_a_plain_version(texts):
    data = [t.encode() for t in texts]
    assert ctph.fingerprints(data) == [plain(d) for d in data]
    # One by one and in another order as well: texts do not influence each other.
    assert [ctph.fingerprints([d])[0] for d in data[::-1]] == ctph.fingerprints(data)[::-1]


def test_likeness_equals_a_plain_version(spark, texts):
    marks = ctph.fingerprints([t.encode() for t in texts])
    pairs = [(a, b) for a in marks[::3] for b in marks[-12:]] + [(m, m) for m in marks] + [(marks[0], None)] + [(marks[4], marks[5])] * 2
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ctph.likeness("a", "b").alias("n")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r.n == pytest.approx(0.0 if r.b is None else near(r.a, r.b), abs=1e-12)


def test_few_boundaries_still_say_something(texts):
    """Without smaller blocks, texts of few boundaries would have one or two signs."""
    base, changed = (ctph.fingerprints([t.encode()])[0] for t in texts[-4:-2])
    assert len(base.split(":")[1]) >= 32 and near(base, changed) > 0.7


def test_repeated_rows(spark, texts):
    rows = [(1, texts[-1]), (1, texts[-1]), (2, texts[-2]), (None, texts[-1]), (None, None)]
    got = ctph.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.n_chars == len(texts[-1])}) == 1
