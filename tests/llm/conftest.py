import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("bel", "dan", "fur", "gim", "hol", "jar", "kes", "lum")]


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact copies, near copies of one text, shared passages, empty and very short ones."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = say(120).split(), say(60)
    texts = [say(rng.randrange(1, 150)) for _ in range(40)]
    for _ in range(40):  # near copies
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [say(20) + "\n" + passage + "\n" + say(20) for _ in range(6)] + [passage] * 3
    texts += ["", "   \n", "one", "one two", "One  TWO", "ÄÖ é ß " * 30, "😀 " * 60, "x" * 5000, "ab" * 400, None, None]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with two rows without id, one row twice, and columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in corpus]
    rows += [(None, corpus[3][1], None, None, None, None, None), (None, "only here " * 30, None, None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, node string")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
