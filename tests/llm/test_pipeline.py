"""The pipeline stage by stage on a small table with planted cases."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import base_of, linked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    rows = [tuple(r) for r in docs.collect()]
    base = next(r for r in rows if r[1] and 1500 < len(r[1]) < 4000)
    words = base[1].split(" ")
    words[len(words) // 2] = "changedword"
    passage = " ".join(f"passage{rng.randrange(10**6)}" for _ in range(60))
    own = [" ".join(f"own{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2)]
    rows += [(90_001, " ".join(words), *base[2:]), (90_002, f"{own[0]} {passage}", "en", "p", None), (90_003, f"{own[1]} {passage} end", "en", "p", None)]
    rows += [(90_004, None, None, None, None), (90_005, "", "en", "p", 0), (90_006, "unlike all else, password=abcdef123456789 it says", "en", "p", None)]
    out = [spark.createDataFrame(rows, docs.schema)]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_return_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    counts = [s.count() for s in stages]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] == counts[4] > 0


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    want = {k for k, (_, c) in linked(before.items(), 5, 80, 100).items() if k == c}
    assert {r.doc_id for r in stages[2].collect()} == want and 90_001 not in want


def test_repeats_are_cut_and_secrets_go(stages):
    after = {r.doc_id: r.text for r in stages[3].collect()}
    texts = [t.encode() for t in after.values() if t]
    seen = Counter(w for t in texts for w in {t[k : k + 130] for k in range(len(t) - 129)})
    assert max(seen.values(), default=1) == 1  # a cut may join two kept parts, never a whole passage
    assert "passage" in after[90_002] and "passage" not in after[90_003] and after[90_003].startswith("own")
    assert after[90_004] is None and after[90_005] == ""
    clean = {r.doc_id: (r.text, r.n_chars) for r in stages[4].collect()}
    assert not any(base_of(t or "") for t, _ in clean.values())
    assert all(n == (None if t is None else len(t)) for t, n in clean.values())


def test_pieces_cover_what_was_kept(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_stages_take_an_empty_table_and_any_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["had_text", "doc", "hash", "_id", "_text", "_row", "_key", "node"]
    more = docs.where("doc_id < 40").select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0, name
        if name == "best-fit packing":
            continue
        assert none.columns == docs.columns
        kept = stage(spark, more, SF)
        assert kept.columns == more.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
