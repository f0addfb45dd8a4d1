"""Numbering by ranges of keys, and the sparse document-feature matrix."""

import random

import pytest
from pyspark.sql import functions as F

from verbatim.operators import keyed, reshape as rs, topn
from verbatim.plans import catalog


def test_building_a_numbering_runs_no_job(spark, sf):
    context = spark.sparkContext
    for name in ("bar_order", "add_row_id", "topic_labels_frex", "scan_comments_sql", "dfm_dictionary"):
        query = catalog.queries()[name]
        query(spark, sf)  # the schema of the file is read by a job of its own
        frames = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("n"), F.col("id").cast("string").alias("w"))
        context.setJobGroup(f"build-{name}", "")
        keyed.ordinals(frames, ["n", "w"], by="g")
        keyed.rank_fraction(frames, "n", "g")
        topn.bar_order(frames, "w", "n", "g")
        assert not context.statusTracker().getJobIdsForGroup(f"build-{name}")
        context.setJobGroup("other", "")


@pytest.mark.parametrize("ranges", [1, 7, keyed.RANGES])
def test_numbers_are_dense_and_ordered(spark, monkeypatch, ranges):
    monkeypatch.setattr(keyed, "RANGES", ranges)
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), f"w{k:04d}") for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, w string").repartition(9)
    got = [tuple(r) for r in keyed.ordinals(df, ["n", "w"], by="g").collect()]
    first = lambda v: (v is not None, v or 0)
    want, count = [], {}
    for g, n, w in sorted(rows, key=lambda r: (str(r[0]), first(r[1]), r[2])):
        count[g] = count.get(g, 0) + 1
        want.append((g, n, w, count[g]))
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = {r.w: r.i for r in keyed.ordinals(df, ["w"], out="i").collect()}
    assert [ids[w] for w in sorted(ids)] == list(range(1, 3001))


def test_a_key_of_a_third_of_the_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("w"), F.col("id"))
    got = keyed.ordinals(df, ["w", "id"]).toPandas().sort_values(["w", "id"])
    assert got.ord.tolist() == list(range(1, 9001))
    share = keyed.rank_fraction(df.select(F.lit(1).alias("g"), (F.col("id") % 10).alias("v")), "v", "g").distinct().toPandas()
    assert sorted(share.fraction.round(6)) == [k / 10 for k in range(1, 11)]


def test_vectors_and_back(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["d1", "d2", "d3", None]), rng.choice([None, *"klmnopqrst"]), rng.randrange(1, 5)) for _ in range(200)]
    counts = spark.createDataFrame([*rows, ("none", None, 3)], "doc string, term string, n long")
    dictionary = rs.dfm_dictionary(counts, "term")
    ids = {r.term: r.id for r in dictionary.collect()}
    assert ids == {t: i for i, t in enumerate(sorted({t for _, t, _ in rows if t}))}
    want = {}
    for d, t, n in rows:
        if d and t:
            want[d, t] = want.get((d, t), 0) + n
    vectors = rs.dfm_vectors(counts, dictionary, "doc", "term")
    for r in vectors.collect():
        assert r.size == len(ids) and r.indices == sorted(r.indices)
        assert dict(zip(r.indices, r["values"], strict=True)) == {ids[t]: n for (d, t), n in want.items() if d == r.doc}
    assert {(r.doc, r.term): r.n for r in rs.dfm_cells(vectors, dictionary, "doc", "term").collect()} == want
    ones = rs.dfm_vectors(counts, dictionary, "doc", "term", binary=True).collect()
    assert all(set(r["values"]) == {1.0} for r in ones) and {r.doc for r in ones} == {"d1", "d2", "d3"}
    assert rs.dfm_dictionary(counts.limit(0), "term").count() == 0
