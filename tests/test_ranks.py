"""Order statistics and densities of continuous values against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.operators import stats as st

PROBS = (0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 0.99999, 1.0)


def found(df):
    return {r[0]: r[1] for r in df.collect()}


def test_a_hot_group_of_distinct_values(spark):
    """A million distinct doubles in one group, with long tails; a few in others."""
    hot = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.exp(F.randn(7) * 5).alias("x"))
    rng = np.random.default_rng(1)
    rows = [("few", float(x)) for x in rng.normal(size=13)] + [("one", 2.5), ("ties", 1.0), ("ties", 1.0), ("ties", 1.0), ("two", -1.0), ("two", 4.0), ("none", None)]
    df = hot.union(spark.createDataFrame(rows, "g string, x double"))
    got = found(st.selected_quantiles(df, "x", PROBS, "g"))
    data = df.where("x is not null").toPandas().groupby("g").x.apply(np.array)
    assert set(got) == set(data.index)
    for g, x in data.items():
        assert np.allclose(got[g], np.quantile(x, PROBS), rtol=1e-12, atol=0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 100, 999, 1000])
def test_small_groups(spark, n):
    x = np.random.default_rng(n).permutation(np.repeat(np.arange(n), 1 + n % 3))[:n].astype(float) / 7
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert np.allclose(st.selected_quantiles(df, "x", PROBS).first()[0], np.quantile(x, PROBS), rtol=1e-12)


def test_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, float(v)) for v in range(10)] + [("a", 1.0)], "g string, x double")
    assert found(st.selected_quantiles(df, "x", (0.5,), "g")) == {None: [4.5], "a": [1.0]}
    assert st.selected_quantiles(df.limit(0), "x", (0.5,), "g").count() == 0


def test_both_ways_agree(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.floor(F.rand(3) * 40).cast("double").alias("x"))
    for fn in (st.boxplot_stats, st.boxplot_outliers, st.density_ridges):
        binned = {"binned": True} if fn is st.density_ridges else {}
        one, two = (fn(df, "x", "g", few_values=f, **binned).toPandas() for f in (True, False))
        keys = [c for c in ("g", "point") if c in one.columns] or list(one.columns)
        one, two = (d.sort_values(keys).reset_index(drop=True) for d in (one, two))
        assert len(one) == len(two) and np.allclose(one, two)


def test_density_is_near_the_exact_kernel_sum(spark):
    x = np.random.default_rng(2).normal(size=800)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    got = st.density_ridges(df, "x", "g", few_values=False).orderBy("point").toPandas()
    bw = 0.9 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * len(x) ** -0.2
    exact = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.abs(got.density - exact).max() < 1e-3 * exact.max()
    assert got.density.sum() * (got.x[1] - got.x[0]) == pytest.approx(1, abs=1e-2)


def test_no_group_becomes_one_value(spark):
    """Continuous values are never gathered in a map per group, and what the kernels are summed from is binned."""
    df = spark.range(100).select(F.lit(1).alias("g"), F.rand(1).alias("x"))
    for out in (st.boxplot_stats(df, "x", "g", few_values=False), st.density_ridges(df, "x", "g", few_values=False)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "percentile_approx" in plan.lower().replace("approx_percentile", "percentile_approx")
