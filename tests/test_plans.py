"""Shape of the physical plans: what must not appear, and what must."""

import pytest

from verbatim.plans import base, catalog

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_no_cross_join_and_no_python(name, spark, sf):
    plan = plan_of(catalog.queries()[name](spark, sf))
    for node in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan


def test_scan_reads_needed_columns_only(spark, sf):
    plan = plan_of(catalog.queries()["word_counts"](spark, sf))
    assert "ReadSchema: struct<text:string>" in plan


def test_filter_reaches_scan(spark, sf):
    plan = plan_of(catalog.queries()["filter_in_list"](spark, sf))
    assert "PushedFilters: [In(lang, [en,fr])]" in plan
    assert "PushedFilters: [IsNotNull(doc_id), Not(EqualTo(doc_id,17))]" in plan_of(catalog.queries()["filter_row_id_not"](spark, sf))


def test_word_counts_combine_before_one_shuffle(spark, sf):
    plan = plan_of(base.tokens(spark, sf).groupBy("word").count())
    assert plan.count("hashpartitioning") == 1 and plan.index("partial_count") > plan.index("hashpartitioning")


def test_top_n_limits_groups_before_the_shuffle(spark, sf):
    plan = plan_of(catalog.queries()["top_n_by_group"](spark, sf))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["tf_idf", "top_n_by_group", "segment_polarity_bar", "freq_polygon", "boxplot_stats"])
def test_texts_are_read_once(name, spark, sf):
    """Branches share the shuffled counts, so the records read equal one pass over the documents."""
    sc = spark.sparkContext
    store, jvm = spark._jsparkSession.sparkContext().statusStore(), sc._jvm

    def stages():
        empty = jvm.java.util.ArrayList()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(empty, False, False, sc._gateway.new_array(jvm.double, 0), empty)
        return {found.apply(i).stageId(): found.apply(i).inputRecords() for i in range(found.size())}

    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    last = max(stages(), default=-1)
    catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    assert sum(n for i, n in stages().items() if i > last) == documents
