"""Types inferred from text, and broken rows."""

import datetime as dt

from pyspark.sql import functions as F

from verbatim.sources import inference as inf

LINES = """id,share,day,at,flag,code,note,nothing
1,0.5,2020-02-29,2020-02-29 10:11:12,true,007,a b,
2,-3,2021-01-01,2021-01-01T00:00,F,1,"x, y",
3,1e3,1999-12-31,1999-12-31,t,02,,
""".splitlines()


def read(spark, tmp_path, lines, **how):
    (tmp_path / "rows.csv").write_text("\n".join(lines))
    return inf.scan_csv_inferred(spark, str(tmp_path), **how)


def test_types(spark, tmp_path):
    df = read(spark, tmp_path, LINES)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("id", "bigint"), ("share", "double"), ("day", "date"), ("at", "timestamp"), ("flag", "boolean"), ("code", "string"), ("note", "string"),
        ("nothing", "string"), ("_broken", "string"),
    ]
    rows = df.orderBy("id").collect()
    assert [r.share for r in rows] == [0.5, -3.0, 1000.0] and rows[0].day == dt.date(2020, 2, 29) and [r.flag for r in rows] == [True, False, True]
    assert [r.code for r in rows] == ["007", "1", "02"] and [r.note for r in rows] == ["a b", "x, y", None] and not any(r._broken for r in rows)


def test_one_odd_value_widens_or_is_kept_apart(spark, tmp_path):
    lines = ["id,n", *[f"{k},{k}" for k in range(30)], "30,many"]
    wide = read(spark, tmp_path, lines)
    assert dict(wide.dtypes) == {"id": "bigint", "n": "string", "_broken": "string"} and wide.where("_broken is not null").count() == 0
    kept, broken = inf.fitting(read(spark, tmp_path, lines, least_share=0.9))
    assert dict(kept.dtypes) == {"id": "bigint", "n": "bigint"} and kept.agg(F.sum("n")).first()[0] == sum(range(30))
    assert [tuple(r) for r in broken.collect()] == [(30, None, "n=many")]


def test_rows_with_other_numbers_of_fields(spark, tmp_path):
    kept, broken = inf.fitting(read(spark, tmp_path, ["a,b,c", "1,2,3", "4,5", "6,7,8,9", "10,11,12"]))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 2, 3), (10, 11, 12)]
    assert sorted(r._broken for r in broken.collect()) == ["4,5", "6,7,8,9"] and broken.where("a is not null").count() == 0


def test_impossible_values_are_no_dates(spark):
    df = spark.createDataFrame([("2021-06-31", "1" * 30, "0x1f"), ("2021-06-30", "2", "3")], "d string, n string, h string")
    assert inf.inferred_types(df, df.columns) == {"d": "string", "n": "double", "h": "string"}
    assert inf.inferred_types(df.limit(0), df.columns) == dict.fromkeys(df.columns, "string")
