"""Column types inferred from all rows, and rows that do not fit kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Types from narrow to wide; a value that fits one is also tried against the wider ones of its kind.
TYPES = ("boolean", "long", "double", "date", "timestamp")
#: Column with what is wrong in a row; null in rows that fit.
BROKEN = "_broken"

# How the text of each type looks. Numbers with leading zeros are names, not numbers.
LOOKS = {
    "boolean": "^(?i)(true|false|t|f)$",
    "long": "^[+-]?(0|[1-9][0-9]{0,17})$",
    "double": r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$",
    "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$",
}


def converted(text: Column, kind: str) -> Column:
    """The value of a text as a type; null if it does not look like one or is none, as the 31st of June."""
    if kind == "string":
        return text
    value = F.lower(F.substring(text, 1, 1)) == "t" if kind == "boolean" else text.try_cast("bigint" if kind == "long" else kind)
    return F.when(text.rlike(LOOKS[kind]), value)


def inferred_types(df: DataFrame, columns: list[str], least_share: float = 1.0) -> dict[str, str]:
    """Narrowest type of each text column that at least ``least_share`` of its values fit; a column without values is text.

    All rows are read, in one aggregate whose result is one row.
    """
    cells = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]
    cells += [F.count(converted(F.col(f"`{c}`"), t)).alias(f"{t}{i}") for i, c in enumerate(columns) for t in TYPES]
    row = df.agg(*cells).first()
    fits = lambda i, t: row[f"n{i}"] and row[f"{t}{i}"] >= least_share * row[f"n{i}"]
    return {c: next((t for t in TYPES if fits(i, t)), "string") for i, c in enumerate(columns)}


def typed(df: DataFrame, types: dict[str, str], broken: str = BROKEN) -> DataFrame:
    """Columns in their types; values that do not fit are null, and ``broken`` lists them as ``column=text``."""
    wrong = [
        F.when(F.col(f"`{c}`").isNotNull() & converted(F.col(f"`{c}`"), t).isNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`"))) for c, t in types.items() if t != "string"
    ]
    listed = F.nullif(F.concat_ws("; ", *wrong), F.lit("")) if wrong else F.lit(None).cast("string")
    kept = [F.col(c) for c in df.columns if c == broken]
    return df.select(*[converted(F.col(f"`{c}`"), t).alias(c) for c, t in types.items()], F.coalesce(*kept, listed).alias(broken))


def scan_csv_inferred(spark: SparkSession, path: str, least_share: float = 1.0, multi_line: bool = False) -> DataFrame:
    """Read CSV files with a header, with column types found in all of their rows.

    Reading finds the types, by one pass over the rows. With ``least_share`` below 1 a
    column may have a type that some values do not fit; those rows, and rows with too
    few or too many fields (these with their whole text), are marked in ``_broken``.
    """
    def read(schema: str | None) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        return (reader.schema(schema).option("columnNameOfCorruptRecord", BROKEN) if schema else reader).csv(path)

    names = read(None).columns
    if BROKEN in names:
        raise ValueError(f"a column is named {BROKEN}")
    rows = read(", ".join(f"`{c}` string" for c in [*names, BROKEN]))
    types = inferred_types(rows.where(F.col(BROKEN).isNull()), names, least_share)
    whole = [F.when(F.col(BROKEN).isNull(), F.col(f"`{c}`")).alias(c) for c in names]
    return typed(rows.select(*whole, BROKEN), types)


def fitting(df: DataFrame, broken: str = BROKEN) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, without the mark, and rows that do not."""
    return df.where(F.col(broken).isNull()).drop(broken), df.where(F.col(broken).isNotNull())
