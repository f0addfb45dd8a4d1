"""Key helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16
#: Rows whose keys cut a table into ranges for numbering; one less than a power of two.
RANGES = 255
#: Numbers of 64 bits that mark the hashes of repeated keys.
REPEAT_SLOTS = 1 << 18


def names(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def attach(left: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """Join ``left`` with ``lookup`` (one row per key), null keys matching each other.

    Spark broadcasts the lookup when it measures it as small; otherwise it
    shuffles both sides and splits a hot key's partition at run time. For
    lookups with few keys (one per group) ``salts`` spreads each key as well:
    rows go to ``salts`` join keys by a hash of their other columns, and each
    lookup row is repeated that often.
    """
    on = names(on)
    rest = [c for c in left.columns if c not in on]
    spread = salts > 1 and bool(rest)
    renamed = lookup.select(
        *[F.col(k).alias(f"_k_{k}") for k in on],
        *[c for c in lookup.columns if c not in on],
        *([F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt_r")] if spread else []),
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on])
    if spread:
        left = left.withColumn("_salt_l", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
        match = match & (F.col("_salt_l") == F.col("_salt_r"))
    return left.join(renamed, match, how).drop("_salt_l", "_salt_r", *[f"_k_{k}" for k in on])


def with_alone(df: DataFrame, by: str | Sequence[str], out: str = "alone") -> DataFrame:
    """Add whether a row is surely the only one of its key; nulls are equal.

    The keys are read and counted by themselves. The hashes of the repeated ones are
    bits of ``REPEAT_SLOTS`` numbers at most, whatever the size of the table, so these are
    broadcast and the rows stay where they are. A row whose hash is that of another,
    repeated key counts as not alone. Keys must hash as they compare, as all but floats do.
    """
    by = names(by)
    place = F.pmod(F.xxhash64(*by), F.lit(64 * REPEAT_SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    repeated = df.select(*by).groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1)
    marks = repeated.select(F.shiftright(place, 6).alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_mask"))
    joined = df.join(F.broadcast(marks), F.shiftright(place, 6) == F.col("_slot"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_mask").bitwiseAND(bit) == 0, F.lit(True))).drop("_slot", "_mask")


def group_sum_keep_rows(df: DataFrame, by: str | Sequence[str], value: str = "n") -> DataFrame:
    """Replace ``value`` by its sum over the group, keeping every row."""
    by = names(by)
    sums = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
    # reading the value itself lets both sides share the shuffle behind df
    return attach(df, sums, by).withColumn(value, F.coalesce(F.col("_sum"), F.col(value))).drop("_sum")


def add_row_id(df: DataFrame, key: str, out: str = "row_id") -> DataFrame:
    """Dense ids 1..N in the order of a unique ``key`` of any type that sorts; a null key comes first."""
    return ordinals(df, [key], out=out)


def _in_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_range``: the number of the range of keys that a row is in.

    Bounds are the keys of the ``RANGES`` rows of least hash, read once when the query
    runs. They depend on the rows alone, so a task that runs again finds the same.
    """
    key = F.struct(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)])
    sample = df.select(key.alias("_key"), F.xxhash64(*df.columns).alias("_hash")).orderBy("_hash", "_key").limit(RANGES)
    bounds = sample.agg(F.sort_array(F.collect_set("_key"))).scalar()
    # Binary search: how many bounds are not above the key. One stage, so the bounds are never part of a stored row.
    out = df.withColumns({"_key": key, "_bounds": bounds, "_range": F.lit(0)})
    step = (RANGES + 1) // 2
    while step:
        up = F.coalesce(F.get("_bounds", F.col("_range") + (step - 1)) <= F.col("_key"), F.lit(False))
        out = out.withColumn("_range", F.col("_range") + F.when(up, step).otherwise(0))
        step //= 2
    return out.drop("_key", "_bounds")


def _with_starts(df: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    """Add ``_start``, the total ``size`` of the group's rows in the ranges before, and ``_total`` of the group.

    There is one row per range and group in it, at most ``RANGES + 1`` more than groups;
    the rows themselves are not shuffled for it.
    """
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_range", *by).agg(size.alias("_c"))
    starts = sizes.select("_range", *by, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(group).alias("_total"))
    return attach(df, starts, ["_range", *by])


def ordinals(df: DataFrame, order: Sequence[str], by: str | Sequence[str] | None = None, out: str = "ord") -> DataFrame:
    """Row number 1..N in ascending ``order``, nulls first, restarting per ``by`` group.

    A row's number is its place in its range of keys plus the group's rows in the
    ranges before, so no group is one task. Rows equal in all of these keys share a range.
    """
    by = names(by)
    ranged = _in_ranges(df, [*by, *order])
    place = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    placed = _with_starts(ranged, by, F.count("*"))
    return placed.withColumn(out, (F.col("_start") + place).cast("long")).select(*df.columns, out)


def rank_levels(df: DataFrame, value: str, by: str, out: str = "fraction") -> DataFrame:
    """(by, value, out) for each distinct value: the share of the group's rows whose value is not above it.

    The distinct values are cut into ranges; running counts are formed inside a
    range and shifted by the rows of the ranges before it.
    """
    levels = df.groupBy(by, value).agg(F.count("*").alias("_rows"))
    local = F.sum("_rows").over(Window.partitionBy("_range", by).orderBy(value))
    placed = _with_starts(_in_ranges(levels, [by, value]), [by], F.sum("_rows"))
    return placed.select(by, value, ((F.col("_start") + local) / F.col("_total")).alias(out))


def rank_fraction(df: DataFrame, value: str, by: str, out: str = "fraction") -> DataFrame:
    """Share of the group's rows whose value is not above the row's own, without a window per group."""
    return attach(df, rank_levels(df, value, by, out), [by, value])
