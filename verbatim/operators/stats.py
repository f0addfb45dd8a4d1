"""Response-length statistics: medians, bins, box plots, densities.

Word counts have a number of distinct values bounded by the longest text, not by
the number of responses: they are first counted per (group, value), and the second
step is small whatever the group size. Continuous values (``few_values=False``) are
selected by rank instead: a sketch brackets each wanted rank, rows below a bracket
are only counted, and rows inside, some in ten thousand, are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from verbatim.functions import numeric as num
from verbatim.operators.keyed import SALTS, attach, names


def steps(n: int) -> Column:
    """0, 1, ..., n - 1 as an array."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def value_counts(df: DataFrame, value: str, by: str | Sequence[str] | None = None, out: str = "_n") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*names(by), value).agg(F.count("*").alias(out))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: str | Sequence[str] | None = None,
              out: str = "quantiles") -> DataFrame:
    """Exact interpolated quantiles per group as an array column."""
    by = names(by)
    at = F.array(*[F.lit(float(p)) for p in probs])
    counted = value_counts(df, value, by)
    cell = F.percentile(value, at, F.col("_n")).alias(out)
    return counted.groupBy(*by).agg(cell) if by else counted.agg(cell)


def median(df: DataFrame, value: str, by: str | Sequence[str] | None = None, digits: int | None = None,
           out: str = "median") -> DataFrame:
    """Exact median, overall or per group, optionally rounded half to even."""
    q = quantiles(df, value, [0.5], by)
    m = q["quantiles"][0]
    return q.select(*names(by), (m if digits is None else num.round_half_even(m, digits)).alias(out))


def mean_median(df: DataFrame, value: str, by: str | Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Mean and median from one pass over the counted values."""
    by = names(by)
    counted = value_counts(df, value, by)
    mean = F.sum(F.col(value) * F.col("_n")) / F.sum("_n")
    mid = F.percentile(value, F.lit(0.5), F.col("_n"))
    if digits is not None:
        mean, mid = num.round_half_even(mean, digits), num.round_half_even(mid, digits)
    return counted.groupBy(*by).agg(mean.alias("mean"), mid.alias("median"))


def histogram_fixed(df: DataFrame, value: str, width: float = 5, by: str | Sequence[str] | None = None) -> DataFrame:
    """Counts per right-closed bin centred on multiples of ``width``."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*names(by), num.bin_centre(value, width).alias("bin")).agg(F.count("*").alias("n"))


def freq_polygon(df: DataFrame, value: str, by: str, bins: int = 30, density: bool = False, few_values: bool = True) -> DataFrame:
    """Counts per group in ``bins`` equal bins over the common range, empty bins included.

    With ``density`` also count / (group total * width). Few distinct values are
    counted first, and range and bins are read from those counts; with
    ``few_values=False`` (continuous values) the rows are read twice instead.
    """
    n = F.col("_n")
    if few_values:
        rows = value_counts(df, value, by)
        x = F.when(n > 0, F.col(value)).cast("double")  # reads the count, so that the counted shuffle is shared
    else:
        rows = df.where(F.col(value).isNotNull()).withColumn("_n", F.lit(1).cast("long"))
        x = F.col(value).cast("double")
    edges = rows.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"))).scalar()
    low = edges.getField("low")
    width = (edges.getField("high") - low) / F.lit(float(bins - 1))
    cells = rows.groupBy(by, num.bin_index(value, low, width).alias("bin")).agg(F.sum(n).alias("n"))
    # at most ``bins`` cells per group
    groups = cells.groupBy(by).agg(F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_cells"))
    filled = groups.select("*", F.explode(steps(bins)).alias("bin"))
    filled = filled.withColumn("n", F.coalesce(F.try_element_at("_cells", F.col("bin")), F.lit(0).cast("long")))
    filled = filled.withColumn("centre", low + F.col("bin") * width)
    if density:
        filled = filled.withColumn("density", F.col("n") / F.nullif(F.col("_total") * width, F.lit(0.0)))
    return filled.drop("_total", "_cells")


#: Ranks of the sketch are off by at most one in so many rows, and a bracket reaches three times as far.
SKETCH = 10_000


def _brackets(df: DataFrame, value: str, probs: Sequence[float], by: list[str], more: Sequence[Column] = ()) -> DataFrame:
    """Per group the number of values, and for each wanted rank two values that it lies between."""
    reach = 3.0 / SKETCH
    ends = [e for p in probs for e in (max(p - reach, 0.0), min(p + reach, 1.0))]
    x = F.col(value).cast("double")
    cells = [F.count("*").alias("_size"), F.percentile_approx(x, ends, SKETCH).alias("_ends"), F.min(x).alias("_min"), F.max(x).alias("_max"), *more]
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(*cells)


def selected_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: str | Sequence[str] | None = None, out: str = "quantiles",
                       more: Sequence[Column] = ()) -> DataFrame:
    """Exact interpolated quantiles per group of continuous values, by rank selection.

    ``df`` is read twice. No group is sorted as a whole or kept in one value: what is
    sorted are the distinct values inside the brackets. ``more`` are further aggregates
    of the group, as named columns.
    """
    by = names(by)
    if not by:
        return selected_quantiles(df.withColumn("_all", F.lit(0)), value, probs, "_all", out, more).drop("_all")
    framed = _brackets(df, value, probs, by, more)
    low = lambda k: F.when(F.lit(probs[k] <= 3.0 / SKETCH), F.col("_min")).otherwise(F.col("_ends")[2 * k])
    high = lambda k: F.when(F.lit(probs[k] >= 1 - 3.0 / SKETCH), F.col("_max")).otherwise(F.col("_ends")[2 * k + 1])
    bounds = framed.select(*by, F.array(*[F.struct(low(k).alias("low"), high(k).alias("high")) for k in range(len(probs))]).alias("_b"))
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    rows = attach(known, bounds, by, salts=SALTS)
    # A row outside a bracket is only counted, with the value nearest to the bracket: the wanted rank may be that one row away.
    def side(k: int) -> Column:
        place = F.when(F.col("_x") < F.col("_b")[k]["low"], -1).when(F.col("_x") > F.col("_b")[k]["high"], 1).otherwise(0)
        return F.struct(F.lit(k).alias("_k"), place.alias("_side"), F.when(place == 0, F.col("_x")).alias("_v"))

    held = rows.select(*by, "_x", F.inline(F.array(*[side(k) for k in range(len(probs))])))
    counted = held.groupBy(*by, "_k", "_side", "_v").agg(F.count("*").alias("_n"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy("_side", "_v"))
    placed = attach(counted.withColumn("_upto", upto), framed.select(*by, "_size"), by)
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_k") + 1) * (F.col("_size") - 1)
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
    nearest = F.when(F.col("_side") < 0, F.col("_last")).otherwise(F.col("_first"))
    ranked = placed.withColumn("_at", at).groupBy(*by, "_k").agg(
        F.max(F.when(holds(F.floor("_at")), nearest)).alias("_low"), F.max(F.when(holds(F.ceil("_at")), nearest)).alias("_high"),
        F.max(F.col("_at") - F.floor("_at")).alias("_part"),
    )
    value_at = F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))
    sorted_ = F.array_sort(F.collect_list(F.struct("_k", value_at.alias("_v"))))  # one for each wanted rank
    cell = F.transform(sorted_, lambda r: r["_v"]).alias(out)
    found = ranked.groupBy(*by).agg(cell)
    return attach(framed.drop("_ends"), found, by) if more else found


def _fenced(df: DataFrame, value: str, by: list[str], coef: float, few_values: bool) -> DataFrame:
    """Values with their counts next to their group's quartiles and fences."""
    probs = (0.25, 0.5, 0.75)
    if few_values:
        rows = value_counts(df, value, by)
        found = rows.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, probs)), F.col("_n")).alias("_q"))
    else:
        rows = df.where(F.col(value).isNotNull()).select(*by, value).withColumn("_n", F.lit(1).cast("long"))
        found = selected_quantiles(df, value, probs, by, "_q")
    quartiles = found.select(*by, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("middle"), F.col("_q")[2].alias("upper"))
    reach = coef * (F.col("upper") - F.col("lower"))
    inside = (F.col(value) >= F.col("lower") - reach) & (F.col(value) <= F.col("upper") + reach)
    return attach(rows, quartiles, by, salts=SALTS).withColumn("_inside", inside)


def boxplot_stats(df: DataFrame, value: str, by: str | Sequence[str], coef: float = 1.5, few_values: bool = True) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group."""
    by = names(by)
    x = F.col(value).cast("double")
    return _fenced(df, value, by, coef, few_values).groupBy(*by, "lower", "middle", "upper").agg(
        F.least("lower", F.min(F.when(F.col("_inside"), x))).alias("ymin"),
        F.greatest("upper", F.max(F.when(F.col("_inside"), x))).alias("ymax"),
        F.coalesce(F.sum(F.when(~F.col("_inside"), F.col("_n"))), F.lit(0).cast("long")).alias("outliers"),
    )


def boxplot_outliers(df: DataFrame, value: str, by: str | Sequence[str], coef: float = 1.5, few_values: bool = True) -> DataFrame:
    """Values beyond the whiskers with the number of responses at each."""
    by = names(by)
    beyond = _fenced(df, value, by, coef, few_values).where(~F.col("_inside"))
    if not few_values:
        beyond = beyond.groupBy(*by, value).agg(F.sum("_n").alias("_n"))
    return beyond.select(*by, value, F.col("_n").alias("n"))


def density_ridges(df: DataFrame, value: str, by: str | Sequence[str], points: int = 512, few_values: bool = True,
                   binned: bool | None = None) -> DataFrame:
    """Gaussian kernel density of each group on one common grid.

    The bandwidth is the mean over groups of 0.9 * min(sd, IQR / 1.34) * n^-0.2;
    the grid reaches three bandwidths beyond the data. Few distinct values add their
    count-weighted kernels one by one. With ``binned``, always so for continuous values,
    each value is split between the two grid points around it, by nearness, and kernels
    are summed over the grid: from at most ``points`` rows for each group.
    """
    by = names(by)
    binned = not few_values if binned is None else binned
    if few_values:
        counted = value_counts(df, value, by)
    else:
        counted = df.where(F.col(value).isNotNull()).select(*by, value).withColumn("_n", F.lit(1).cast("long"))
    x, n = F.col(value).cast("double"), F.col("_n")
    spread = lambda size, total, square: F.sqrt(F.greatest((square - total * total / size) / F.nullif(size - 1, F.lit(0)), F.lit(0.0)))
    if few_values:
        q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)), n)
        groups = counted.groupBy(*by).agg(
            F.sum(n).alias("_size"), spread(F.sum(n), F.sum(x * n), F.sum(x * x * n)).alias("_sd"), q.alias("_q"), F.min(x).alias("_min"), F.max(x).alias("_max")
        )
    else:
        groups = selected_quantiles(df, value, (0.25, 0.75), by, "_q", more=[F.stddev_samp(x).alias("_sd")])
    groups = groups.withColumn("_iqr", (F.col("_q")[1] - F.col("_q")[0]) / 1.34)
    zero = F.lit(0.0)
    scale = F.coalesce(
        F.nullif(F.least("_sd", "_iqr"), zero), F.nullif(F.col("_sd"), zero), F.nullif(F.abs("_min"), zero), F.lit(1.0)
    )
    width = F.when(F.col("_size") > 1, 0.9 * scale * F.pow(F.col("_size").cast("double"), F.lit(-0.2)))
    frame = groups.agg(F.struct(F.avg(width).alias("bw"), F.min("_min").alias("low"), F.max("_max").alias("high"))).scalar()
    bw = frame.getField("bw")
    start = frame.getField("low") - 3 * bw
    step = (frame.getField("high") + 3 * bw - start) / (points - 1)
    if not binned:
        at = counted.withColumn("point", F.explode(steps(points))).withColumn("_at", start + F.col("point") * step)
        z = (F.col("_at") - x) / bw
        return _scaled(at.groupBy(*by, "point", "_at").agg(F.sum(n * F.exp(-0.5 * z * z)).alias("_k")), groups, by, bw)
    split = counted.withColumn("_at", (x - start) / step).withColumn("_left", F.floor("_at"))
    part = F.col("_at") - F.col("_left")
    halves = F.array(F.struct(F.col("_left").alias("cell"), (n * (1 - part)).alias("w")), F.struct((F.col("_left") + 1).alias("cell"), (n * part).alias("w")))
    cells = split.select(*by, F.inline(halves)).groupBy(*by, "cell").agg(F.sum("w").alias("w"))
    # At most ``points`` cells per group.
    lists = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("_cells"))
    at = lists.withColumn("_step", step / bw).withColumn("point", F.explode(steps(points)))

    def kernel(total: Column, c: Column) -> Column:
        z = (F.col("point") - c["cell"]) * F.col("_step")
        return total + c["w"] * F.exp(-0.5 * z * z)

    kernels = at.select(*by, "point", (start + F.col("point") * step).alias("_at"), F.aggregate("_cells", F.lit(0.0), kernel).alias("_k"))
    return _scaled(kernels, groups, by, bw)


def _scaled(kernels: DataFrame, groups: DataFrame, by: list[str], bw: Column) -> DataFrame:
    """Densities from kernel sums; groups of fewer than three values have none."""
    out = attach(kernels, groups.select(*by, "_size"), by)
    density = F.col("_k") / (F.col("_size") * bw * math.sqrt(2 * math.pi))
    return out.where(F.col("_size") >= 3).select(*by, "point", F.col("_at").alias("x"), density.alias("density"))


def global_reference_lines(df: DataFrame, value: str) -> DataFrame:
    """One row: overall mean and median."""
    return mean_median(df, value)
