"""Queries for check-box answers, pivots and response-length statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatim.functions import text as tx
from verbatim.operators import counts as ct, reshape as rs, sentiment as sn, stats as st
from verbatim.plans.base import ENGLISH, boxes, polarity, query, rounded, scores, surveys, table, tokens
from verbatim.plans.cleaning import _CLEAN

# --- reshape ----------------------------------------------------------------

_SINGLE = """(SELECT doc_id, 'useful' AS category, 0 AS ord FROM marks WHERE useful
    UNION ALL SELECT doc_id, 'harmful', 1 FROM marks WHERE harmful)"""
_MULTI = """(SELECT doc_id, k.reason, k.ord FROM marks, LATERAL (VALUES ('english', 0, lang = 'en'), ('useful', 1, useful),
    ('harmful', 2, harmful), ('romance', 3, lang IN ('fr', 'es'))) AS k(reason, ord, ticked) WHERE k.ticked)"""


def _many_boxes(spark, sf):
    marks = boxes(spark, sf)
    return marks.select(
        "doc_id", (F.col("lang") == "en").alias("english"), "useful", "harmful", F.col("lang").isin("fr", "es").alias("romance")
    )


_MANY = ["english", "useful", "harmful", "romance"]


@query("unpivot_single_choice", f"SELECT doc_id, category, ord::BIGINT AS ord FROM {_SINGLE}")
def unpivot_single_choice(spark, sf):
    return rs.unpivot_choices(boxes(spark, sf), ["doc_id"], ["useful", "harmful"])


@query("unpivot_multi_choice", f"SELECT doc_id, reason, ord::BIGINT AS ord FROM {_MULTI}")
def unpivot_multi_choice(spark, sf):
    return rs.unpivot_choices(_many_boxes(spark, sf), ["doc_id"], _MANY, out="reason")


@query("visit_reasons_concat", f"SELECT doc_id, string_agg(reason, ',' ORDER BY ord) AS reasons FROM {_MULTI} GROUP BY doc_id")
def visit_reasons_concat(spark, sf):
    return rs.concat_choices(_many_boxes(spark, sf), ["doc_id"], _MANY)


@query("visit_reasons_concat_long", f"SELECT doc_id, string_agg(reason, ',' ORDER BY ord) AS reasons FROM {_MULTI} GROUP BY doc_id")
def visit_reasons_concat_long(spark, sf):
    return rs.concat_long_choices(unpivot_multi_choice(spark, sf), ["doc_id"], "reason", "ord")


@query(
    "full_join_multi_select",
    f"""SELECT doc_id, a.category, b.reasons FROM {_SINGLE} a FULL JOIN (
    SELECT doc_id, string_agg(reason, ',' ORDER BY ord) AS reasons FROM {_MULTI} GROUP BY doc_id) b USING (doc_id)""",
)
def full_join_multi_select(spark, sf):
    single = unpivot_single_choice(spark, sf).drop("ord")
    return rs.full_join_blocks(single, visit_reasons_concat(spark, sf), ["doc_id"])


@query("pivot_sentiment", "SELECT segment, positive, negative FROM segpol")
def pivot_sentiment(spark, sf):
    counts = sn.polarity_word_counts(tokens(spark, sf, "segment", "device"), polarity(spark), "segment", "device")
    return rs.pivot_counts(counts, "segment", "sentiment", ["positive", "negative"], n=None)


@query(
    "pivot_sentiment_fill",
    """SELECT word, sum(CASE WHEN sentiment = 'positive' THEN n ELSE 0 END)::BIGINT AS positive,
    sum(CASE WHEN sentiment = 'negative' THEN n ELSE 0 END)::BIGINT AS negative FROM polar GROUP BY word""",
)
def pivot_sentiment_fill(spark, sf):
    counts = sn.polarity_word_counts(tokens(spark, sf), polarity(spark))
    return rs.pivot_counts(counts, "word", "sentiment", ["positive", "negative"], fill=0)


_TERMS = f"(SELECT role, unnest(string_split({_CLEAN}, ' ')) AS term FROM conversations WHERE role IN ('user', 'assistant'))"


@query(
    "term_document_table",
    f"""SELECT term, count_if(role = 'user') AS user, count_if(role = 'assistant') AS assistant FROM {_TERMS}
    WHERE length(term) >= 3 GROUP BY term""",
)
def term_document_table(spark, sf):
    turns = table(spark, sf, "conversations", "role", "text").where(F.col("role").isin("user", "assistant"))
    clean = turns.select("role", tx.clean_corpus("text", ENGLISH).alias("clean"))
    long = rs.term_document_table(clean, "role", "clean")
    return rs.pivot_counts(long, "term", "role", ["user", "assistant"], fill=0)


@query("cast_dfm", "SELECT source, word, count(*) AS n FROM nostop GROUP BY ALL")
def cast_dfm(spark, sf):
    counts = ct.count_by(tokens(spark, sf, "source", "lang"), "source", "lang", "word")
    return rs.cast_dfm(counts, "source", "word")


@query("cast_dfm_binary", "SELECT DISTINCT lang, word, 1::BIGINT AS n FROM nostop")
def cast_dfm_binary(spark, sf):
    counts = ct.count_by(tokens(spark, sf, "lang"), "lang", "word")
    return rs.cast_dfm(counts, "lang", "word", binary=True)


_DICTIONARY = ", dictionary AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM nostop))"


@query("dfm_dictionary", _DICTIONARY + " SELECT word, id FROM dictionary")
def dfm_dictionary(spark, sf):
    """Dense term ids."""
    return rs.dfm_dictionary(ct.count_by(tokens(spark, sf, "source"), "source", "word"), "word")


@query(
    "dfm_vectors",
    _DICTIONARY + """, cells AS (SELECT source, id, count(*) AS n FROM nostop JOIN dictionary USING (word) GROUP BY ALL)
    SELECT source, (SELECT count(*) FROM dictionary) AS size, string_agg(id, ' ' ORDER BY id) AS indices,
    string_agg(n, ' ' ORDER BY id) AS counts FROM cells GROUP BY source""",
)
def dfm_vectors(spark, sf):
    """One sparse vector per source, written out as text."""
    counts = ct.count_by(tokens(spark, sf, "source"), "source", "word")
    vectors = rs.dfm_vectors(counts, rs.dfm_dictionary(counts, "word"), "source", "word")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ")
    return vectors.select("source", "size", listed("indices").alias("indices"), listed("values").alias("counts"))


@query("append_column", "SELECT *, n_chars - word_count AS difference FROM (SELECT doc_id, n_chars FROM documents) JOIN (SELECT doc_id, word_count FROM survey) USING (doc_id)")
def append_column(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "n_chars", "text")
    counted = docs.select("doc_id", "n_chars", tx.word_count("text").alias("word_count"))
    return counted.withColumn("difference", F.col("n_chars") - F.col("word_count"))


# --- response length --------------------------------------------------------

def _lengths(spark, sf):
    return surveys(spark, sf).select("doc_id", "segment", "segment_name", "device", "word_count")


@query("median_word_count", "SELECT median(word_count)::DOUBLE AS median FROM survey")
def median_word_count(spark, sf):
    return st.median(_lengths(spark, sf), "word_count")


@query("median_word_count_by", "SELECT segment_name, device, median(word_count)::DOUBLE AS median FROM survey GROUP BY ALL")
def median_word_count_by(spark, sf):
    return st.median(_lengths(spark, sf), "word_count", by=["segment_name", "device"])


@query(
    "word_count_summary",
    """SELECT segment, device, round_even(avg(word_count), 0) AS mean, round_even(median(word_count)::DOUBLE, 0) AS median
    FROM survey GROUP BY ALL""",
)
def word_count_summary(spark, sf):
    return st.mean_median(_lengths(spark, sf), "word_count", by=["segment", "device"], digits=0)


@query("histogram_fixed", "SELECT segment, ceil((word_count - 2.5::DOUBLE) / 5.0::DOUBLE) * 5.0::DOUBLE AS bin, count(*) AS n FROM survey GROUP BY ALL")
def histogram_fixed(spark, sf):
    return st.histogram_fixed(_lengths(spark, sf), "word_count", 5, by="segment")


@query("histogram_fixed_overall", "SELECT ceil((word_count - 2.5::DOUBLE) / 5.0::DOUBLE) * 5.0::DOUBLE AS bin, count(*) AS n FROM survey GROUP BY ALL")
def histogram_fixed_overall(spark, sf):
    return st.histogram_fixed(_lengths(spark, sf), "word_count", 5)


_POLYGON = """, frame AS (SELECT min(word_count)::DOUBLE AS low, (max(word_count)::DOUBLE - min(word_count)::DOUBLE) / 29 AS w FROM survey),
cells AS (SELECT segment, ceil((word_count - low) / w - 0.5)::BIGINT AS bin, count(*) AS n FROM survey, frame GROUP BY ALL),
totals AS (SELECT segment, sum(n) AS total FROM cells GROUP BY segment),
grid AS (SELECT segment, total, unnest(range(0, 30)) AS bin FROM totals),
filled AS (SELECT g.segment, g.bin, coalesce(c.n, 0) AS n, low + g.bin * w AS centre, coalesce(c.n, 0) / (g.total * w) AS density
  FROM grid g LEFT JOIN cells c ON g.segment = c.segment AND g.bin = c.bin, frame)
"""


@query("freq_polygon", _POLYGON + "SELECT segment, bin, n, round(centre, 6) AS centre FROM filled")
def freq_polygon(spark, sf):
    return rounded(st.freq_polygon(_lengths(spark, sf), "word_count", "segment"), "centre")


@query("freq_polygon_density", _POLYGON + "SELECT segment, bin, n, round(centre, 6) AS centre, round(density, 9) AS density FROM filled")
def freq_polygon_density(spark, sf):
    out = st.freq_polygon(_lengths(spark, sf), "word_count", "segment", density=True)
    return rounded(rounded(out, "centre"), "density", digits=9)


def _box_sql(rows: str, value: str) -> str:
    return f"""SELECT segment_name, device, round(lower, 6) AS lower, round(middle, 6) AS middle, round(upper, 6) AS upper,
    round(least(lower, min(CASE WHEN inside THEN x END)), 6) AS ymin, round(greatest(upper, max(CASE WHEN inside THEN x END)), 6) AS ymax,
    count_if(NOT inside) AS outliers FROM (SELECT *, x >= lower - 1.5 * (upper - lower) AND x <= upper + 1.5 * (upper - lower) AS inside FROM (
    SELECT segment_name, device, CAST({value} AS DOUBLE) AS x FROM {rows}) JOIN (
    SELECT segment_name, device, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS lower, quantile_cont(CAST({value} AS DOUBLE), 0.5) AS middle,
    quantile_cont(CAST({value} AS DOUBLE), 0.75) AS upper FROM {rows} GROUP BY ALL) USING (segment_name, device))
    GROUP BY segment_name, device, lower, middle, upper"""


_BOX = ["lower", "middle", "upper", "ymin", "ymax"]


@query("boxplot_stats", _box_sql("survey", "word_count"))
def boxplot_stats(spark, sf):
    return rounded(st.boxplot_stats(_lengths(spark, sf), "word_count", ["segment_name", "device"]), *_BOX)


@query("boxplot_stats_scores", _box_sql("scored", "avg_sm_score"))
def boxplot_stats_scores(spark, sf):
    from verbatim.plans.feeling import scored_responses

    return rounded(st.boxplot_stats(scored_responses(spark, sf), "avg_sm_score", ["segment_name", "device"], few_values=False), *_BOX)


@query(
    "boxplot_outliers",
    """SELECT segment_name, device, word_count, count(*) AS n FROM survey JOIN (
    SELECT segment_name, device, quantile_cont(CAST(word_count AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(word_count AS DOUBLE), 0.75) AS q3
    FROM survey GROUP BY ALL) USING (segment_name, device)
    WHERE word_count < q1 - 1.5 * (q3 - q1) OR word_count > q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
)
def boxplot_outliers(spark, sf):
    return st.boxplot_outliers(_lengths(spark, sf), "word_count", ["segment_name", "device"])


def _density_sql(rows: str, value: str, by: str) -> str:
    return f""", freq AS (SELECT {by}, CAST({value} AS DOUBLE) AS v, count(*) AS c FROM {rows} GROUP BY ALL),
    grp AS (SELECT {by}, count(*) AS size, stddev_samp(CAST({value} AS DOUBLE)) AS sd,
      (quantile_cont(CAST({value} AS DOUBLE), 0.75) - quantile_cont(CAST({value} AS DOUBLE), 0.25)) / 1.34::DOUBLE AS iqr,
      min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi FROM {rows} GROUP BY ALL),
    frame AS (SELECT bw, lo - 3 * bw AS start, ((hi + 3 * bw) - (lo - 3 * bw)) / 511 AS step FROM (
      SELECT avg(CASE WHEN size > 1 THEN 0.9::DOUBLE * coalesce(nullif(least(sd, iqr), 0), nullif(sd, 0), nullif(abs(lo), 0), 1)
      * pow(size, -0.2::DOUBLE) END) AS bw, min(lo) AS lo, max(hi) AS hi FROM grp)),
    grid AS (SELECT unnest(range(0, 512)) AS point),
    spot AS (SELECT {by}, c, (v - start) / step AS pos FROM freq, frame),
    cells AS (SELECT {by}, cell, sum(w) AS w FROM (
      SELECT {by}, floor(pos) AS cell, c * (1 - (pos - floor(pos))) AS w FROM spot
      UNION ALL SELECT {by}, floor(pos) + 1, c * (pos - floor(pos)) FROM spot) GROUP BY ALL),
    kern AS (SELECT {by}, point, start + point * step AS x, bw, sum(w * exp(-0.5::DOUBLE * ((point - cell) * step / bw) * ((point - cell) * step / bw))) AS k
      FROM cells, grid, frame GROUP BY ALL)
    SELECT {by}, point, round(x, 4) AS x, round(k / (size * bw * sqrt(2 * pi())), {{digits}}) AS density
    FROM kern JOIN grp USING ({by}) WHERE size >= 3"""


@query(
    "density_ridges",
    """, freq AS (SELECT segment_name, device, word_count::DOUBLE AS v, count(*) AS c FROM survey GROUP BY ALL),
    grp AS (SELECT segment_name, device, count(*) AS size, stddev_samp(word_count) AS sd,
      (quantile_cont(word_count::DOUBLE, 0.75) - quantile_cont(word_count::DOUBLE, 0.25)) / 1.34::DOUBLE AS iqr, min(word_count)::DOUBLE AS lo,
      max(word_count)::DOUBLE AS hi FROM survey GROUP BY ALL),
    frame AS (SELECT avg(CASE WHEN size > 1 THEN 0.9::DOUBLE * coalesce(nullif(least(sd, iqr), 0), nullif(sd, 0), nullif(abs(lo), 0), 1)
      * pow(size, -0.2::DOUBLE) END) AS bw, min(lo) AS lo, max(hi) AS hi FROM grp),
    grid AS (SELECT unnest(range(0, 512)) AS point),
    pts AS (SELECT point, bw, lo - 3 * bw + point * ((hi + 3 * bw) - (lo - 3 * bw)) / 511 AS x FROM grid, frame),
    kern AS (SELECT segment_name, device, point, x, bw, sum(c * exp(-0.5::DOUBLE * ((x - v) / bw) * ((x - v) / bw))) AS k FROM freq, pts GROUP BY ALL)
    SELECT segment_name, device, point, round(x, 4) AS x, round(k / (size * bw * sqrt(2 * pi())), 6) AS density
    FROM kern JOIN grp USING (segment_name, device) WHERE size >= 3""",
)
def density_ridges(spark, sf):
    out = st.density_ridges(_lengths(spark, sf), "word_count", ["segment_name", "device"])
    return rounded(rounded(out, "x", digits=4), "density")


@query("density_ridges_binned", _density_sql("survey", "word_count", "segment_name, device").format(digits=6))
def density_ridges_binned(spark, sf):
    """The same with values binned onto the grid."""
    out = st.density_ridges(_lengths(spark, sf), "word_count", ["segment_name", "device"], binned=True)
    return rounded(rounded(out, "x", digits=4), "density")


# --- continuous values ------------------------------------------------------

def _prices(spark, sf):
    return table(spark, sf, "orders", "o_orderpriority", "o_totalprice")


@query(
    "quantiles_continuous",
    """SELECT o_orderpriority, round(quantile_cont(o_totalprice::DOUBLE, 0.0), 6) AS p0, round(quantile_cont(o_totalprice::DOUBLE, 0.1), 6) AS p10,
    round(quantile_cont(o_totalprice::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(o_totalprice::DOUBLE, 0.999), 6) AS p999,
    round(quantile_cont(o_totalprice::DOUBLE, 1.0), 6) AS p100 FROM orders GROUP BY o_orderpriority""",
)
def quantiles_continuous(spark, sf):
    """Order statistics of prices by rank selection."""
    found = st.selected_quantiles(_prices(spark, sf), "o_totalprice", (0.0, 0.1, 0.5, 0.999, 1.0), "o_orderpriority")
    columns = [F.col("quantiles")[k].alias(c) for k, c in enumerate(("p0", "p10", "p50", "p999", "p100"))]
    return rounded(found.select("o_orderpriority", *columns), "p0", "p10", "p50", "p999", "p100")


def _price_box_sql() -> str:
    return _box_sql("(SELECT o_orderpriority AS segment_name, 'all' AS device, o_totalprice FROM orders)", "o_totalprice")


@query("boxplot_stats_continuous", _price_box_sql())
def boxplot_stats_continuous(spark, sf):
    rows = _prices(spark, sf).select(F.col("o_orderpriority").alias("segment_name"), F.lit("all").alias("device"), "o_totalprice")
    return rounded(st.boxplot_stats(rows, "o_totalprice", ["segment_name", "device"], few_values=False), *_BOX)


@query("density_ridges_continuous", _density_sql("orders", "o_totalprice", "o_orderpriority").format(digits=12))
def density_ridges_continuous(spark, sf):
    out = st.density_ridges(_prices(spark, sf), "o_totalprice", "o_orderpriority", few_values=False)
    return rounded(rounded(out, "x", digits=4), "density", digits=12)


@query("global_reference_lines", "SELECT avg(word_count) AS mean, median(word_count)::DOUBLE AS median FROM survey")
def global_reference_lines(spark, sf):
    return st.global_reference_lines(_lengths(spark, sf), "word_count")
