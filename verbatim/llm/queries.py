"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from verbatim.llm import alignment, chat, ctph, jaccard, packing, pieces, quality, secrets, sharding, spelling, suffixes, toxicity, transducers
from verbatim.llm.common import NO_KEY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


@query
def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    chats = chat.format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "n_turns", "n_copies", "rendered")


ORACLES["op8_snapshot_collapse"] = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10))
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
),
wholes AS (
  SELECT min(conv_id) AS conv_id, pos AS n_turns, count(*) AS n_copies, so_far AS rendered FROM placed WHERE pos = n GROUP BY pos, so_far
)
SELECT conv_id, n_turns, n_copies, rendered FROM wholes AS w
WHERE NOT EXISTS (SELECT 1 FROM placed AS p WHERE p.pos < p.n AND p.pos = w.n_turns AND p.so_far = w.rendered)
"""


def toxicity_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """Learned from labelled rows that are not held out."""
    return toxicity.learn(toxicity.training_rows(docs, labels, ~toxicity.held_out(), "doc_id", "text", "toxic"))


@query
def op10_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_lexicon(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_hits")


@query
def op6_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("crf")
    )


@query
def op3_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and their decoding."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


@query
def op2_vertical_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word sets are similar by 0.9 or more."""
    linked = jaccard.link(table(spark, sf_dir, "documents"), 3, 90, 100)
    smallest = F.when(F.col("component") < NO_KEY, F.col("component"))
    return linked.select("doc_id", "n_shingles", smallest.alias("component_id"))


@query
def op7_piecewise_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return ctph.fingerprint(table(spark, sf_dir, "documents"))


@query
def op9_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings cut out of every document."""
    return suffixes.deduplicated(table(spark, sf_dir, "documents"), 100)


@query
def op11_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return transducers.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op12_aligned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie on every document."""
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their commoner spellings."""
    return spelling.variants(table(spark, sf_dir, "documents"))
