"""Similarity join of n-gram sets by vertical partitioning.

The n-grams of all texts have one global order, that of their hashes, and the order
is cut into fragments. Two sets of Jaccard similarity t differ in at most
n (1 - t) / t n-grams, so with more fragments than that some fragment of the two is
equal. Documents with an equal fragment are candidates; the overlaps of a candidate
pair are counted fragment by fragment and summed. What such pairs leave open within
a cluster of candidates is settled exactly, block by block, without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from verbatim.llm.common import NO_KEY, Words, discard, grouped, map_slices, mix, node_key, saved, text_of, unused
from verbatim.llm.graph import components, roots

#: Fragments in which overlaps are counted separately.
FRAGMENTS = 8
#: N-grams and texts of one block of a cluster; two blocks meet in a task.
BLOCK_GRAMS, BLOCK_TEXTS = 1_500_000, 2_000
_U = np.uint64


def sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; one hash of all words where there are fewer."""
    w = Words(texts, lower_ascii=True)
    at, grams = w.grams(words)
    first = np.searchsorted(at, w.first)
    out = []
    for r, n in enumerate(w.count):
        if n >= words:
            out.append(np.unique(grams[first[r] : first[r + 1]]))
        elif n:
            h = _U(n)
            for x in w.hash[w.first[r] : w.first[r + 1]]:
                h = mix(np.array([h * _U(0x9E3779B97F4A7C15) + x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def differences(n: int, num: int, den: int) -> int:
    """Most n-grams by which a set of n may differ from one of similarity num / den."""
    return n * (den - num) // num


@lru_cache(maxsize=None)
def size_bounds(num: int, den: int) -> np.ndarray:
    """Least sizes of the size classes, which double; linked sets are in one class or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(2 * out[-1], -(-out[-1] * den // num)))
    return np.array(out)


def signatures(grams: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Keys of a set in three families: fragments for its own size class, for the next one, and single n-grams.

    The next class counts only if a linked set may be in it. Two linked sets that are
    not equal have at least (fragments - differences) keys in common in one family of
    fragments, so that the prefix rule holds there: of the keys in any order that is
    the same for all sets, the first (differences + 1) of each set meet. A set with
    too few non-empty fragments for that gives single n-grams besides, already cut by
    the same rule; two such sets meet there.
    """
    n = len(grams)
    none = np.zeros(0, np.uint64)
    most = differences(n, num, den)
    if not most:
        return [none, none, none]  # only equal sets are linked
    bounds = size_bounds(num, den)
    own = int(np.searchsorted(bounds, n, "right")) - 1
    spread, out, short = mix(grams), [], False
    for part in (own, own + 1):
        if part > own and den * n < num * int(bounds[part]):
            out.append(none)
            continue
        pieces = 5 * differences(int(bounds[part + 1]) - 1, num, den) // 4 + 3
        fragment = ((grams >> _U(32)) * _U(pieces)) >> _U(32)
        start = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        out.append(mix(np.add.reduceat(spread, start) + fragment[start] * _U(0xD6E8FEB86659FD93) + np.uint64([part + 1]) * _U(0xA0761D6478BD642F)))
        short |= len(start) <= most
    need = n - -(-n * num // den) + 1
    out.append(mix(np.sort(spread)[:need] ^ _U(0xE7037ED1A0B428DB)) if short else none)
    return out


def _class_columns(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and a 128-bit digest of each set."""
    a = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    b = [int(mix(s * _U(0x9FB21C651E98DF25)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def settle(table: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of components with linked sets in a table (node, component, part), enough to join all that are linked.

    A text outside the largest component is held against all others at once: for
    each of its n-grams the shorter of the lists "who has it" and "who lacks it" is
    counted, so near copies of one text cost only their differences.
    """
    node, inverse = np.unique(table["node"].to_numpy(), return_inverse=True)
    k = len(node)
    lists = table["part"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    grams = lists.flatten().to_numpy()
    owner = np.repeat(inverse, sizes)
    n = np.bincount(owner, minlength=k)
    group = np.zeros(k, np.int64)
    group[inverse] = table["component"].to_numpy()
    names, group = np.unique(group, return_inverse=True)
    _, token = np.unique(grams, return_inverse=True)
    order = np.lexsort((owner, token))
    holders, ends = owner[order], np.cumsum(np.bincount(token))
    begins = np.concatenate([[0], ends[:-1]])
    per = np.argsort(owner, kind="stable")
    of = np.concatenate([[0], np.cumsum(n)])
    lacking: dict[int, np.ndarray] = {}
    parent = list(range(int(group.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    top = int(np.bincount(group).argmax())
    links = []
    for r in range(k):
        if root(int(group[r])) == root(top):
            continue
        tokens = token[per[of[r] : of[r + 1]]]
        count = np.zeros(k, np.int64)
        dense = tokens[2 * (ends[tokens] - begins[tokens]) > k]
        sparse = tokens[2 * (ends[tokens] - begins[tokens]) <= k]
        if len(sparse):
            count += np.bincount(np.concatenate([holders[begins[t] : ends[t]] for t in sparse]), minlength=k)
        if len(dense):
            count += len(dense)
            for t in dense:
                if t not in lacking:
                    has = np.zeros(k, bool)
                    has[holders[begins[t] : ends[t]]] = True
                    lacking[t] = np.flatnonzero(~has)
            count -= np.bincount(np.concatenate([lacking[t] for t in dense]), minlength=k)
        for y in np.flatnonzero(den * count >= num * (n[r] + n - count)):
            a, b = root(int(group[r])), root(int(group[y]))
            if a != b:
                parent[a] = b
                links.append((int(names[group[r]]), int(names[group[y]])))
    return links


def _texts(df: DataFrame, key: str, text: str) -> list[Column]:
    """What names a text of a key: the key, or a number for none, and a hash of the text."""
    return [node_key(key, text).alias("doc"), F.xxhash64(F.lit(1), F.col(text)).alias("hash")]


def _classes(df: DataFrame, words: int, num: int, den: int, key: str, text: str, block: int, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Classes of equal n-gram sets (n, s1, s2) and the component of linked sets that each is in.

    The nodes of the join are the classes, whatever keys their texts have. Columns
    n, s1, s2, ``first`` (doc and hash of the smallest text of the class) and
    ``root`` (one number for each component).
    """
    rows = df.select(*_texts(df, key, text), F.col(text).alias("_text"))

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(text_of(batch, "_text"), words)
        keys = [signatures(s, num, den) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *_class_columns(sets), *(_lists([k[f] for k in keys]) for f in range(3))],
            ["doc", "hash", "n", "s1", "s2", "k0", "k1", "k2"],
        )

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(text_of(batch, "_text"), words)
        at = [np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.uint64) << _U(61)) for s in sets]
        parts = [p for s, a in zip(sets, at, strict=True) for p in np.split(s, a)]
        take = pa.array(np.repeat(np.arange(len(sets)), FRAGMENTS))
        fragment = pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sets)))
        n = pa.array(np.repeat([len(s) for s in sets], FRAGMENTS).astype(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), n, fragment, _lists(parts)], ["node", "n", "fragment", "part"])

    same = ["n", "s1", "s2"]
    # The number of a class holds as long as the written table does.
    keyed = saved(
        map_slices(rows, "_text", "doc long, hash long, n long, s1 long, s2 long, k0 array<long>, k1 array<long>, k2 array<long>", signed).where("n > 0")
        .groupBy(*same).agg(F.min(F.struct("doc", "hash")).alias("first"), *[F.first(k).alias(k) for k in ("k0", "k1", "k2")])
        .withColumn("node", F.monotonically_increasing_id()),
        "jaccard-keys",
    )
    classes = saved(keyed.drop("k0", "k1", "k2"), "jaccard-classes")

    # Keys that several classes have. The prefix of a family takes the rarest keys first,
    # so a passage that many texts share makes candidates only of texts made up of it.
    most = F.expr(f"n * {den - num} div {num}")
    def tagged(family: int) -> Column:
        keys = F.col(f"k{family}")
        spare = (most + 1 - F.size(keys)).cast("int") if family < 2 else F.lit(1 << 30)
        return F.transform(keys, lambda k: F.struct(k.alias("sig"), F.lit(family).alias("family"), spare.alias("spare")))

    # One shuffle; a key is one of many of each class, so even the commonest is a small share of all rows.
    entries = keyed.select("node", F.inline(F.concat(*[tagged(f) for f in range(3)])))
    shared = entries.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("times > 1")
    family = Window.partitionBy("node", "family")
    prefix = saved(
        shared.withColumn("_place", F.row_number().over(family.orderBy("times", "sig"))).withColumn("_shared", F.count(F.lit(1)).over(family))
        .where(F.col("_place") <= F.col("spare") + F.col("_shared")).select("node", "sig"),
        "jaccard-prefixes",
    )
    discard(keyed)

    # Candidates: each class with the smallest one of every key it shares.
    leaders = prefix.groupBy("sig").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).where(F.col("leader") < F.col("_last")).drop("_last")
    stars = saved(
        prefix.join(leaders, "sig").where(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("times")), "jaccard-stars"
    )
    discard(prefix)
    wanted = stars.select("node").union(stars.select("leader")).distinct()
    # What is wanted grows with the table, so it is merged at every size and never broadcast.
    wanted = classes.select("node", "first.*").join(wanted, "node")
    texts = rows.join(wanted.hint("merge"), ["doc", "hash"]).select("node", "_text")
    sets = saved(
        map_slices(texts, "_text", "node long, n long, fragment int, part array<long>", cut)
        .groupBy("node", "fragment").agg(F.max(F.struct("n", "part")).alias("_s")).select("node", "fragment", "_s.n", "_s.part"),
        "jaccard-sets",
    )

    # Partial overlaps of each class and its most frequent leader, counted by fragment and summed.
    best = stars.groupBy("node").agg(F.max(F.struct("times", -F.col("leader"))).alias("_b")).select("node", (-F.col("_b.col2")).alias("leader"))
    left = best.join(sets, "node")
    right = sets.select(F.col("node").alias("leader"), "fragment", F.col("n").alias("m"), F.col("part").alias("other"))
    summed = (
        left.join(right, ["leader", "fragment"])
        .groupBy("node", "leader", "n", "m").agg(F.sum(F.size(F.array_intersect("part", "other"))).alias("common"))
        .where(den * F.col("common") >= num * (F.col("n") + F.col("m") - F.col("common")))
        .select(F.col("node").alias("a"), F.col("leader").alias("b"))
    )
    direct = saved(summed, "jaccard-direct")

    # The rest: clusters of candidates whose members have not all been joined yet.
    forest = roots(direct)
    joined = saved(forest.withColumnRenamed("root", "component"), "jaccard-joined")
    discard(direct, forest)
    named = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    apart = (
        stars.join(named("node"), "node", "left").join(named("leader"), "leader", "left")
        .select(F.coalesce("_node", "node").alias("a"), F.coalesce("_leader", "leader").alias("b")).where("a != b")
    )
    groups = components(apart)
    cluster = groups.withColumnsRenamed({"component": "cluster", "node": "component"})
    cluster = cluster.union(cluster.select("cluster", "cluster").distinct())
    sized_sets = sets.select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    members = sized_sets.join(cluster, "component").select("node", "component", "cluster")
    blocks = (
        members.join(sets.groupBy("node").agg(F.sum(F.size("part")).alias("_size")), "node").groupBy("cluster")
        .agg(F.greatest(F.ceil(F.sum("_size") / block), F.ceil(F.count(F.lit(1)) / block_texts)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = (
        members.join(blocks, "cluster").withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "component", "cluster", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
        .join(sets, "node").select("cluster", "i", "j", "node", "component", "part")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            found = settle(group, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rest = spread.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(links, "a long, b long")
    last = components(rest)
    discard(stars, sets, groups)
    final = last.select(F.col("node").alias("_root"), F.col("component").alias("_last"))
    known = classes.select(*same, "first", "node").join(joined, "node", "left").withColumn("_root", F.coalesce("component", "node"))
    out = saved(known.join(final, "_root", "left").select(*same, "first", F.coalesce("_last", "_root").alias("root")), "jaccard-known")
    discard(classes, joined, last)
    return out


def link(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", block: int = BLOCK_GRAMS,
         block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Size of each text's n-gram set and its component of linked texts.

    Texts of similarity num / den or more are linked. A text of fewer words than
    ``words`` has one n-gram, all of them; without words, or null, it has none and
    is linked with nothing. Equal sets are one class, so copies are never paired.
    Rows without key take part under a number made from their text and have no key in
    the result; a component without any key has none. Rows with one key are in one
    component: all that any of their texts is linked with. Other columns are ignored;
    an empty table gives no rows.

    Returns the key, ``node``, n_shingles and ``component`` (smallest node; a value
    from NO_KEY on means no key).
    """
    kind = df.schema[key].dataType.simpleString()

    def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(text_of(batch, "_text"), words)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_class_columns(sets)], ["_key", "node", "n", "s1", "s2"])

    rows = df.select(F.col(key).alias("_key"), node_key(key, text).alias("node"), F.col(text).alias("_text"))
    docs = map_slices(rows, "_text", f"_key {kind}, node long, n long, s1 long, s2 long", sized)
    known = _classes(df, words, num, den, key, text, block, block_texts)
    least = known.groupBy("root").agg(F.min("first.doc").alias("least"))
    known = known.join(least, "root").select("n", "s1", "s2", "least")
    found = saved(docs.join(known, ["n", "s1", "s2"], "left").select("_key", "node", "n", F.coalesce("least", "node").alias("least")), "jaccard-docs")

    # Components that share a key are one.
    torn = found.groupBy("node").agg(F.min("least").alias("_low"), F.max("least").alias("_high")).where("_low < _high").select("node", "_low")
    shared = components(found.join(torn, "node").select(F.col("least").alias("a"), F.col("_low").alias("b")))
    whole = found.join(shared.withColumnRenamed("node", "least"), "least", "left")
    return whole.select(F.col("_key").alias(key), "node", F.col("n").alias("n_shingles"), F.coalesce("component", "least").alias("component"))


def one_of_each(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with one row of each group of linked texts: one of the smallest key.

    A key groups nothing: rows that share one all stay where their texts are not
    linked. Rows whose text is null or has no words are linked with nothing, so all
    of them stay.
    """
    known = _classes(df, words, num, den, key, text, BLOCK_GRAMS)
    doc, digest = unused(df, "doc"), unused(df, "hash")
    kept = known.groupBy("root").agg(F.min("first").alias("_first")).select(F.col("_first.doc").alias(doc), F.col("_first.hash").alias(digest))
    spoken = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    named = df.where(spoken).withColumns(dict(zip((doc, digest), _texts(df, key, text), strict=True)))
    one = named.join(kept, [doc, digest], "left_semi").dropDuplicates([doc, digest]).select(*[F.col(f"`{c}`") for c in df.columns])
    return one.unionByName(df.where(~spoken))
