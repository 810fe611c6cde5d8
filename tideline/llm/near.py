"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

1. Every text becomes the set of its runs of five words. Its MinHash values are one sequence
   per tree; texts that agree on a prefix of a tree's sequence are below one node of its trie. A
   prefix is known by a hash, so the sorted runs of a trie are equi-joins here, which Spark can
   deal out whatever the size of a node.
2. Prefixes adapt to the data. All of a text's prefixes start at ``LONGEST`` values and are
   shortened to ``SHORTEST``, tree by tree from the least crowded node on, until a link at the threshold is
   found with chance ``RECALL``; so a text keeps the long prefix in the ``spare()`` trees at most in which
   the most other texts crowd below its short one. A crowded node is split into its long prefixes if all texts
   below keep them long there, else it stays whole, which can only find more. This parts texts
   that agree in a few trees only, by a passage that all of them quote.
3. Each node links its texts to its smallest one: as many rows as texts. The connected
   components of these links hold all pairs that the forest proposes.
4. Inside a component all pairs are compared exactly, as products of incidence matrices over
   pairs of bounded blocks. Only numbers of links and links to roots leave a task, never
   pairs, so a group of m near copies gives m rows.

Equal texts (equal words, that is) are one class from the start and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import documents, stage
from tideline.llm.components import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
TREES = 64
SHORTEST = 7
LONGEST = 12
RECALL = 0.99999
#: Texts from which on a node is crowded.
CROWD = 8
#: Bounds of one side of a comparison: bytes of text and number of texts.
BLOCK_BYTES = 4 << 20
BLOCK_TEXTS = 512
#: Shingles multiplied at a time.
STRIPE = 2048
_MULTIPLIERS = np.random.default_rng(20240101).integers(0, 1 << 63, TREES * LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)


def spare(threshold: float = float(THRESHOLD), trees: int = TREES, shortest: int = SHORTEST, longest: int = LONGEST, recall: float = RECALL) -> int:
    """Trees in which a text may keep the long prefix: with short ones in the others, a link at the threshold is found with chance ``recall``."""
    missed = lambda k: (1 - threshold**longest) ** k * (1 - threshold**shortest) ** (trees - k)
    k = 0
    while k < trees and missed(k + 1) <= 1 - recall:
        k += 1
    if missed(k) > 1 - recall:
        raise ValueError("the shortest prefixes do not reach the recall: take shorter ones or more trees")
    return k


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of five words; of all its words, if fewer."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(each) - WORDS + 1)
    h = np.full(n, min(len(each), WORDS), np.uint64)
    for i in range(min(WORDS, len(each))):
        h = (h ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def labels(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tree 64-bit keys of the first ``SHORTEST`` and the first ``LONGEST`` MinHash values."""
    least = np.full(TREES * LONGEST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STRIPE):
        np.minimum(least, (_MULTIPLIERS[:, None] * found[None, at : at + STRIPE]).min(axis=1), out=least)
    keys, short = np.arange(1, TREES + 1, dtype=np.uint64), None
    for depth, value in enumerate(least.reshape(LONGEST, TREES), 1):
        keys = (keys ^ value) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        short = keys.copy() if depth == SHORTEST else short
    return short.view(np.int64), keys.view(np.int64)


def sketch(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash of the text, key of its words, bytes, short and long prefix of each tree); no key without words, no prefixes below five."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, short, long = [], [], [], []
            for t in batch.column(2).to_pylist():
                words = t.encode().split()
                keys.append(int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64)) if words else None)
                sizes.append(len(t))
                a, b = labels(shingles(t)) if len(words) >= WORDS else (None, None)
                short.append(a)
                long.append(b)
            arrays = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(short, pa.list_(pa.int64())), pa.array(long, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "hash", "key", "bytes", "short", "long"])

    return rows.mapInArrow(run, "id long, hash long, key long, bytes long, short array<long>, long array<long>")


def nodes(entries: DataFrame, prefix: str) -> DataFrame:
    """(prefix, least, n) of the nodes with two texts or more. Written, so that what joins it is of two plain shuffles and Spark can split a large node."""
    found = entries.groupBy(prefix).agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    return stage(found.filter("n > 1"))


def forest(texts: DataFrame, crowd: int = CROWD, keep: int | None = None) -> DataFrame:
    """Edges (a, b) between the ``key`` of texts with prefixes ``short`` and ``long`` and the smallest one of each of their nodes.

    ``keep``: trees in which a text may keep its long prefix (``spare()``).
    """
    keep = spare() if keep is None else keep
    known = texts.filter("short IS NOT NULL")
    entries = known.select("key", F.explode("short").alias("short"))
    below = nodes(entries, "short")
    crowded = below.filter(F.col("n") >= crowd).select("short", "n")
    both = known.select("key", F.inline(F.arrays_zip("short", "long")))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "short")
    ranked = stage(both.join(crowded, "short").withColumn("long_here", F.row_number().over(order) <= keep))
    split = stage(ranked.groupBy("short").agg(F.bool_and("long_here").alias("all")).filter("all").select("short"))
    parted = ranked.join(split, "short").select("key", "long")
    whole = stage(below.join(split, "short", "left_anti"))
    edges = [entries.join(whole, "short"), parted.join(nodes(parted, "long"), "long")]
    return edges[0].select(F.col("key").alias("a"), F.col("least").alias("b")).unionByName(edges[1].select(F.col("key").alias("a"), F.col("least").alias("b")))


def compare(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each set, weighted and plain, and the smallest index that its links lead to.

    With ``side`` (0 or 1 for each set) only pairs across the sides count.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
    common = np.zeros((m, m), np.int64)
    width = max(64, min(STRIPE, (1 << 22) // m))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        common += (block @ block.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = threshold.denominator * common >= threshold.numerator * union
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    root = np.arange(m)
    while True:
        best = np.where(linked, root[None, :], m).min(axis=1)
        new = np.minimum(root, best)
        new = new[new]
        if (new == root).all():
            return linked @ weights, linked.sum(axis=1), root
        root = new


def verify(blocks: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(key, links, text_links, root) for each text of each block pair.

    ``blocks``: (component, low, high, block, key, n, text), sorted inside partitions by the
    first three, of which one group at a time is held.
    """

    def solve(group: dict) -> pa.RecordBatch:
        texts = {k: (t, n, b) for k, t, n, b in zip(group["key"], group["text"], group["n"], group["block"])}
        keys = sorted(texts)
        sets = [shingles(texts[k][0]) for k in keys]
        weights = np.array([texts[k][1] for k in keys], np.int64)
        apart = group["low"] != group["high"]
        side = np.array([texts[k][2] == group["high"] for k in keys]) if apart else None
        links, plain, root = compare(sets, weights, side, threshold)
        names = np.array(keys, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(links.astype(np.int64)), pa.array(plain.astype(np.int64)), pa.array(names[root])], names=["key", "links", "text_links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for component, low, high, block, key, n, text in zip(*columns):
                if (component, low, high) != now:
                    if now is not None:
                        yield solve(group)
                    now, group = (component, low, high), {"low": low, "high": high, "key": [], "text": [], "n": [], "block": []}
                for k, v in (("key", key), ("text", text), ("n", n), ("block", block)):
                    group[k].append(v)
        if now is not None:
            yield solve(group)

    return blocks.mapInArrow(run, "key long, links long, text_links long, root long")


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """(id, hash, class_id, class_hash, n_links, n_text_links, class_size): a row per document.

    ``class_id`` is the smallest id among the documents that links connect, ``n_links`` the
    number of other documents at ``threshold`` or above, copies included, ``n_text_links`` that of
    other texts. ``hash`` tells rows of one id apart. Documents without words (null, empty) link to none and are their own class;
    with fewer than five words they link to equal ones only. Rows with a null id take part and
    lend a class their id only if it has no other. Repeated rows are copies of each other.
    """
    rows = stage(sketch(docs, id, text))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash"))
    # all that is known of equal words, once; their prefixes are equal too
    kept = [F.any_value(c).alias(c) for c in ("short", "long")]
    texts = stage(rows.filter("key is not null").groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), *kept))
    near = components(forest(texts, keep=spare(float(threshold))))
    texts = texts.drop("short", "long")

    members = stage(near.withColumnRenamed("node", "key").join(texts, "key"))
    # written like the nodes: a component of very many texts can be split
    sizes = stage(members.groupBy("component").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int").alias("blocks")))
    placed = members.join(sizes, "component").select("component", "key", "n", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.col("first.id").alias("i"), F.col("first.hash").alias("h"))
    bodies = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    chosen = placed.join(bodies, F.col("h").eqNullSafe(F.col("hash")) & F.col("i").eqNullSafe(F.col("id"))).dropDuplicates(["key"])
    pairs = chosen.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "n", "text"
    )
    dealt = pairs.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
    checked = stage(verify(dealt, threshold))

    links = checked.groupBy("key").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    classes = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    known = stage(texts.join(links, "key", "left").join(classes, "key", "left").withColumn("component", F.coalesce("component", "key")))
    whole = stage(known.groupBy("component").agg(F.min("first").alias("class"), F.sum("n").alias("class_size")))
    result = known.join(whole, "component").select("key", "class", "class_size", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("text_links", F.lit(0)).alias("n_text_links"))
    empty = F.col("class").isNull()
    return rows.select("id", "hash", "key").join(result, "key", "left").select(
        "id",
        "hash",
        F.when(empty, F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.when(empty, F.col("hash")).otherwise(F.col("class.hash")).alias("class_hash"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def unique(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id. Documents without words stay."""
    found = join(docs, id, text, threshold)
    own = found.filter(F.col("id").eqNullSafe(F.col("class_id")) & F.col("hash").eqNullSafe(F.col("class_hash")))
    kept = stage(own.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("class_size").alias("size")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id).alias("_id"), F.col(text).alias("_text"))
    at = F.col("_id").cast("long").eqNullSafe(F.col("id")) & F.xxhash64("_text").eqNullSafe(F.col("hash"))
    once = rows.join(kept.filter("n = 1 or size = 1"), at, "left_semi")
    more = rows.join(kept.filter("n > 1 and size > 1"), at, "left_semi").dropDuplicates(["_id", "_text"])
    return once.unionByName(more).select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return join(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_text_links", "class_size")


#: All pairs by their common shingles, and classes by walking the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), k AS (
  SELECT x AS doc_id, min(y) AS class_id, count(*)::BIGINT AS class_size FROM r GROUP BY x
), t AS (
  SELECT x AS doc_id, count(*)::BIGINT AS n_links,
         count(DISTINCT CASE WHEN array_to_string(b.words, ' ') <> array_to_string(a.words, ' ') THEN array_to_string(b.words, ' ') END)::BIGINT AS n_text_links
  FROM l JOIN w a ON a.doc_id = x JOIN w b ON b.doc_id = y GROUP BY x
)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links, class_size FROM k LEFT JOIN t USING (doc_id)
"""
