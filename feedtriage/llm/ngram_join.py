"""Jaccard join of documents on word n-grams by signature trees.

1. One pass makes each text's set of n-grams. Texts with equal sets are one class; its
   smallest id stands for it from step 3 on.
2. Sets that may link are brought together by part keys. Sets of at most r members that
   link differ in at most d(r) members, so of d + 1 + e hash ranges at least 1 + e hold
   the same members in both. Each class emits the hash of each range; for the size class
   of its set and the next one, so that any two sets of fitting sizes meet. A range that
   is empty or holds only frequent n-grams is weak; a set with at most e weak ranges
   leaves them out and still shares a strong one with each set it links to.
   Which n-grams are frequent is learned from a sample and steers cost only: it moves
   keys from the weak to the strong side and never removes a possible link.
3. Classes that share keys form clusters. A cluster, or each pair of chunks of a large
   one, is joined by a signature tree and verified by counting common members.
4. Verified links, one per class and tree at most, give the components.

Nothing is linked, dropped or cut short by a group's size.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm.batches import FEWER_CHARS, text_batches
from feedtriage.llm.components import connected_components
from feedtriage.llm.key_links import key_links, texts_of
from feedtriage.llm.shingles import mix, shingle_sets
from feedtriage.llm.signature_tree import SignatureTree
from feedtriage.scratch import Scratch

#: Sets of one task: larger clusters are joined chunk by chunk.
CHUNK = 2_000
#: Digests that a task remembers, so that copies bring their keys once.
SEEN = 1_000_000
#: Keys that make one block, and keys that a task combines before it sends them.
BLOCK_KEYS, HELD = 200_000, 500_000
#: N-grams in more than this many texts of a sample of SAMPLE texts are frequent.
SAMPLE, FREQUENT, FREQUENT_KEPT = 20_000, 8, 500_000


class Parts:
    """Part keys of sets for the similarity num / den."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den = num, den
        self.frequent = np.sort(frequent) if len(frequent) else np.zeros(1, np.uint64)  # 0 stands for none
        self.ranges: dict[int, np.ndarray] = {}
        self.highs = [den // num]
        self.classes = [(1, den // num)]  # sizes of each class, smallest and largest

    def _class_of(self, size: int) -> int:
        while self.classes[-1][1] < size:
            low = self.classes[-1][1] + 1
            self.classes.append((low, low * self.den // self.num))
            self.highs.append(self.classes[-1][1])
        return bisect.bisect_left(self.highs, size)

    def _ranges(self, n: int) -> np.ndarray:
        """Where n equal ranges of hashes begin."""
        if n not in self.ranges:
            self.ranges[n] = np.array([(k << 64) // n for k in range(n)], np.uint64)
        return self.ranges[n]

    def keys(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of strong ranges, and of weak ones where they are needed. A strong key holds
        an n-gram that is not frequent, so only weak ones can be shared by very many sets."""
        if not len(members):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self._class_of(len(members))
        self._class_of(self.classes[own][1] + 1)
        place = np.searchsorted(self.frequent, members)
        rare = self.frequent[np.minimum(place, len(self.frequent) - 1)] != members
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        rares = np.concatenate([[0], np.cumsum(rare)])
        strong, hot = [], []
        for c in (own, own + 1):
            high = self.classes[c][1]
            differ = 2 * high * (self.den - self.num) // (self.den + self.num)
            if not differ:
                continue  # sets of this class that link are equal
            spare = min(differ, 6 + differ // 8)
            n = differ + 1 + spare
            edges = np.append(np.searchsorted(members, self._ranges(n)), len(members))
            part = sums[edges[1:]] - sums[edges[:-1]]
            weak = rares[edges[1:]] == rares[edges[:-1]]
            key = mix(part + mix(np.arange(n, dtype=np.uint64) + np.uint64(c << 32)))
            strong.append(key[~weak])
            if weak.sum() > spare:
                hot.append(key[weak])
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(strong or none).view(np.int64), np.concatenate(hot or none).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays)))


def _frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of n-grams that are frequent in a sample by id; at most FREQUENT_KEPT."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches):
        for _, chunk in text_batches(batches, "text", FEWER_CHARS):
            grams, times = np.unique(np.concatenate(shingle_sets(chunk, n)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times)], ["gram", "n"])

    top = (sample.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
           .where(F.col("n") > FREQUENT).orderBy(F.desc("n"), "gram").limit(FREQUENT_KEPT).select("gram"))
    return np.array([r.gram for r in top.collect()], np.int64).view(np.uint64)


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100,
                     id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same
    set) and component_id (smallest id reachable by links, itself included).

    Two texts link when den * overlap >= num * union of their n-grams. Null text, empty
    text and text without words have no n-grams and link with nothing. Ids must be
    integers; a null id is given back as its own component. Repeated rows stay and are in one class.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(texts, n))

    def sketch(batches):
        parts, seen, none = Parts(num, den, frequent.value), set(), np.zeros(0, np.int64)
        for batch, chunk in text_batches(batches, "text", FEWER_CHARS):
            sets = shingle_sets(chunk, n)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = []
            for digest, members_of in zip(digests, sets):  # of the copies in a task one brings the keys
                keys.append((none, none) if digest in seen else parts.keys(members_of))
                seen.add(digest)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 _lists([k for k, _ in keys]), _lists([k for _, k in keys])],
                ["doc_id", "n_shingles", "digest", "keys", "hot_keys"])

    sketches = scratch.save(texts.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, keys array<long>, hot_keys array<long>"), "sketches",
                            n_keys=F.sum(F.size("keys") + F.size("hot_keys")))
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    members = scratch.save(sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
                           .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "members")
    clusters = (_clusters(sketches, scratch).join(members.select("doc_id", "class_id"), "doc_id")
                .select(F.col("class_id").alias("doc_id"), "cluster").distinct())
    clusters = scratch.save(clusters, "clusters")
    scratch.drop(sketches)  # the keys are the largest table

    def join(chunk: list[str]) -> np.ndarray:
        return SignatureTree(shingle_sets(chunk, n), num, den).join()

    links = joined(texts_of(texts, clusters), clusters, join, scratch)
    scratch.drop(clusters)
    found = connected_components(links, scratch)
    return (members.join(found, members.class_id == found.node, "left")
            .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")))


def _clusters(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, cluster) of the classes that share a key with another class. Keys of weak ranges
    may be held by very many classes; a task sends each once, with its smallest class."""
    def find(batches):
        for batch in batches:
            for column in ("keys", "hot_keys"):
                lists = batch.column(column)
                ids = np.repeat(batch.column("doc_id").to_numpy(), pc.list_value_length(lists).to_numpy())
                yield lists.flatten().to_numpy().view(np.uint64), ids

    rows = sketches.where("doc_id is not null").select("doc_id", "keys", "hot_keys")
    links = key_links(rows, find, 1 + (sketches.metrics["n_keys"] or 0) // BLOCK_KEYS, HELD)
    return connected_components(links, scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def joined(texts: DataFrame, clusters: DataFrame, join, scratch: Scratch) -> DataFrame:
    """Links (a, b) within clusters. ``join`` gets texts and gives the component of each as
    the place of one of them; it sees at most two chunks of a cluster at a time, and every
    two texts of a cluster meet in some call."""
    sizes = (clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    placed = clusters.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: (k != F.col("chunk")) | (F.col("chunks") == 1))
    placed = placed.select("doc_id", "cluster", "chunk", F.explode(others).alias("other"))
    placed = placed.select("doc_id", "cluster", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    group = ["cluster", "low", "high"]
    rows = texts.join(placed, "doc_id").repartition(*group).sortWithinPartitions(*group, "doc_id")

    def linked(keep: list[tuple[int, str]]) -> pa.RecordBatch:
        ids = np.array([i for i, _ in keep], np.int64)
        roots = ids[join([t for _, t in keep])]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["a", "b"])

    def run(batches):
        now, keep = None, []
        for batch in batches:
            for key, doc_id, text in zip(zip(*[batch.column(c).to_pylist() for c in group]),
                                         batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if key != now and keep:
                    yield linked(keep)
                    keep = []
                now = key
                keep.append((doc_id, text or ""))
        if keep:
            yield linked(keep)

    found = rows.select("doc_id", "text", *group).mapInArrow(run, "a long, b long")
    return scratch.save(found.where("a <> b"), "verified")
