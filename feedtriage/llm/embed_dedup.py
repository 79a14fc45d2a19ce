"""Near-duplicate vectors by a forest of random-projection trees.

Vectors of one label go down several trees. Each level of a tree projects on a random
direction; each node splits at the median of a sample, and a vector close to the split
goes to both sides. Vectors that meet in a leaf are compared exactly, in double
precision, and links are united into components. Leaves are compared in blocks, so a
leaf of any size is compared whole by tasks of bounded size. A pair that meets in several
leaves is counted in the first one, which both vectors' leaf numbers tell, so pairs are
never listed or shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm.components import connected_components
from feedtriage.scratch import Scratch

#: Trees; rows a leaf should have; most rows of a block; sampled rows that place the splits.
TREES, LEAF, BLOCK, SAMPLE = 6, 768, 2048, 50_000
#: A vector nearer to a split than this goes to both sides, twice on its way at most.
SPILL, SPILLS = 0.02, 2
SLOTS = 1 << SPILLS


@dataclass
class Forest:
    """Directions by (dimension, tree, level); split values by label, dimension and tree, in heap order."""
    directions: dict[int, np.ndarray]
    splits: dict[tuple[int, int], list[np.ndarray]]

    def leaves(self, label: int, units: np.ndarray) -> np.ndarray:
        """Leaf numbers of unit vectors, SLOTS per tree, -1 where unused; one leaf for
        labels without trees. Leaves of later trees have higher numbers."""
        trees = self.splits.get((label, units.shape[1]))
        if trees is None:
            return np.concatenate([np.zeros((len(units), 1), np.int32), np.full((len(units), TREES * SLOTS - 1), -1, np.int32)], axis=1)
        out = np.full((len(units), TREES * SLOTS), -1, np.int32)
        for t, splits in enumerate(trees):
            depth = (len(splits) + 1).bit_length() - 1
            along = units @ self.directions[units.shape[1]][t, :depth].T
            nodes, budget = np.zeros((len(units), SLOTS), np.int64), np.full((len(units), SLOTS), SPILLS)
            nodes[:, 1:] = -1
            for level in range(depth):
                for s in range(SLOTS):
                    live = nodes[:, s] >= 0
                    # A node that was split off in this level is already one level down.
                    live &= nodes[:, s] < (1 << (level + 1)) - 1
                    gap = along[:, level] - np.where(live, splits[np.where(live, nodes[:, s], 0)], 0)
                    both = live & (np.abs(gap) < SPILL) & (budget[:, s] > 0)
                    side = (gap >= 0).astype(np.int64)
                    other = 2 * nodes[:, s] + 2 - side
                    nodes[:, s] = np.where(live, 2 * nodes[:, s] + 1 + side, nodes[:, s])
                    budget[:, s] -= both
                    for i in np.flatnonzero(both):
                        free = np.flatnonzero(nodes[i] < 0)[0]
                        nodes[i, free], budget[i, free] = other[i], budget[i, s]
            used = nodes >= 0
            out[:, t * SLOTS:(t + 1) * SLOTS] = np.where(used, nodes - len(splits) + t * (1 << 24), -1)
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # no overflow in the squares
    return wide / np.sqrt((wide ** 2).sum(axis=1, keepdims=True))


def grow(sample: list[tuple[int, np.ndarray]], counts: dict[int, int], seed: int = 11) -> Forest:
    """Trees over unit vectors (label, vector); counts are of all rows by label. A leaf
    of the sample keeps at least 8 rows, so larger tables have larger leaves."""
    rng = np.random.default_rng(seed)
    groups: dict[tuple[int, int], list[np.ndarray]] = {}
    for label, v in sample:
        groups.setdefault((label, len(v)), []).append(v)
    directions, splits = {}, {}
    for dim in sorted({d for _, d in groups}):
        lines = rng.normal(size=(TREES, 24, dim))
        directions[dim] = lines / np.sqrt((lines ** 2).sum(axis=2, keepdims=True))
    for (label, dim), rows in sorted(groups.items()):
        want = max(0, int(np.ceil(np.log2(max(1, counts.get(label, 0) / LEAF)))))
        depth = min(want, 24, max(0, int(np.log2(len(rows) / 8)) if len(rows) >= 16 else 0))
        if not depth:
            continue
        units = unit(np.stack(rows))
        splits[label, dim] = []
        for t in range(TREES):
            along = units @ directions[dim][t, :depth].T
            values, parts = [], [np.arange(len(units))]
            for level in range(depth):
                nxt = []
                for part in parts:
                    at = float(np.median(along[part, level])) if len(part) else 0.0
                    values.append(at)
                    nxt += [part[along[part, level] < at], part[along[part, level] >= at]]
                parts = nxt
            splits[label, dim].append(np.array(values))
    return Forest(directions, splits)


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vec (32-bit floats, null if it links with nothing) and its digest."""
    def run(batches):
        for batch in batches:
            vecs, digests = [], []
            for v, label in zip(batch.column("vec").to_pylist(), batch.column("label").to_pylist()):
                good = None
                if v and label is not None and None not in v:
                    a = np.array(v, np.float32)
                    good = a.tobytes() if np.isfinite(a).all() and a.any() else None
                vecs.append(good)
                digests.append(hashlib.blake2b(good, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vecs, pa.binary()),
                                              pa.array(digests, pa.binary())], ["vec_id", "label", "vec", "digest"])

    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vector_col).cast("array<float>").alias("vec"))
    return plain.mapInArrow(run, "vec_id long, label long, vec binary, digest binary")


def _fit(classes: DataFrame) -> Forest:
    counts = {r.label: r.n for r in classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > LEAF).orderBy(F.desc("n"), "label").limit(SAMPLE // 16).collect()}
    every = max(1, classes.count() // SAMPLE)
    rows = classes.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("vec_id", "label", "vec").collect()
    rows = [r for r in rows if r.label in counts]
    rows.sort(key=lambda r: r.vec_id)
    return grow([(r.label, np.frombuffer(r.vec, np.float32)) for r in rows], counts)


def first_shared(codes_a: np.ndarray, codes_b: np.ndarray) -> np.ndarray:
    """For each row, the lowest leaf number in both; all rows have one in common."""
    out = np.full(len(codes_a), np.iinfo(np.int32).max, np.int32)
    for t in range(TREES):
        own = slice(t * SLOTS, (t + 1) * SLOTS)
        for s in range(t * SLOTS, (t + 1) * SLOTS):
            if (codes_a[:, s] < 0).all():
                continue
            same = (codes_a[:, s, None] == codes_b[:, own]).any(axis=1) & (codes_a[:, s] >= 0)
            out[same] = np.minimum(out[same], codes_a[same, s])
    return out


def compare(ids: np.ndarray, units: np.ndarray, weights: np.ndarray, codes: np.ndarray, chunk: np.ndarray,
            leaf: int, low: int, high: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Within one leaf: for each vector the weight of its links counted here, and the
    smallest id it is united with. Of two different chunks only pairs across count."""
    n = len(ids)
    left, right = (np.arange(n),) * 2 if low == high else (np.flatnonzero(chunk == low), np.flatnonzero(chunk == high))
    linked = units[left] @ units[right].T >= least
    if low == high:
        np.fill_diagonal(linked, False)
    counted, root = np.zeros(n, np.int64), np.arange(n)
    a, b = np.nonzero(linked)
    a, b = left[a], right[b]
    for k in range(0, len(a), 1 << 18):
        x, y = a[k:k + (1 << 18)], b[k:k + (1 << 18)]
        first = first_shared(codes[x], codes[y]) == leaf
        np.add.at(counted, x[first], weights[y[first]])
        if low != high:
            np.add.at(counted, y[first], weights[x[first]])
    while len(a):  # smallest place over links until nothing changes
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (before == root).all():
            break
    return counted, ids[root]


def near_vectors(rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links (other vectors of the label with a cosine of
    ``least`` or more that share a leaf with it), component_id (smallest id reachable), kept.

    Null or zero vectors, vectors with null or non-finite numbers, and rows without
    label link with nothing; only vectors of one length are compared. Equal vectors are
    one class with a weight, and a repeated row is another vector. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embed-dedup")
    vectors = scratch.save(_vectors(rows, id_col, vector_col, label_col), "vectors")
    classes = scratch.save(vectors.where("digest is not null").groupBy("label", "digest", "vec")
                           .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight")), "classes")
    shared = spark.sparkContext.broadcast(_fit(classes))  # bounded by the sample

    def route(batches):
        for batch in batches:
            out = []
            labels, vecs = batch.column("label").to_numpy(), batch.column("vec").to_pylist()
            dims = np.array([len(v) for v in vecs]) // 4
            for key in sorted(set(zip(labels.tolist(), dims.tolist()))):
                at = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                units = unit(np.stack([np.frombuffer(vecs[i], np.float32) for i in at]))
                out += zip(at, shared.value.leaves(key[0], units))
            for i, codes in sorted(out, key=lambda x: x[0]):
                used = codes[codes >= 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[int(i)].as_py()] * len(used), t) for c, t in
                     (("vec_id", pa.int64()), ("label", pa.int64()), ("weight", pa.int64()), ("vec", pa.binary()))]
                    + [pa.array([int(dims[i])] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([codes.tobytes()] * len(used), pa.binary())],
                    ["vec_id", "label", "weight", "vec", "dim", "leaf", "codes"])

    routed = scratch.save(classes.select("vec_id", "label", "weight", "vec").mapInArrow(
        route, "vec_id long, label long, weight long, vec binary, dim int, leaf int, codes binary"), "routed")
    leaf = ["label", "dim", "leaf"]
    sizes = routed.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    placed = routed.join(sizes, leaf).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    group = [*leaf, "low", "high"]

    def done(key, part: list[tuple]) -> pa.RecordBatch:
        ids, weights = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        units = unit(np.stack([np.frombuffer(p[2], np.float32) for p in part]))
        codes = np.stack([np.frombuffer(p[3], np.int32) for p in part])
        counted, roots = compare(ids, units, weights, codes, np.array([p[4] for p in part]), key[2], key[3], key[4], least)
        use = (counted > 0) | (roots != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(roots[use]), pa.array(counted[use])], ["a", "b", "n"])

    def run(batches):
        now, part = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*group, "vec_id", "weight", "vec", "codes", "chunk")]
            for row in zip(*cols):
                if row[:5] != now and part:
                    yield done(now, part)
                    part = []
                now = row[:5]
                part.append(row[5:])
        if part:
            yield done(now, part)

    found = scratch.save(placed.repartition(*group).sortWithinPartitions(*group, "vec_id")
                         .select(*group, "vec_id", "weight", "vec", "codes", "chunk").mapInArrow(run, "a long, b long, n long"), "found")
    united = connected_components(found.select("a", "b"), scratch)
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    whole = (classes.select("label", "digest", F.col("vec_id").alias("rep"), "weight")
             .join(links.withColumnRenamed("a", "rep"), "rep", "left")
             .join(united.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.coalesce("component", "rep", "vec_id")
    return (vectors.select("vec_id", "label", "digest").join(whole, ["label", "digest"], "left")
            .select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
                    component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")))
