"""A Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf. Leaves of one group stand in order; every eight consecutive nodes (the
last run may be shorter) have one parent, up to the group's root; the roots of the groups,
in order, are the leaves of one more tree.

A node's label is its place in post-order, as (last leaf below it, height). The forward sweep
goes through the labels in rising order: a queue ordered by label delivers the digests of
children to their parent, which so finds all of them at its turn. The reversed sweep goes
through the falling labels and delivers to each child the proof of its parent, to which it
adds its siblings.

The queue is external: a task sweeps a stretch of labels, ``8 ** HEIGHT`` nodes, and holds
only the messages within it. What goes to later stretches is written to the checkpoint
folder, keyed by label, and sorted by Spark for the next sweep, of which there are as many as
the logarithm of the largest group to the base ``8 ** HEIGHT``.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.operators.numbering import dense_index
from feedtriage.scratch import Scratch

#: Children of a node; height of the part of a tree that one stretch holds.
FANOUT, HEIGHT = 8, 3
STRETCH = FANOUT ** HEIGHT
_HEIGHTS = 32  # more than the height of any tree of long numbers


def parent_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def field_text(c: Column) -> Column:
    """``-`` for null, else the size in UTF-8 bytes, a colon, and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: str | Column) -> Column:
    texts = [field_text(F.col(c) if isinstance(c, str) else c) for c in fields]
    return F.unhex(F.sha2(F.concat(*texts), 256))


# --- one stretch of labels ------------------------------------------------------

def heights(n: int) -> int:
    """How far a sweep lifts a level of ``n`` nodes: to its root, or by HEIGHT."""
    h = 0
    while n > 1 and h < HEIGHT:
        n, h = -(-n // FANOUT), h + 1
    return h


def _label(h: int, i: int, n: int) -> int:
    """Place in post-order of node ``i`` at height ``h`` above a level of ``n`` nodes."""
    return (min((i + 1) * FANOUT ** h, n) - 1) * _HEIGHTS + h


def sweep_forward(digests: list[bytes], first: int, n: int) -> tuple[bytes, dict[int, list[bytes]]]:
    """The node above a stretch that begins with node ``first``, and the children of each
    inner node by label."""
    top, queue, families = heights(n), [], {}
    if not top:
        return digests[0], families
    for i, digest in enumerate(digests, first):
        heapq.heappush(queue, (_label(1, i // FANOUT, n), i, digest))
        while queue and queue[0][0] // _HEIGHTS <= i:
            label, children = queue[0][0], []
            while queue and queue[0][0] == label:
                _, at, child = heapq.heappop(queue)
                children.append(child)
            families[label] = children
            digest, h = parent_digest(children), label % _HEIGHTS
            if h == top:
                return digest, families
            at //= FANOUT
            heapq.heappush(queue, (_label(h + 1, at // FANOUT, n), at, digest))
    raise ValueError("a node of the stretch is missing")


def sweep_back(families: dict[int, list[bytes]], first: int, n: int, proof: bytes, steps: bytes) -> list[tuple[bytes, bytes]]:
    """(proof, steps) of each node of the stretch, from those of the node above it. A proof is
    the digests of the siblings, level by level from below; steps has two bytes a level, the
    node's place in its run and the run's size."""
    top = heights(n)
    if not top:
        return [(proof, steps)]
    out: dict[int, tuple[bytes, bytes]] = {}
    queue = [(-_label(top, first // FANOUT ** top, n), first // FANOUT ** top, proof, steps)]
    while queue:
        label, i, proof, steps = heapq.heappop(queue)
        h, children = -label % _HEIGHTS, families[-label]
        for slot in range(len(children)):
            own = b"".join(children[:slot] + children[slot + 1:]) + proof, bytes((slot, len(children))) + steps
            at = i * FANOUT + slot
            if h == 1:
                out[at] = own
            else:
                heapq.heappush(queue, (-_label(h - 1, at, n), at, *own))
    return [out[at] for at in sorted(out)]


def fold(leaf: bytes, proof: bytes, steps: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for slot, size in zip(steps[::2], steps[1::2]):
        siblings = [proof[at + 32 * k:at + 32 * k + 32] for k in range(size - 1)]
        leaf, at = parent_digest(siblings[:slot] + [leaf] + siblings[slot:]), at + 32 * (size - 1)
    return leaf


# --- sweeps over tables ---------------------------------------------------------

def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one stretch after the other; rows come sorted by it."""
    rows, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["stretch"]) != key:
                if rows:
                    yield rows
                rows, key = [], (row["tree"], row["stretch"])
            rows.append(row)
    if rows:
        yield rows


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    """Nodes dealt by stretch and sorted by label; a stretch has STRETCH nodes at most."""
    return (nodes.withColumn("stretch", F.floor(F.col("at") / STRETCH)).repartition("tree", "stretch")
            .sortWithinPartitions("tree", "stretch", *order))


def _forward(nodes: DataFrame) -> DataFrame:
    """The next level, STRETCH times smaller: tree, n, at, digest of the nodes above stretches."""
    schema = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        for rows in _stretches(batches):
            n, first = rows[0]["n"], rows[0]["at"]
            digest, _ = sweep_forward([r["digest"] for r in rows], first, n)
            above = {"tree": rows[0]["tree"], "n": -(-n // STRETCH), "at": first // STRETCH, "digest": digest}
            yield pa.RecordBatch.from_pylist([above], schema)

    return _dealt(nodes.select("tree", "n", "at", "digest"), "at").mapInArrow(run, "tree long, n long, at long, digest binary")


def _back(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """``nodes`` with proof, steps and subroot, from the messages (tree, at, proof, steps,
    subroot) to the nodes above their stretches. Other columns of nodes are kept."""
    extra = [f for f in nodes.schema if f.name not in ("tree", "n", "at")]
    queue = messages.select("tree", (F.col("at") * STRETCH).alias("at"), F.lit(0).alias("kind"), "proof", "steps", "subroot")
    queue = queue.unionByName(nodes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = ", ".join(["tree long", "at long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in extra], "proof binary, steps binary, subroot binary"])

    def run(batches):
        for rows in _stretches(batches):
            message, rows = rows[0], rows[1:]
            if message["kind"] or not rows or not rows[0]["kind"]:
                raise ValueError("a stretch needs one message")
            n, first = rows[0]["n"], rows[0]["at"]
            _, families = sweep_forward([r["digest"] for r in rows], first, n)
            paths = sweep_back(families, first, n, message["proof"], message["steps"])
            for row, (proof, steps) in zip(rows, paths, strict=True):
                row |= {"proof": proof, "steps": steps, "subroot": message["subroot"]}
            names = ["tree", "at", *[f.name for f in extra], "proof", "steps", "subroot"]
            yield pa.RecordBatch.from_pydict({k: [r[k] for r in rows] for k in names}, pa.schema([(k, kinds[k]) for k in names]))

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = {f.name: to_arrow_type(f.dataType) for f in extra}
    kinds |= {"tree": pa.int64(), "at": pa.int64(), "proof": pa.binary(), "steps": pa.binary(), "subroot": pa.binary()}
    return _dealt(queue, "kind", "at").mapInArrow(run, out)


def _ascend(nodes: DataFrame, largest: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels that lie STRETCH apart, the given one first; the last has one node a tree."""
    levels = [nodes]
    while largest > 1:
        levels.append(scratch.save(_forward(levels[-1]), f"{name}-{len(levels)}"))
        largest = -(-largest // STRETCH)
    return levels


def merkle_manifest(leaves: DataFrame, group_col: str, order_cols: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``leaves`` (which have a binary column ``leaf``, 32 bytes) with subroot, root,
    and proof and steps as in ``sweep_back``.

    Groups are ordered by ``group_col`` and leaves of a group by ``order_cols``, null first;
    leaves that tie are ordered by digest, and equal rows stand in any order. A lone leaf is
    its group's root, and a lone group's root is the root. Columns named tree, n, at, digest,
    kind, stretch, proof, steps, subroot and root are the operator's own. No rows give none.
    """
    scratch = scratch or Scratch(leaves.sparkSession, "merkle")
    own = ["tree", "n", "at", "digest", "kind", "stretch", "proof", "steps", "subroot", "root"]
    leaves = scratch.save(leaves.drop(*own).withColumn("_row", F.monotonically_increasing_id()), "leaves")
    asc = [F.col(c).asc_nulls_first() for c in (group_col, *order_cols, "leaf", "_row")]
    placed = scratch.save(dense_index(leaves, asc, "_at", scratch).drop("_row"), "placed")
    groups = placed.groupBy(group_col).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    groups = scratch.save(dense_index(groups, [F.col("_first")], "tree", scratch), "groups", largest=F.max("n"))
    result = leaves.drop("_row").withColumns({k: F.lit(None).cast("binary") for k in ("proof", "steps", "subroot", "root")})
    if not groups.n_rows:
        return result
    largest, trees = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    named = groups.withColumnRenamed(group_col, "_group")
    nodes = (placed.join(named, F.col(group_col).eqNullSafe(F.col("_group")))
             .withColumn("at", F.col("_at") - F.col("_first")).withColumn("digest", F.col("leaf")).drop("_at", "_first", "_group"))
    levels = _ascend(nodes, largest, scratch, "level")
    # the roots of the groups are the leaves of one tree
    tops = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("at"), "digest")
    uppers = _ascend(tops, trees, scratch, "upper")
    root = uppers[-1].select("digest").first()[0]
    nothing = F.lit(b"")
    down = uppers[-1].select("tree", "at", nothing.alias("proof"), nothing.alias("steps"), F.lit(None).cast("binary").alias("subroot"))
    for level in reversed(uppers[:-1]):
        down = scratch.save(_back(level, down), "upper-proofs")
    if len(uppers) == 1:
        down = down.withColumn("digest", F.lit(bytes(root)))
    down = down.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", "steps", F.col("digest").alias("subroot"))
    for k in reversed(range(1, len(levels) - 1)):
        down = scratch.save(_back(levels[k], down), f"proofs-{k}")
    if len(levels) == 1:
        out = nodes.drop("n", "digest").join(down.drop("at"), "tree")
    else:
        out = _back(levels[0], down)
    return out.withColumn("root", F.lit(bytes(root))).select(*result.columns)


def check_proofs(proven: DataFrame, id_col: str, claimed_col: str) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, as hex text, and verified: the leaf
    in ``claimed_col``, or the true one where that is null, leads to the root by the proof."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = proven.schema[id_col].dataType
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([(id_col, to_arrow_type(kind)), *[(c, pa.string()) for c in names], ("verified", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                folded = fold(r["_claimed"] or r["leaf"], r["proof"], r["steps"])
                proof = hashlib.sha256(r["proof"].hex().encode()).hexdigest()
                rows.append((r["_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), proof, folded.hex(), folded == r["root"]))
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))) if rows else {c: [] for c in schema.names}, schema)

    rows = proven.select(F.col(id_col).alias("_id"), F.col(claimed_col).alias("_claimed"), "leaf", "subroot", "root", "proof", "steps")
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {kind.simpleString()}", *[f"{c} string" for c in names], "verified boolean"]))
