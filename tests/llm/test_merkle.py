"""The Merkle manifest against a tree built by lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedtriage.llm import merkle


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root, and of each leaf its siblings level by level as (place, siblings)."""
    proofs, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[k:k + 8], own[k:k + 8]) for k in range(0, len(nodes), 8)]
        for run, below in runs:
            for s, leaves in enumerate(below):
                for i in leaves:
                    proofs[i].append((s, run[:s] + run[s + 1:]))
        nodes, own = [digest(run) for run, _ in runs], [sum(below, []) for _, below in runs]
    return nodes[0], proofs


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def wanted(rows, tampered):
    """rows (doc_id, lang, text); tampered gives the text that is claimed, or None."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    leaf = lambda r, text: digest([field(r[0]), field(r[1]), field(text)])
    if not rows:
        return []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r, r[2]))))
    subs = [tree([leaf(r, r[2]) for r in groups[g]]) for g in order]
    root, tops = tree([s for s, _ in subs])
    out = []
    for g, (sub, proofs), top in zip(order, subs, tops):
        for r, proof in zip(groups[g], proofs):
            claimed = tampered(r)
            x = leaf(r, r[2] if claimed is None else claimed)
            for s, siblings in proof + top:
                x = digest(siblings[:s] + [x] + siblings[s:])
            out.append((r[0], leaf(r, r[2]), sub, root, digest([h for _, hs in proof + top for h in hs]), x, x == root))
    return out


def run(spark, rows, change):
    df = spark.createDataFrame([(*r, "a", 7) for r in rows], "doc_id long, lang string, text string, leaf string, n int")
    df = df.withColumn("claimed", F.when(change(F.col("doc_id")), merkle.leaf_digest("doc_id", "lang", F.concat("text", F.lit("!")))))
    df = df.withColumn("leaf", merkle.leaf_digest("doc_id", "lang", "text"))
    return [tuple(r) for r in merkle.check_proofs(merkle.merkle_manifest(df, "lang", ["doc_id"]), "doc_id", "claimed").collect()]


KEY = lambda r: tuple(str(x) for x in r)


def test_manifest_equals_a_tree_of_lists(spark):
    rng = random.Random(5)
    sizes = {"en": 1100, "de": 64, "fr": 9, "es": 1, None: 8, "": 2, "é": 513, **{f"x{i}": 1 for i in range(70)}}
    rows = [(rng.randrange(10 ** 6), lang, f"text {i}") for lang, n in sizes.items() for i in range(n)]
    rows += [(None, "en", "no id"), (5, "en", None), (6, "en", ""), (7, "en", "x" * 100_000), (8, "en", "tie b"), (8, "en", "tie a"), (9, "de", "twice"), (9, "de", "twice")]
    got = run(spark, rows, lambda c: c % 5 == 0)
    want = wanted(rows, lambda r: r[2] + "!" if r[0] is not None and r[0] % 5 == 0 and r[2] is not None else None)
    # rows that are equal in all but their place have each other's proofs
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "en", "alone")], [(1, None, None), (2, None, None)], [(i, "en", "t") for i in range(600)]])
def test_small_manifests(spark, rows):
    got = run(spark, rows, lambda c: F.lit(False))
    assert sorted(got, key=KEY) == sorted(wanted(rows, lambda r: None), key=KEY)
    assert all(r[6] for r in got)


def test_one_language_in_most_rows_is_dealt_to_many_tasks(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), merkle.leaf_digest("id").alias("leaf"))
    nodes = df.select(F.lit(0).alias("tree"), F.lit(8000).alias("n"), F.col("doc_id").alias("at"))
    stretches = merkle._dealt(nodes, "at").groupBy("tree", "stretch").count()
    assert stretches.agg(F.max("count")).first()[0] <= merkle.STRETCH


def test_the_sweep_holds_few_messages():
    """Children wait for at most one parent at each height."""
    most, push = 0, merkle.heapq.heappush

    def counted(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    merkle.heapq.heappush = counted
    try:
        merkle.sweep_forward([bytes(32)] * 512, 512, 5000)
    finally:
        merkle.heapq.heappush = push
    assert most <= merkle.FANOUT * merkle.HEIGHT
