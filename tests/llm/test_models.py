"""Embedding dedup, quality and toxicity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedtriage.llm import embed_dedup, quality, toxicity

SMALL = "/root/testdata/sf0.01"


def vector_rows():
    rng = np.random.default_rng(1)
    rows = []
    for label in (1, 2):
        for _ in range(60):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                v = centre + rng.normal(scale=0.2, size=16)
                rows.append([len(rows), v.astype(np.float32).tolist(), label])
    n = len(rows)
    copies = [[n + i, rows[0][1], 1] for i in range(3)]
    odd = [[n + 10, None, 1], [n + 11, [0.0] * 16, 1], [n + 12, [float("nan")] * 16, 1], [n + 13, rows[0][1], None],
           [n + 14, [1.0, None] * 8, 1], [n + 15, [3e38] * 16, 1], [n + 16, [1.0, 2.0], 1], [n + 17, [], 1], [0, rows[0][1], 1]]
    return rows + copies + odd


@pytest.mark.parametrize("leaf,block", [(768, 2048), (64, 40)])
def test_vectors_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embed_dedup, "LEAF", leaf)  # 64: trees with several leaves
    monkeypatch.setattr(embed_dedup, "BLOCK", block)  # 40: leaves compared in blocks
    rows = vector_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vec string")
    out = embed_dedup.near_vectors(docs).collect()
    good = [r for r in rows if r[2] and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    v = embed_dedup.unit(np.array([r[1] for r in good]))
    linked = (v @ v.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good]))
    np.fill_diagonal(linked, False)
    want = {}
    for r, n in zip(good, linked.sum(axis=1)):
        want.setdefault(r[0], []).append(int(n))
    found = sum(r.n_links for r in out)
    assert len(out) == len(rows) and 0.97 * linked.sum() <= found <= linked.sum()
    assert all(r.n_links <= want.get(r.vec_id, [0])[0] for r in out)
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in out)
    if leaf > 700:  # one leaf: exact
        assert found == linked.sum()
    assert embed_dedup.near_vectors(docs.limit(0)).count() == 0


def test_machine_scores_pairs_in_linear_time():
    rng = np.random.default_rng(2)
    size = quality.BUCKETS + quality.BINS * len(quality.MEASURES)
    model = quality.Machine(np.zeros((len(quality.MEASURES), quality.BINS - 1)), 0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)))
    for text in ("", "a b c", "x y x\n\nLong WORDS!! here | there"):
        ids, values, starts = model.rows([text])
        pairs = sum(values[i] * values[j] * (model.factors[ids[i]] @ model.factors[ids[j]]) for i in range(len(ids)) for j in range(i))
        margin, _, _ = model.parts(ids, values, starts)
        assert margin[0] == pytest.approx(0.3 + (model.weights[ids] * values).sum() + pairs)


def edge_docs(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t", 5), (4, "w " * 120_000, 5), (4, "w", 5), (None, "some text", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def test_quality_on_held_out_rows(spark):
    docs, labels = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]
    out = quality.classify_quality(docs, labels)
    tested = out.join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.93
    model = quality.fit_quality(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(edge_docs(spark), model).collect())
    kept = quality.keep_good(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()
    none = labels.where("quality = 5")
    assert {r.score for r in quality.classify_quality(edge_docs(spark), none).collect()} == {0.5}
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]
    out = toxicity.classify_toxicity(docs, labels)
    tested = out.join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in tested]) > 0.92
    assert np.mean([r.predicted for r in tested if r.toxic == 0]) < 0.02
    assert np.mean([r.predicted for r in tested if r.toxic]) > 0.6
    scores = toxicity.classify_toxicity(edge_docs(spark), labels.where("toxic = 5")).collect()
    assert len(scores) == 6 and {r.score for r in scores} == {0.5}
    assert toxicity.classify_toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]
    from feedtriage.llm.labelled import held_out
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors)


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)

    def vector():
        terms = rng.choice(30, int(rng.integers(0, 6)), replace=False)
        w = rng.integers(1, 5, len(terms)).astype(float)
        return {int(t): float(x) for t, x in zip(terms, w / max(np.sqrt((w ** 2).sum()), 1e-9))}
    vectors = [vector() for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, 30)
    for _ in range(60):
        q = vector()
        scores = [(-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)]
        want = [(i, -s) for s, i in sorted(scores) if s < 0][:15]
        got = index.nearest(q, 15)
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
