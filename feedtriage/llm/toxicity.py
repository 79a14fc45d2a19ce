"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings that the labelled examples associate with
toxicity. Their document frequencies are counted over all documents. The examples lie
in an inverted index whose blocks carry, per term, the largest weight in the block: the
weighted sum of these bounds the cosine of every example of a block, and blocks are
opened from the highest bound down until no bound exceeds the k-th best cosine. That
gives the exact nearest examples, whose votes count by their cosine; a logistic curve,
fitted on labelled rows outside the index, turns votes into scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm.batches import text_batches
from feedtriage.llm.labelled import held_out, labelled_sample

#: Labelled rows that are learned from (twice as many at most), terms, neighbours, block size.
TRAINING_ROWS, TERMS, NEAREST, BLOCK = 12_000, 800, 15, 64
#: A term must be so many times as frequent in toxic examples, with a likelihood ratio
#: that chance gives to about one term in a million.
LIFT, LEAST_GAIN = 6, 24.0
#: Beginnings of these lengths are terms beside whole words, marked by a star.
STEMS, DENSE = (4, 5, 6, 7), 80
WORD = re.compile(r"[^\W\d_]+")


def term_counts(text: str, vocabulary: dict[str, int] | None = None) -> Counter:
    """Counts of the words and word beginnings of a whole text, of those in ``vocabulary``.

    A beginning that chance also gives to clean texts tells more when it is repeated or
    dense, so with two or more words, four or more, and one word in DENSE it counts as
    a further term each."""
    words = Counter(WORD.findall(text.lower()))
    stems: Counter = Counter()
    for word, n in words.items():
        for k in STEMS:
            if len(word) <= k:
                break
            stems[word[:k]] += n
    known = words.keys() if vocabulary is None else words.keys() & vocabulary.keys()
    terms = Counter({w: words[w] for w in known})
    total = words.total()
    for stem, n in stems.items():
        for mark, holds in (("*", True), ("*2", n >= 2), ("*4", n >= 4), ("*d", n >= 2 and n * DENSE >= total)):
            if holds and (vocabulary is None or stem + mark in vocabulary):
                terms[stem + mark] += n
    return terms


class BlockMaxIndex:
    """Unit vectors in an inverted index by block, searched for exact nearest ones."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        # Examples with the same strongest term lie together, so that bounds differ by block.
        lead = [max(v, key=lambda t: (v[t], -t)) if v else -1 for v in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), np.int64)
        self.n_blocks = -(-len(vectors) // BLOCK)
        self.bounds = np.zeros((n_terms, self.n_blocks), np.float64)
        postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for place, i in enumerate(self.order):
            for t, w in vectors[i].items():
                b = place // BLOCK
                postings.setdefault((b, t), []).append((place % BLOCK, w))
                self.bounds[t, b] = max(self.bounds[t, b], w)
        self.postings = {k: (np.array([p for p, _ in v]), np.array([w for _, w in v])) for k, v in postings.items()}

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The k examples of the highest positive cosine as (number, cosine); of equal
        cosines the lower numbers."""
        if not query or not self.n_blocks:
            return []
        terms, weights = np.array(list(query)), np.array(list(query.values()))
        bounds = weights @ self.bounds[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            # A hair's breadth more than the bound, for another order of summation.
            if bounds[b] <= 0 or (len(best) == k and bounds[b] + 1e-9 < -best[-1][0]):
                break
            scores = np.zeros(BLOCK)
            for t, w in query.items():
                hit = self.postings.get((int(b), t))
                if hit:
                    scores[hit[0]] += w * hit[1]
            for p in np.flatnonzero(scores):
                best.append((-round(float(scores[p]), 12), int(self.order[b * BLOCK + p])))
            best = sorted(best)[:k]
        return [(i, -s) for s, i in best]


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list  # doc ids of the indexed examples
    labels: np.ndarray
    curve: tuple[float, float]

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        raw = {self.vocabulary[t]: (1 + np.log(n)) * self.idf[self.vocabulary[t]] for t, n in sorted(counts.items())}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if raw else {}

    def vote(self, near: list[tuple[int, float]]) -> float:
        """From -1 to 1; the nearer an example, the more it counts. 0 without neighbours."""
        weights = np.array([s * s for _, s in near])
        signs = np.array([2 * self.labels[i] - 1 for i, _ in near])
        return float((weights * signs).sum() / (weights.sum() + 0.05)) if near else 0.0

    def judge(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        near = self.index.nearest(self.vector(term_counts(text, self.vocabulary)), NEAREST)
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.vote(near) + b, -30, 30)))), near


def _curve(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps; a weak pull to slope 4
    keeps it finite where the votes separate the labels."""
    a, b = 4.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * votes + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * votes).sum() + 0.5 * (a - 4), (p - y).sum() + 0.05 * b])
        hess = np.array([[(w * votes ** 2).sum() + 0.5, (w * votes).sum()], [(w * votes).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _terms(sample: DataFrame) -> list[str]:
    """The terms most associated with toxic examples, counted by document in Spark."""
    def run(batches):
        for batch, texts in text_batches(batches, "text"):
            bad, good = Counter(), Counter()
            for text, y in zip(texts, batch.column("y").to_pylist()):
                (bad if y > 0 else good).update(term_counts(text).keys())
            terms = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())],
                ["term", "bad", "good"])

    totals = sample.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = totals.bad or 0, totals.n - (totals.bad or 0)
    if not bad or not good:
        return []
    counted = sample.mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # The likelihood ratio of the term being more frequent in toxic examples than in others.
    n, total = F.col("bad") + F.col("good"), bad + good
    ratio = lambda k, size: F.when(k > 0, k * F.log(k * total / (n * size))).otherwise(0.0)
    gain = 2 * (ratio(F.col("bad"), bad) + ratio(F.col("good"), good))
    often = (F.col("bad") * good > LIFT * F.col("good") * bad)
    top = (counted.withColumn("gain", gain).where(often & (F.col("gain") >= LEAST_GAIN))
           .orderBy(F.desc("gain"), "term").limit(TERMS).select("term").collect())
    return [r.term for r in top]


def fit_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1,
                 training_rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Learn from a bounded sample of labelled rows that are not held out. Document
    frequencies are of all rows of ``docs``. Without examples of both labels there are no
    terms, and every score is the share of toxic examples (0.5 without examples)."""
    sample = labelled_sample(docs, labels, "toxic", parts, part, training_rows)
    # Copies of one example would make all its words look telling.
    sample = sample.withColumn("same", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["same", "y"]).drop("same")
    vocabulary = {t: i for i, t in enumerate(_terms(sample))}

    def frequencies(batches):
        for batch, texts in text_batches(batches, "text"):
            seen: Counter = Counter()
            for text in texts:
                seen.update(term_counts(text, vocabulary).keys())
            yield pa.RecordBatch.from_arrays([pa.array(["", *seen]), pa.array([len(texts), *seen.values()], pa.int64())], ["term", "n"])

    rows = (docs.select("text").mapInArrow(frequencies, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # TERMS + 1 rows at most
    counts = {r.term: r.n for r in rows}
    idf = np.array([np.log((1 + counts.get("", 0)) / (1 + counts.get(t, 0))) + 1 for t in vocabulary])

    def vectors(batches):
        for batch, texts in text_batches(batches, "text"):
            found = [term_counts(t, vocabulary) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([list(c) for c in found], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "y", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(vectors, f"doc_id {kind}, y int, terms array<string>, counts array<int>").collect()
    got.sort(key=lambda r: (r.doc_id, r.terms))
    test = [r for i, r in enumerate(got) if i % 5 == 4]
    kept = [r for i, r in enumerate(got) if i % 5 != 4 and r.terms]
    labels_of = np.array([int(r.y > 0) for r in kept])
    model = ToxicityModel(vocabulary, idf, BlockMaxIndex([], len(vocabulary)), [r.doc_id for r in kept], labels_of, (4.0, -1.0))
    model.index = BlockMaxIndex([model.vector(dict(zip(r.terms, r.counts))) for r in kept], len(vocabulary))
    y = np.array([float(r.y > 0) for r in test or got])
    if not vocabulary or not len(y):
        mean = float(np.clip(np.mean([r.y > 0 for r in got]), 1e-3, 1 - 1e-3)) if got else 0.5
        model.curve = 1.0, float(np.log(mean / (1 - mean)))
        return model
    votes = np.array([model.vote(model.index.nearest(model.vector(dict(zip(r.terms, r.counts))), NEAREST)) for r in test or got])
    model.curve = _curve(votes, y)
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, evidence: int = 3) -> DataFrame:
    """doc_id, score (0 to 1, higher is more toxic), and the nearest examples' ids and
    cosines, of each row of ``docs``, of its whole text; null text is empty, and a text
    without any term has the score of no neighbours."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch, texts in text_batches(batches, "text"):
            found = [model.judge(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()),
                 pa.array([[model.ids[i] for i, _ in near[:evidence]] for _, near in found], pa.list_(batch.schema.field("doc_id").type)),
                 pa.array([[s for _, s in near[:evidence]] for _, near in found], pa.list_(pa.float64()))],
                ["doc_id", "score", "near_ids", "near_cosines"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, near_ids array<{kind}>, near_cosines array<double>")


def classify_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, near_ids, near_cosines of each row; repeated rows stay."""
    scored = toxicity_scores(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"), "near_ids", "near_cosines")
