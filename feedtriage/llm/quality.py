"""Quality classifier: a factorisation machine over words and structure.

Inputs are hashed words (log counts, scaled to length one) and binned measures of the
text's structure and length; labels, language, source and id are no inputs. Every pair
of inputs interacts through the product of two short vectors, and all pairs together
are scored in linear time: half of (square of the sum - sum of the squares).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm.batches import FEWER_CHARS, text_batches
from feedtriage.llm.labelled import held_out, labelled_sample

BUCKETS, BINS, RANK = 4096, 8, 6
#: Labelled rows that are learned from; twice as many at most.
TRAINING_ROWS = 4_000
MEASURES = ["chars", "word_chars", "distinct", "upper", "punctuation", "symbols", "digits", "white",
            "repeats", "repeated_lines", "line_chars", "top_word", "short_words", "upper_words", "ragged_words"]
_UPPER = bytes(range(65, 91))
_PUNCTUATION = b".,;:!?'\"()-"
_SYMBOLS = b"#$%&*|!+=<>@^~_\\/{}[]"
_RAGGED = re.compile(r"[^\w\s]{2,}$|^[^\w\s]{2,}")


def measures(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares are of characters, words or lines; an empty text has all zeros."""
    if not words:
        return [0.0] * len(MEASURES)
    data, n = text.encode(), len(words)
    share = lambda chars: 1 - len(data.translate(None, chars)) / len(data)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ragged = sum(c for w, c in counts.items() if not w.isalnum() and _RAGGED.search(w))
    return [np.log1p(len(text)), (len(text) - n) / n, len(counts) / n, share(_UPPER), share(_PUNCTUATION),
            share(_SYMBOLS), share(b"0123456789"), share(b" \t\n\r"), repeats / n, 1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(len(text) / max(len(lines), 1)), max(counts.values()) / n,
            sum(c for w, c in counts.items() if len(w) < 3) / n, upper / n, ragged / n]


def raw_inputs(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets with their values, and the measures, of a whole text."""
    words = text.split()
    counts = Counter(words)
    sums: dict[int, int] = {}
    for word, n in counts.items():
        b = zlib.crc32(word.lower().encode()) % BUCKETS
        sums[b] = sums.get(b, 0) + n
    values = np.log1p(np.fromiter(sums.values(), float, len(sums)))
    values /= max(np.sqrt((values ** 2).sum()), 1e-9)
    return np.fromiter(sums.keys(), np.int64, len(sums)), values, measures(text, words, counts)


@dataclass
class Machine:
    """score = sigmoid(bias + linear + interactions)."""
    cuts: np.ndarray  # per measure, the borders of its bins
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input numbers, their values, and where each text's inputs begin."""
        raw = [raw_inputs(t) for t in texts]
        stats = np.array([m for _, _, m in raw])
        bins = (stats[:, :, None] > self.cuts[None]).sum(axis=2) + BUCKETS + BINS * np.arange(len(MEASURES))
        ids = [np.concatenate([b, s]) for (b, _, _), s in zip(raw, bins)]
        values = [np.concatenate([v, np.full(len(MEASURES), 0.5)]) for _, v, _ in raw]
        return np.concatenate(ids), np.concatenate(values), np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])

    def parts(self, ids, values, starts):
        scaled = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(scaled, starts)
        pairs = 0.5 * (sums ** 2 - np.add.reduceat(scaled ** 2, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[ids] * values, starts) + pairs, scaled, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        margin, _, _ = self.parts(*self.rows(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], y: np.ndarray, rounds: int = 6,
          rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
    """Learn by adaptive gradient steps on the log loss, in an order fixed by ``seed``.
    Without rows of both labels the machine gives their mean, or 0.5 without any."""
    size = BUCKETS + BINS * len(MEASURES)
    rng = np.random.default_rng(seed)
    stats = np.array([m for _, _, m in rows]).reshape(-1, len(MEASURES))
    cuts = (np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(rows) else np.zeros((len(MEASURES), BINS - 1)))
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Machine(cuts, float(np.log(mean / (1 - mean))), np.zeros(size), np.zeros((size, RANK)))
    if len(set(y.tolist())) < 2:
        return model
    model.factors = rng.normal(0, 0.05, (size, RANK))
    bins = (stats[:, :, None] > cuts[None]).sum(axis=2) + BUCKETS + BINS * np.arange(len(MEASURES))
    ids = [np.concatenate([b, s]) for (b, _, _), s in zip(rows, bins)]
    values = [np.concatenate([v, np.full(len(MEASURES), 0.5)]) for _, v, _ in rows]
    seen_w, seen_v = np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            sizes = np.array([len(ids[i]) for i in part])
            i, v = np.concatenate([ids[j] for j in part]), np.concatenate([values[j] for j in part])
            margin, scaled, sums = model.parts(i, v, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part])
            row = np.repeat(np.arange(len(part)), sizes)
            own, place = np.unique(i, return_inverse=True)
            gw = np.bincount(place, slope[row] * v) / len(part) + decay * model.weights[own]
            each = (slope[row] * v)[:, None] * (sums[row] - scaled)
            gv = np.stack([np.bincount(place, each[:, f]) for f in range(RANK)], axis=1) / len(part) + decay * model.factors[own]
            seen_w[own] += gw ** 2
            seen_v[own] += gv ** 2
            model.weights[own] -= rate * gw / np.sqrt(seen_w[own])
            model.factors[own] -= 0.5 * rate * gv / np.sqrt(seen_v[own])
            model.bias -= rate * slope.mean() * 0.1
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2,
                training_rows: int = TRAINING_ROWS) -> Machine:
    """Inputs are made where the texts are; those of at most 2 * ``training_rows`` rows,
    of which each has at most BUCKETS + measures numbers, come to the driver."""
    sample = labelled_sample(docs, labels, "quality", parts, part, training_rows)

    def run(batches):
        for batch, texts in text_batches(batches, "text", FEWER_CHARS):
            raw = [raw_inputs(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([r[0].astype("<i4").tobytes() for r in raw]),
                 pa.array([r[1].astype("<f4").tobytes() for r in raw]), pa.array([r[2] for r in raw], pa.list_(pa.float64()))],
                ["doc_id", "y", "ids", "amounts", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, y int, ids binary, amounts binary, stats array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.ids), bytes(r.amounts)))  # the same model whatever the tasks' order
    rows = [(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.amounts, "<f4").astype(float), r.stats) for r in got]
    return train(rows, np.array([float(r.y > 0) for r in got]))


def quality_scores(docs: DataFrame, model: Machine, keep_text: bool = False) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of each row of ``docs``, of its whole
    text; null text is empty, and an empty text has the score of its measures."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_batches(batches, "text", FEWER_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(texts))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Machine, least: float) -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more, in all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_batches(batches, "text", FEWER_CHARS):
            yield batch.filter(pa.array(shared.value.scores(texts) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; repeated rows stay."""
    scored = quality_scores(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))
