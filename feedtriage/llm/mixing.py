"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked until their margins meet
the targets, no cell giving more tokens than it has; a document is then drawn with its
cell's probability, by a hash of its id. Cells are formed of the values that the targets
name, so there are at most as many as the product of the targets' lengths, whatever the
table's size; they come to the driver, documents don't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

FACETS = ["source", "lang", "topic"]
#: Values that a facet's target doesn't name; they keep their share.
OTHER = "(other)"
SWEEPS = 60


@dataclass(frozen=True)
class Targets:
    """Weights by value for each facet, and the share of all tokens to draw."""
    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    rate: float = 0.5


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column, n_tokens: Column) -> Column:
    """What a text is about, as far as its form tells: license terms, tables, brief, long or other prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(t, F.lit("License")), "legal").when(F.contains(t, F.lit(" | ")), "table")
            .when(n_tokens < 100, "brief").when(n_tokens > 1000, "long").otherwise("prose"))


def faceted(docs: DataFrame, targets: Targets) -> DataFrame:
    """doc_id, tokens, and each facet's value, or OTHER for null and unnamed values."""
    rows = docs.select("doc_id", "source", "lang", "text", tokens(F.col("text")).alias("tokens"))
    rows = rows.withColumn("topic", topic(F.col("text"), F.col("tokens")))
    named = [F.when(F.col(f).isin(sorted(getattr(targets, f))), F.col(f)).otherwise(OTHER).alias(f) for f in FACETS]
    return rows.select("doc_id", "tokens", *named)


def rake(cells: list[tuple[tuple[str, str, str], float]], targets: Targets, sweeps: int = SWEEPS) -> dict[tuple[str, str, str], float]:
    """Tokens to draw from each cell. A margin's targets are scaled to the values present;
    OTHER keeps its share of all tokens. A cell gives at most what it has."""
    return {key: drawn for key, (drawn, *_) in raked(cells, targets, sweeps).items()}


def raked(cells: list[tuple[tuple[str, str, str], float]], targets: Targets,
          sweeps: int = SWEEPS) -> dict[tuple[str, str, str], tuple[float | None, ...]]:
    """Tokens to draw from each cell, and for each facet how much of the goal of the cell's
    value all its cells together reach: 1 where the target is met, less where these or other
    cells have too few tokens for it; None without a goal."""
    cells = sorted(cells)
    have = np.array([n for _, n in cells], float)
    total = have.sum()
    if not total:
        return {key: (0.0, None, None, None) for key, _ in cells}
    goals, places = [], []
    for f, name in enumerate(FACETS):
        values = sorted({key[f] for key, _ in cells})
        place = np.array([values.index(key[f]) for key, _ in cells])
        held = np.bincount(place, have, len(values))
        wanted = np.array([getattr(targets, name).get(v, 0.0) for v in values])
        wanted[held == 0] = 0
        other = np.array([v == OTHER for v in values])
        rest = held[other].sum() / total
        share = wanted * (1 - rest) / wanted.sum() if wanted.sum() else held / total
        goals.append(np.where(other, held / total, share) * targets.rate * total)
        places.append(place)
    drawn = have * targets.rate
    for _ in range(sweeps):
        for goal, place in zip(goals, places):
            held = np.bincount(place, drawn, len(goal))
            drawn = drawn * np.where(held > 0, goal / np.where(held > 0, held, 1), 0)[place]
        drawn = np.minimum(drawn, have)
    reached = [(np.bincount(place, drawn, len(goal))[place], goal[place]) for goal, place in zip(goals, places)]
    return {key: (float(drawn[i]), *(float(r[i] / g[i]) if g[i] > 0 else None for r, g in reached))
            for i, (key, _) in enumerate(cells)}


def share_of_one(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 that is fixed by the id and the seed."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, targets: Targets, seed: str = "mix") -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, selected of each row of ``docs``,
    and source_reached, lang_reached, topic_reached: the part of the target that all rows of
    the row's value are expected to give. Targets that the tables cannot give show there.

    Rows without tokens follow their cell; a cell without tokens has probability 0.
    Repeated rows share one draw, as the draw depends on the id. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = faceted(docs, targets)
    cells = [(tuple(r[f] for f in FACETS), float(r["n"]))
             for r in rows.groupBy(*FACETS).agg(F.sum("tokens").alias("n")).collect()]
    drawn = raked(cells, targets)
    reached = [f"{f}_reached" for f in FACETS]
    table = docs.sparkSession.createDataFrame(
        [(*key, drawn[key][0] / n if n else 0.0, *drawn[key][1:]) for key, n in cells],
        "source string, lang string, topic string, probability double, " + ", ".join(f"{r} double" for r in reached))
    out = rows.join(F.broadcast(table), FACETS)
    return out.select("doc_id", *FACETS, "tokens", "probability",
                      (share_of_one(F.col("doc_id"), seed) < F.col("probability")).alias("selected"), *reached)


def selected(docs: DataFrame, targets: Targets, seed: str = "mix") -> DataFrame:
    """The drawn rows of ``docs``, in all their columns."""
    rows = faceted(docs, targets)
    cells = [(tuple(r[f] for f in FACETS), float(r["n"]))
             for r in rows.groupBy(*FACETS).agg(F.sum("tokens").alias("n")).collect()]
    drawn = rake(cells, targets)
    probability = F.create_map(*[F.lit(x) for key, n in cells for x in ("\0".join(key), drawn[key] / n if n else 0.0)]) if cells else None
    if probability is None:
        return docs
    n = tokens(F.col("text"))
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"), n)}
    key = F.concat_ws("\0", *[F.when(value[f].isin(sorted(getattr(targets, f))), value[f]).otherwise(OTHER) for f in FACETS])
    return docs.where(share_of_one(F.col("doc_id"), seed) < F.element_at(probability, key))
