"""Line dedup: of equal and nearly equal lines of all documents, one stays.

1. Every line of MIN_CHARS or more gets two 64-bit hashes; lines with equal hashes are
   one distinct line, with its first document (the smallest id).
2. Longer lines emit the keys of the segment-partition edit join: their own segments and
   those of their substrings that lines of fitting length may own, and runs of words of
   which lines share one whose edits of words are few for their length. Lines that share
   a key form clusters. Keys are shuffled in blocks, packed by tasks.
3. Large clusters are parted by sketches of their lines' words. Clusters are joined by that edit
   join, at most two chunks at a time, and verified.
4. The distinct lines of a component are one class. Its lines stay in the smallest
   document that holds one, the first time there, and go from all other places.

Text is shuffled for the lines of clusters and once to rebuild the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm import edit_join
from feedtriage.llm.batches import FEWER_CHARS, text_batches
from feedtriage.llm.components import connected_components
from feedtriage.llm.key_links import id_bits, key_links, maybe_held, runs as _runs
from feedtriage.llm.ngram_join import joined
from feedtriage.scratch import Scratch

#: Shorter lines always stay: short sentences recur in clean texts.
MIN_CHARS = 20
#: Characters of lines whose keys make one block, about 50,000 keys of prose; several go to one task.
BLOCK_CHARS = 2_000_000
#: Keys that a task combines before it sends them.
HELD = 500_000
#: Lines of which a task knows that their keys are out; then it forgets them all.
SEEN = 500_000
#: Clusters of more lines are parted before lines are compared, with so many of the lines to a block.
LARGE, BLOCK_LINES = 200, 5_000


def line_hash(line: str) -> int:
    """The hash that ``xxhash64`` gives the string in Spark."""
    return xxhash.xxh64_intdigest(line, seed=42)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, h1, h2 of the lines that take part."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")
    rows = docs.where("doc_id is not null").select("doc_id", line).where(F.length("line") >= MIN_CHARS)
    return rows.select("doc_id", "line", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))


def _keys_of(texts: list[str], seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines that are not in ``seen``, which grows by their hashes, each beside the line's hash."""
    lines = {line_hash(x): x for x in {x for t in texts for x in t.split("\n") if len(x) >= edit_join.SHORTEST}}
    lines = {h: x for h, x in lines.items() if h not in seen}
    seen.update(lines)
    if len(seen) > SEEN:
        seen.clear()
    places, keys = edit_join.keys_of(list(lines.values()))
    return keys, _signed(list(lines))[places]


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are in ``ordered``, which is not sorted again for each batch as np.isin does."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _clusters(docs: DataFrame, chars: int, scratch: Scratch) -> DataFrame:
    """(doc_id, cluster): doc_id is the hash of a line that shares a key with another. The
    characters of all lines, ``chars``, give the number of blocks of keys."""
    def find(batches):
        seen = set()
        for _, texts in text_batches(batches, "text", FEWER_CHARS):
            yield _keys_of(texts, seen)

    links = key_links(docs.select("text"), find, 1 + chars // BLOCK_CHARS, HELD)
    return connected_components(links, scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def _near_lines(docs: DataFrame, chars: int, scratch: Scratch) -> DataFrame:
    """(node, component): hashes of lines, united by verified edits."""
    clusters = scratch.save(_clusters(docs, chars, scratch), "clusters")
    shared = docs.sparkSession.sparkContext.broadcast(id_bits(clusters, "doc_id"))

    def run(batches):
        table = shared.value
        for _, texts in text_batches(batches, "text", FEWER_CHARS):
            lines = list({x for t in texts for x in t.split("\n") if len(x) >= edit_join.SHORTEST})
            ids = np.fromiter(map(line_hash, lines), np.uint64, len(lines)).view(np.int64)
            kept = np.flatnonzero(maybe_held(table, ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array([lines[i] for i in kept.tolist()], pa.string())],
                                             ["doc_id", "text"])

    lines = docs.select("text").mapInArrow(run, "doc_id long, text string")
    lines = lines.join(clusters.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.lit(1).alias("one"))
    lines = scratch.save(lines.select("doc_id", "text"), "lines")
    parts = _parted(lines, clusters, scratch)
    links = joined(lines, parts, lambda chunk: np.array(edit_join.join(chunk)), scratch)
    for old in (clusters, lines, parts):
        scratch.drop(old)
    return connected_components(links, scratch)


def _parted(lines: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``clusters`` (doc_id, cluster) with the large ones parted: there only lines that share a
    key and whose words are few enough apart, by their sketches, are linked. Lines of different parts
    can't join, and lines without such a link are in no part. So the work on a cluster that
    many lines of different texts make up by chance does not grow with its square."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("cluster")
    large = scratch.save(clusters.join(sizes, "cluster", "left_semi"), "large")
    if not large.n_rows:
        return clusters
    blocks = 1 + large.n_rows // BLOCK_LINES

    def sketched(batches):
        for batch, texts in text_batches(batches, "text", FEWER_CHARS):
            places, keys = edit_join.keys_of(texts)
            order = np.lexsort((keys, places))
            places, keys = places[order], keys[order]
            new = np.append(True, (places[1:] != places[:-1]) | (keys[1:] != keys[:-1]))[:len(keys)]
            places, keys = places[new], keys[new]
            n_words, bits = edit_join.sketches([t.split() for t in texts])
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys % np.uint64(blocks)).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(ids[places]),
                 pa.array(n_words[places]), pa.array([bits[i].tobytes() for i in places.tolist()], pa.binary())],
                ["block", "key", "id", "n_words", "bits"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, ids, n_words = (table.column(c).to_numpy() for c in ("key", "id", "n_words"))
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends, found = np.append(starts[1:], len(keys)), []
        for start, end in zip(starts.tolist(), ends.tolist()):
            if end - start > 1:
                bits = np.frombuffer(b"".join(table.column("bits").slice(start, end - start).to_pylist()), np.uint64)
                roots = edit_join.close_groups(n_words[start:end], bits.reshape(end - start, -1))
                found.append(np.stack([ids[start:end], ids[start:end][roots]]))
        a, b = np.concatenate(found or [np.zeros((2, 0), np.int64)], axis=1)
        return pa.table({"a": a[a != b], "b": b[a != b]})

    rows = lines.join(large.select("doc_id"), "doc_id", "left_semi")
    sent = rows.mapInArrow(sketched, "block int, key long, id long, n_words long, bits binary")
    parts = connected_components(sent.groupBy("block").applyInArrow(meet, "a long, b long"), scratch)
    parts = parts.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    return scratch.save(clusters.join(sizes, "cluster", "left_anti").select("doc_id", "cluster").unionByName(parts), "parts")


def dedup_lines(docs: DataFrame, most: float = 1.0) -> DataFrame:
    """``docs`` with repeated lines taken out of text, in all its columns, and with
    lines_removed (long) beside them.

    A document that would lose more than the share ``most`` of its characters is a copy
    rather than a text with repeated lines, and is left whole for a step that removes
    documents; with 1.0 no document is spared.

    Lines end at a line feed and are compared whole. A null text stays null. Rows
    without doc_id stay as they are. Rows of one id count as one document. A text whose lines all go
    becomes empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.save(_lines(plain).select("doc_id", "h1", "h2", F.length("line").alias("chars")), "found", chars=F.sum("chars"))
    distinct = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    near = scratch.save(_near_lines(plain, found.metrics["chars"] or 0, scratch), "classes")
    # A line that occurs once and is near to no other has no class.
    classed = distinct.join(near, distinct.h1 == near.node, "left").where("component is not null or n > 1")
    classed = scratch.save(classed, "classed")
    sole = F.col("component").isNull()
    home = classed.where(~sole).groupBy("component").agg(F.min("first").alias("home"))
    classed = (classed.where(~sole).join(home, "component").select("h1", "h2", F.col("component").alias("line_class"), "home")
               .unionByName(classed.where(sole & (F.col("n") > 1)).select("h1", "h2", F.col("h1").alias("line_class"), F.col("first").alias("home"))))
    hits = found.select("doc_id", "h1", "h2").join(classed, ["h1", "h2"])
    # In its home a class stays once, elsewhere not at all: null stands for that.
    entry = F.struct("h1", F.when(F.col("home") == F.col("doc_id"), F.col("line_class")).alias("line_class"))
    wanted = scratch.save(hits.groupBy("doc_id").agg(F.collect_set(entry).alias("lines")), "wanted")
    scratch.keep(wanted)
    return _rebuilt(docs, wanted, most)


def _rebuilt(docs: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    fields = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*fields).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(wanted.withColumnRenamed("doc_id", "id"), "id", "left").select("row", "lines")
    schema = "row " + docs.schema.simpleString() + ", text string, lines_removed long"

    def run(batches):
        with_text = (pa.RecordBatch.from_arrays([batch.column("row").field("text"), *batch.columns], ["text", *batch.schema.names]) for batch in batches)
        for batch, given in text_batches(with_text, "text", FEWER_CHARS):
            texts, counts = [], []
            for text, null, lines in zip(given, batch.column("text").is_null().to_pylist(), batch.column("lines").to_pylist()):
                known = {x["h1"]: x["line_class"] for x in lines or ()}
                kept, seen, parts = [], set(), text.split("\n")
                for line in parts:
                    h = xxhash.xxh64_intdigest(line, seed=42) if known and len(line) >= MIN_CHARS else None
                    h = h - (1 << 64) if h is not None and h >> 63 else h
                    if h in known:
                        if known[h] is None or known[h] in seen:
                            continue
                        seen.add(known[h])
                    kept.append(line)
                if sum(map(len, parts)) - sum(map(len, kept)) > most * len(text):
                    kept = parts
                texts.append(None if null else "\n".join(kept))
                counts.append(len(parts) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                             ["row", "text", "lines_removed"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], "lines_removed")


