"""Links between the holders of equal keys, and tables of bits that say which ids to read.

A task links those of its items that share a key, and sends each key once for so many keys,
with its smallest item. So no key has many rows in one place, however frequent it is. Keys
go in blocks by their upper bits, as binary values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm.batches import FEWER_CHARS, text_slices

#: Bits of the table that says which ids may be in a cluster. Its size is fixed; more
#: ids than bits only let more of them through.
FILTER_BITS = 1 << 24


def runs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the smallest id of each; and the links (a, b) of the
    other ids of a key with the smallest, each once."""
    if not len(keys):
        return keys, ids, ids, ids
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    least = np.minimum.reduceat(ids, firsts)
    every = np.repeat(least, np.diff(np.append(firsts, len(keys))))
    a, b = ids[ids != every], every[ids != every]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    return keys[firsts], least, a[new], b[new]


def _planes(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The stretches of 64-bit values that begin at the places ``at``, each byte by byte: the
    upper bytes of sorted keys and of small ids stand together, so a shuffle compresses them."""
    parts = [values[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(at, np.append(at[1:], len(values)))]
    return pa.array(parts, pa.binary())


def _values(planes: list[bytes], kind: type) -> np.ndarray:
    """The 64-bit values of all stretches, one after the other."""
    return np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(kind).ravel() for x in planes])


def key_links(rows: DataFrame, find: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]],
              blocks: int, held_keys: int) -> DataFrame:
    """Links (a, b) that connect all items sharing a key. ``find`` gives the keys (unsigned) of the
    items in the batches of a task, each beside its item's number; a task combines some
    ``held_keys`` of them before it sends them."""
    edges = np.array([(k << 64) // blocks for k in range(1, blocks)], np.uint64)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids, a, b = runs(*map(np.concatenate, zip(*held)))
        at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        filled = np.flatnonzero(np.diff(at))
        columns = [_planes(x, at[filled]) for x in (keys, ids)]
        links = [np.concatenate([a, b]).tobytes()] + [b""] * (len(filled) - 1)  # with any one of the blocks
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *columns, pa.array(links, pa.binary())],
                                          ["block", "keys", "ids", "links"])

    def send(batches):
        held, n = [], 0
        for found in find(batches):
            if len(found[0]):
                held.append(found)
                n += len(found[0])
            if n >= held_keys:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def meet(table: pa.Table) -> pa.Table:
        keys, ids = (_values(table.column(c).to_pylist(), kind) for c, kind in (("keys", np.uint64), ("ids", np.int64)))
        pairs = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("links").to_pylist()]
        a, b = np.concatenate([*pairs, np.stack(runs(keys, ids)[2:])], axis=1)
        return pa.table({"a": a, "b": b})

    sent = rows.mapInArrow(send, "block int, keys binary, ids binary, links binary")
    return sent.groupBy("block").applyInArrow(meet, "a long, b long")


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A table of bits in which the ids of ``column`` are set."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS)).cast("int").alias("slot")
    words = (ids.select(slot).selectExpr("shiftright(slot, 5) as word", "shiftleft(1, slot % 32) as bit")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # FILTER_BITS / 32 rows at most
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint32)
    return table


def maybe_held(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids (int64) may be among those of the table; no other is."""
    slots = ids & np.int64(FILTER_BITS - 1)
    return (table[slots >> 5] >> (slots & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` (doc_id, text) without most of those whose doc_id is not in ``ids``,
    which so stay out of the shuffle of a join."""
    shared = texts.sparkSession.sparkContext.broadcast(id_bits(ids, "doc_id"))

    def run(batches):
        table = shared.value
        for batch in batches:
            known = batch.filter(batch.column("doc_id").is_valid())
            held = known.filter(pa.array(maybe_held(table, known.column("doc_id").to_numpy())))
            for part, _ in text_slices([held], "text", FEWER_CHARS):
                yield part

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
