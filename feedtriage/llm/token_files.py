"""Token ids of a corpus in files of range-coded blocks.

Layout of a folder, all Parquet, so that any file system and Spark's commits serve it:
``table`` (id, freq), the frequencies that all blocks share; ``blocks``, one row a block
(shard, block, first: its first id's place in the shard, n, doc_ids and doc_sizes of the
documents in it, began: where in the shard the first one began, goes_on: the last one does
in the next block, payload); ``shards`` (shard, start, n), written last. Ids of all documents, in the order of their ids,
make one sequence; a shard is a stretch of it, and its blocks hold BLOCK ids each, the last one fewer, whatever
the sizes of documents. A block is decoded alone, given the table.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from feedtriage.llm.batches import text_slices
from feedtriage.llm.rans import Table, crc_of_parts
from feedtriage.scratch import Scratch

#: Ids of a block; blocks coded side by side; words a task remembers.
BLOCK, TOGETHER, WORDS = 1 << 16, 32, 300_000

#: Kinds of characters, a bit each: white space of ASCII, other visible ones, letters and
#: digits; and all that tokenizers may see in another way. A word ends before a character
#: whose bit is higher than that of the one before.
_WHITE, _SIGN, _WORD, _UNSURE = 4, 2, 1, 0


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    unsure = ("Cn", "Cc", "Cf", "Cs", "Co", "Zs", "Zl", "Zp")
    kind = lambda c: _WHITE if c in " \t\n\r" else _WORD if c.isalnum() else _UNSURE if unicodedata.category(c) in unsure else _SIGN
    return np.array([kind(chr(c)) for c in range(1 << 16)] + [_UNSURE], np.uint8)


def _byte_kinds(data: np.ndarray) -> np.ndarray:
    """For each byte of texts in UTF-8 the kind of its character."""
    kinds = _kinds()
    out = kinds[data]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        first = data[wide] >= 0xC0
        at = wide[first]
        lead, second, third = (data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 0x3F for k in range(3))
        size = data[at]
        codes = np.where(size < 0xE0, (lead & 0x1F) << 6 | second, (lead & 0x0F) << 12 | second << 6 | third)
        codes[size >= 0xF0] = 1 << 16
        out[wide] = np.append(kinds[codes], _UNSURE)[np.cumsum(first) - 1]
    return out


def word_cuts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, firsts): the words of all texts, none null, one after the other, in UTF-8; of
    each text the number of its first word, then the number of words.

    No token of a byte-level tokenizer spans the end of a letter or sign before white space,
    nor that of a letter before a sign.
    """
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[starts[0]:starts[-1]]
    starts -= starts[0]
    kind = _byte_kinds(data)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] & kind[:-1] * np.uint8(_WHITE | _SIGN)  # a lower bit, moved up by one or two
    cut[starts] = True
    cuts = np.flatnonzero(cut)
    words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    return words, np.searchsorted(cuts, starts)


def byte_alphabet() -> dict[int, int]:
    """The character that byte-level tokenizers write for each byte: the byte's own if it is
    printable, else one of those from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return dict(zip(printable, printable)) | {b: 256 + k for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts with a byte-level tokenizer of the tokenizers library, word by word.

    What the library gave for a word, with the white space before it, is kept for the next
    time; words that do not come up again are forgotten after WORDS others. A plain word goes
    to the library's model at once, as the pre-tokenizer would not part it. All else goes
    through the whole tokenizer. Tokenizers of another kind encode whole texts.
    """

    def __init__(self, tokenizer: str, specials_are_text: bool = True):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(tokenizer)
        self.lib.encode_special_tokens = specials_are_text
        self.model, self.alphabet = self.lib.model, byte_alphabet()
        self.known, self.older = {}, {}
        spec = json.loads(tokenizer)
        before = spec.get("pre_tokenizer") or {}
        self.by_words = (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                         and not before.get("add_prefix_space", True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all texts, none null, one after the other, and where each ends.

        A word is looked up once, however often the texts hold it; Arrow finds the different
        words and puts what was found for each in their places.
        """
        if not self.by_words:
            found = [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)
        words, firsts = word_cuts(texts)
        words = words.dictionary_encode()
        each = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, each))
        if None in found:
            found = [self.known.get(w) or self.word(w) if f is None else f for w, f in zip(each, found)]
        _, offsets, data = pa.array(found, pa.large_binary()).take(words.indices).buffers()
        ends = np.frombuffer(offsets, np.int64)[firsts[1:]] // 4
        return np.frombuffer(data or b"", "<u4")[:ends[-1]], ends

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not texts:
            return []
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])]

    def word(self, word: bytes) -> bytes:
        """Ids of a word that is not in ``known``, where it is from now on."""
        found = self.older.get(word)
        if found is None:
            text = word.decode()
            if (text[1:] if text[:1] == " " else text).isalpha():
                mapped = text.replace(" ", chr(self.alphabet[0x20])) if text.isascii() else word.decode("latin-1").translate(self.alphabet)
                found = _id_bytes([t.id for t in self.model.tokenize(mapped)])
            elif len(text) > 1 and text[0] == "\n" and text[1:].isalpha():
                found = b"".join([self.known.get(p) or self.word(p) for p in (b"\n", word[1:])])
            else:
                found = _id_bytes(self.lib.encode(text, add_special_tokens=False).ids)
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        self.known[word] = found
        return found


def _id_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@functools.lru_cache(maxsize=2)
def word_encoder(tokenizer: str) -> WordEncoder:
    """One a Python process, so tasks that follow each other share what is known."""
    return WordEncoder(tokenizer)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


class Packing:
    """Ids of a document as compressed bytes, for the shuffle: in 16 bits each where the
    vocabulary fits."""

    def __init__(self, vocabulary: int):
        self.kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.packer, self.opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Of each document, whose ids end at these places."""
        return [self.packer.compress(part.tobytes()) for part in np.split(ids.astype(self.kind), ends[:-1])]

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(self.opener.decompress(packed), self.kind)


def _tokenised(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and packed ids of each row, with the end id; and from each task a row without
    ids that counts them: seen, times."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # the size of one tokenizer file
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.binary()), ("seen", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches):
        codec, packing = word_encoder(shared.value), Packing(vocabulary)
        total = np.zeros(vocabulary, np.int64)
        for batch, texts in text_slices(batches, "text"):
            ids, ends = codec.encode(texts)
            ids = np.insert(ids, ends, end_id)
            total += np.bincount(ids, minlength=vocabulary)
            packed = packing.pack(ids, ends + np.arange(1, len(ends) + 1))
            none = pa.nulls(len(packed), schema.field("seen").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), none, none], schema=schema)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"seen": seen, "times": total[seen]}], schema)

    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return (rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary, seen array<long>, times array<long>")
            .withColumn("row", F.monotonically_increasing_id()))


def _frequencies(encoded: DataFrame) -> Table:
    """Of all ids; there are as many rows as the vocabulary has ids."""
    each = encoded.where("ids is null").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).select("x.*")
    found = each.groupBy(F.col("seen").alias("id")).agg(F.sum("times").alias("n")).toArrow().sort_by("id")
    return Table.of_counts(found.column("id").to_numpy(), found.column("n").to_numpy())


class _Cutter:
    """Cuts a shard's documents, which come one after the other, into blocks."""

    def __init__(self, size: int):
        self.size, self.block, self.place, self.held = size, 0, 0, 0
        self.parts, self.docs, self.began = [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """The blocks that are now full, as in ``cut``."""
        start, at = self.place, 0
        while at < len(ids):
            if not self.docs:
                self.began = start
            take = min(self.size - self.held, len(ids) - at)
            self.parts.append(ids[at:at + take])
            self.docs.append((doc_id, take))
            self.held, at, self.place = self.held + take, at + take, self.place + take
            if self.held == self.size:
                yield self.cut(at < len(ids))

    def cut(self, goes_on: bool = False) -> tuple:
        """(block, first, n, doc_ids, doc_sizes, began, goes_on, ids) of what is held."""
        ids, docs = np.concatenate(self.parts), self.docs
        out = self.block, self.place - self.held, len(ids), [d for d, _ in docs], [n for _, n in docs], self.began, goes_on, ids
        self.parts, self.docs, self.held, self.block = [], [], 0, self.block + 1
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 block: int = BLOCK) -> None:
    """Write the ids of every text, then the end id, in the order of the document ids.

    ``tokenizer`` is the text of a byte-level tokenizer's file. Null text is empty: the end
    id alone. Null ids come first; rows of one id stand in any order; other columns are not
    read; texts are never cut. An empty table gives empty files.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = docs.schema[id_col].dataType
    vocabulary = max(WordEncoder(tokenizer).lib.get_vocab_size(), end_id + 1)
    encoded = scratch.save(_tokenised(docs, tokenizer, vocabulary, end_id, id_col, text_col), "ids")
    table = _frequencies(encoded)
    rows = list(zip(table.ids.tolist(), table.freq.tolist()))
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)  # the size of the vocabulary
    fields = [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(kind))),
              ("doc_sizes", pa.list_(pa.int64())), ("began", pa.int64()), ("goes_on", pa.bool_()), ("payload", pa.binary())]

    def coded(blocks: list[tuple]) -> pa.RecordBatch:
        payloads, shard = shared.value.encode([b[-1] for b in blocks]), TaskContext.get().partitionId()
        rows = [(shard, *b[:-1], p) for b, p in zip(blocks, payloads)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [name for name, _ in fields])

    def run(batches):
        cutter, full, packing = _Cutter(block), [], Packing(vocabulary)
        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                for cut in cutter.add(doc_id, packing.unpack(packed.as_py())):
                    full.append(cut)
                    if len(full) == TOGETHER:
                        yield coded(full)
                        full = []
        if cutter.held:
            full.append(cutter.cut())
        if full:
            yield coded(full)

    order = ["doc_id", "row"]  # row makes the order total, so rows of one id can be dealt to several tasks
    ordered = encoded.where("ids is not null").select("doc_id", "row", "ids").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks = f"{path}/blocks"
    ordered.mapInArrow(run, f"shard int, block int, first long, n long, doc_ids array<{kind.simpleString()}>, doc_sizes array<long>, began long, goes_on boolean, payload binary").write.parquet(blocks)
    sizes = spark.read.parquet(blocks).groupBy("shard").agg(F.sum("n").alias("n"))  # one row a task
    start = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.select("shard", start.alias("start"), "n").coalesce(1).write.parquet(f"{path}/shards")
    scratch.clear()


def read_parts(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row for each document and block that holds ids of it: doc_id, start (the place of
    the document's first id in the sequence), at (the place of this part), n, whole (it is the
    whole document), crc (of these ids as 32-bit integers), and on request the ids."""
    found = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()  # the size of the vocabulary
    freq = found.column("freq").to_numpy()
    shared = spark.sparkContext.broadcast(Table(found.column("id").to_numpy(), freq, int(freq.sum()).bit_length() - 1))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType
    fields = [("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("crc", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * ids

    def parts(row: dict, block: np.ndarray) -> Iterator[tuple]:
        place, last = row["first"], len(row["doc_ids"]) - 1
        for i, (doc_id, n) in enumerate(zip(row["doc_ids"], row["doc_sizes"])):
            own = block[place - row["first"]:][:n]
            start = place if i else row["began"]
            whole = start == place and not (i == last and row["goes_on"])
            yield (doc_id, row["start"] + start, row["start"] + place, n, whole, zlib.crc32(own.astype("<u4").tobytes())) + ((own,) if ids else ())
            place += n

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                rows = batch.slice(k, TOGETHER).to_pylist()
                out = [p for row, block in zip(rows, shared.value.decode([r["payload"] for r in rows])) for p in parts(row, block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [name for name, _ in fields])

    shards = F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "start"))  # one row a task
    rows = blocks.join(shards, "shard").select("start", "first", "doc_ids", "doc_sizes", "began", "goes_on", "payload")
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, at long, n long, whole boolean, crc long" + ", ids array<long>" * ids)


def read_documents(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from its decoded ids.

    Only documents that lie in several blocks are shuffled, as the checksums of their parts."""
    scratch = scratch or Scratch(spark, "token-parts")
    parts = scratch.save(read_parts(spark, path), "parts")
    kind = parts.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches):
        for batch in batches:
            rows = [(r["doc_id"], r["start"], sum(p["n"] for p in r["parts"]), crc_of_parts([(p["crc"], 4 * p["n"]) for p in r["parts"]]))
                    for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [name for name, _ in fields])

    split = (parts.where("not whole").groupBy("doc_id", "start")
             .agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")))  # as many as its text has blocks
    joined = split.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")
    return parts.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")).unionByName(joined)
