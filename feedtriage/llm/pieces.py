"""SentencePiece encoding and decoding that keeps the place of every piece.

Text is normalised by the longest prefix in the model's compiled character map, which
records for each normalised byte the source byte it comes from. Pieces partition the
normalised bytes, so the record projects each piece to a span of source bytes.

The sentencepiece library encodes each whole text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from feedtriage.llm.batches import text_batches

SPACE = "▁"

class CharMap:
    """The compiled character map: a double-array trie over source bytes, whose values
    are places in a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at ``at``, and what replaces it."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        node = step(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1]:self.texts.index(b"\0", best[1])]


def _char_bytes(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """Encodes and decodes with one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        self.map, self.prefix = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        self.squeeze, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.bytes_of = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.unknown = self.lib.unk_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes the source byte it comes from,
        then the end of the source."""
        data = text.encode()
        mark = SPACE if self.escape else " "
        if not self.map.units and not self.squeeze:
            source = np.frombuffer(data, np.uint8)
            widths = np.where(source == 0x20, len(mark.encode()), 1)
            align = np.repeat(np.arange(len(data), dtype=np.int32), widths)
            norm = text.replace(" ", mark)
        else:
            parts: list[tuple[bytes, int]] = []
            at = 0
            while at < len(data):
                hit = self.map.longest(data, at)
                if hit is None:
                    n = _char_bytes(data[at])
                    hit = n, data[at:at + n]
                parts.append((hit[1], at))
                at += hit[0]
            if self.squeeze:
                parts = _squeezed(parts)
            out = [p.replace(b" ", mark.encode()) for p, _ in parts]
            align = np.repeat(np.array([a for _, a in parts], np.int32), [len(p) for p in out])
            norm = b"".join(out).decode()
        if self.prefix and norm:
            norm, align = mark + norm, np.concatenate([np.zeros(len(mark.encode()), np.int32), align])
        return norm, np.append(align, np.int32(len(data)))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids, and the first byte and the byte after the last of each piece
        in the source. The pieces of a character that has none of its own lie in its bytes."""
        norms = [self.normalise(t) for t in texts]
        ids = [np.array(x, "<u4") for x in self.lib.encode(texts)]
        out = []
        for text, x, (_, align) in zip(texts, ids, norms):
            sizes = self.bytes_of[x]
            if (x == self.unknown).any():  # a model without byte pieces; the library knows their length
                sizes = np.array([len(p.piece.encode()) for p in self.lib.encode_as_proto(text).pieces], np.int32)
            ends = np.cumsum(sizes)
            if len(x) and ends[-1] != len(align) - 1:
                raise ValueError("pieces and normalised text differ in length")
            out.append((x, align[ends - sizes], align[ends]))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def with_marks(self, ids: np.ndarray, bos: bool, eos: bool) -> np.ndarray:
        return np.concatenate([np.array([self.lib.bos_id()] * bos, "<u4"), ids, np.array([self.lib.eos_id()] * eos, "<u4")]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids.tolist())


def _squeezed(parts: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Without spaces at the ends and after another space."""
    out: list[tuple[bytes, int]] = []
    for piece, at in parts:
        kept = bytearray()
        for c in piece:
            last = kept[-1:] or (out[-1][0][-1:] if out else b" ")
            if not (c == 0x20 and last == b" "):
                kept.append(c)
        if kept:
            out.append((bytes(kept), at))
    if out and out[-1][0].endswith(b" "):
        out[-1] = out[-1][0][:-1], out[-1][1]
    return out


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.array([])
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))


#: Characters that are ids and spans at once; a longer text is handled alone.
ENCODED_CHARS = 500_000


def _encoded(codec: Codec, batches: Iterator[pa.RecordBatch], bos: bool, eos: bool, spans: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and with ``spans`` begins and ends of batches of doc_id and text."""
    for batch, texts in text_batches(batches, "text", ENCODED_CHARS):
        all_ids, begins, ends = [], [], []
        for text, (ids, begin, end) in zip(texts, codec.encode_all(texts)):
            all_ids.append(codec.with_marks(ids, bos, eos))
            if spans:
                size = len(text.encode())
                begins.append(np.concatenate([np.zeros(int(bos), np.int32), begin, np.full(int(eos), size, np.int32)]))
                ends.append(np.concatenate([np.zeros(int(bos), np.int32), end, np.full(int(eos), size, np.int32)]))
        cols = [batch.column("doc_id"), _lists(all_ids, np.int32)]
        names = ["doc_id", "ids"]
        if spans:
            cols += [_lists(begins, np.int32), _lists(ends, np.int32)]
            names += ["begins", "ends"]
        yield pa.RecordBatch.from_arrays(cols, names)


def _piece_columns(docs: DataFrame, id_col: str, spans: bool) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    return f"doc_id {kind}, ids array<int>" + ", begins array<int>, ends array<int>" * spans


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                  bos: bool = True, eos: bool = True, spans: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, and with ``spans`` begins and ends, the
    source bytes of each piece (begin and end ids lie at the ends of the text).

    Null text is empty and gives the begin and end ids only; repeated rows stay; other
    columns are not read; texts are never cut. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of one model file
    run = lambda batches: _encoded(Codec(shared.value), batches, bos, eos, spans)
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, _piece_columns(docs, id_col, spans))


#: Ids that are Python numbers at once; a longer text is handled alone.
DECODED_IDS = 200_000


def id_slices(batch: pa.RecordBatch, column: str, most: int = DECODED_IDS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` ids, or of one row."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _decoded(codec: Codec, batches: Iterator[pa.RecordBatch], ids_col: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """doc_id, the columns in ``keep`` and the text that the ids decode to."""
    for batch in (part for whole in batches for part in id_slices(whole, ids_col)):
        texts = [codec.lib.decode(ids or []) for ids in batch.column(ids_col).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(texts, pa.string())],
                                         ["doc_id", *keep, "text"])


def decode_pieces(rows: DataFrame, model: bytes, ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep`` and the decoded text of rows of ``encode_pieces``; null
    ids give an empty text. ``keep`` holds neither doc_id nor text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    picked = rows.select("doc_id", F.col(ids_col).alias("_ids"), *keep)
    run = lambda batches: _decoded(Codec(shared.value), batches, "_ids", keep)
    return picked.mapInArrow(run, picked.drop("_ids").schema.add("text", "string"))


def encode_and_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                      bos: bool = True, eos: bool = True) -> DataFrame:
    """``decode_pieces`` of ``encode_pieces``, with its ids and spans: doc_id, ids, begins, ends, text.

    Ids are decoded in the process that made them, a bounded part of a batch at a time, so
    an executor holds one process a task and no batches of ids on the way to a second one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = Codec(shared.value)
        return _decoded(codec, _encoded(codec, batches, bos, eos, True), "ids", ("ids", "begins", "ends"))

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(
        run, _piece_columns(docs, id_col, True) + ", text string")


def piece_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                  bos: bool = True, eos: bool = True) -> DataFrame:
    """A round trip in one pass, as digests: doc_id, n_tokens, ids_sha256 (little-endian
    32-bit ids), decoded_sha256, spans_sha256 (begin and end of each piece, as 32-bit
    integers) and covered: the pieces' spans follow each other from the first to the last byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = Codec(shared.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch, texts in text_batches(batches, "text"):
            rows = []
            for text, (plain, begin, end) in zip(texts, codec.encode_all(texts)):
                ids = codec.with_marks(plain, bos, eos)
                covered = not len(plain) or bool(
                    begin[0] == 0 and end[-1] == len(text.encode()) and (begin[1:] == end[:-1]).all())
                rows.append((len(ids), sha(ids.tobytes()), sha(codec.decode(ids).encode()),
                             sha(np.stack([begin, end]).T.astype("<i4").tobytes()), covered))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered"])

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered boolean")
