"""SentencePiece encoding: ids, spans, character maps, decoding."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from feedtriage.llm import pieces

MODEL = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
CODEC = pieces.Codec(MODEL)
TEXTS = ["", " ", "  ", "a", "a  b\tc<s>\x00é漢字🙂 ▁x", "▁▁ ▁", "\n\n x\n ", "</s> a\r\n", "퟿", "　x y", "word " * 30_000]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_ids_and_spans_are_the_librarys(text):
    ids, begin, end = CODEC.encode(text)
    assert ids.tolist() == CODEC.lib.encode(text)
    raw = text.encode()
    for piece, a, b in zip(CODEC.lib.encode_as_proto(text).pieces, begin, end):
        if not piece.piece.startswith("<0x"):
            assert raw[a:b].decode() == piece.surface
    assert not len(ids) or (begin[0] == 0 and end[-1] == len(raw) and (begin[1:] == end[:-1]).all())
    assert CODEC.decode(ids) == CODEC.lib.decode(CODEC.lib.encode(text))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf"])
def test_compiled_maps_normalise_as_the_library_does(rule):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    codec = pieces.Codec.__new__(pieces.Codec)
    spec = proto.normalizer_spec
    codec.map, codec.prefix = pieces.CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix
    codec.squeeze, codec.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
    for text in ["ＡＢ① ﬁ​ x", "  a  b  ", "が ㌔ x", "Éé", " 　 ", "", "ß STRASSE", "a ﷺ b"]:
        norm, align = codec.normalise(text)
        assert norm == lib.normalize(text)
        assert len(align) == len(norm.encode()) + 1
        assert (np.diff(align) >= 0).all() and align[-1] == len(text.encode())


def test_round_trip_in_spark(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "a", "x"), (0, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode_pieces(docs, MODEL)
    back = {r.doc_id: r.text for r in pieces.decode_pieces(out, MODEL).collect()}
    digests = {r.doc_id: r for r in pieces.piece_digests(docs, MODEL).collect()}
    assert out.count() == len(rows)
    for r in out.collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = CODEC.lib.encode(text, add_bos=True, add_eos=True)
        assert r.ids == ids and len(r.begins) == len(r.ends) == len(ids)
        assert back[r.doc_id] == CODEC.lib.decode(ids)
        d = digests[r.doc_id]
        assert d.n_tokens == len(ids) and d.covered
        assert d.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(CODEC.lib.decode(ids).encode()).hexdigest()
    assert pieces.piece_digests(docs.limit(0), MODEL).count() == 0


def test_decoding_makes_numbers_of_a_bounded_part_of_a_batch(monkeypatch):
    """A batch of rows with nulls, empty and long lists goes in slices, none lost."""
    import pyarrow as pa
    ids = [[1] * 7, None, [], [2] * 30, [3] * 5, [4] * 5, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "_ids"]).slice(1)
    parts = list(pieces.id_slices(batch, "_ids", 10))
    assert [p.column("doc_id").to_pylist() for p in parts] == [[1, 2], [3], [4, 5, 6]]
    assert [x for p in parts for x in p.column("_ids").to_pylist()] == ids[1:]
    assert list(pieces.id_slices(batch.slice(0, 0), "_ids", 10)) == []


def test_encoding_and_decoding_need_one_process_a_task(spark, monkeypatch):
    """The pipeline's last stage passes ids to no second Python process; rows are those of the two steps."""
    import corpus_pipeline
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "a"), (0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = corpus_pipeline.encoding_stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    monkeypatch.setattr(pieces, "ENCODED_CHARS", 10)
    whole = lambda df: sorted(map(str, df.select("doc_id", "ids", "begins", "ends", "text").collect()))
    two = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL, keep=("ids", "begins", "ends"))
    assert whole(pieces.encode_and_decode(docs, MODEL)) == whole(two)
    assert pieces.encode_and_decode(docs.limit(0), MODEL).count() == 0
