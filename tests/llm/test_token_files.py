"""Range coding, and token files read back, against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from feedtriage.llm import batches, rans, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n long, ids string, start int"


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def wanted(library, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def written(spark, rows, path, block=token_files.BLOCK):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    token_files.write_tokens(df, path, token_files.read_tokenizer(PATH), block=block)
    return sorted((tuple(r) for r in token_files.read_documents(spark, path).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_files_read_back(spark, library, tmp_path, block):
    rng = random.Random(1)
    words = ["the", "été", "  two", "\n", "a b", "x y", "don't", "<|endoftext|>", "日本", "🙂", "12345", "\t\t", "\x1c", "...", "᠎"]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(120)]
    rows += [(None, "first"), (1, None), (2, ""), (4, "x " * 30_000), (5, " "), (6, "a  \n b")]
    assert written(spark, rows, f"{tmp_path}/f", block) == wanted(library, rows)
    parts = token_files.read_parts(spark, f"{tmp_path}/f", ids=True).orderBy("at").collect()
    ids = [i for p in parts for i in p.ids]
    assert ids[:2] == library.encode("first").ids + [2]
    assert [p.at for p in parts] == np.cumsum([0] + [p.n for p in parts])[:-1].tolist()
    if block == 16:
        assert sum(not p.whole for p in parts) > 100


def test_ties_and_nothing(spark, library, tmp_path):
    got = written(spark, [(7, "same"), (7, "same"), (7, "another text"), (8, "z")], f"{tmp_path}/ties")
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in wanted(library, [(7, "same"), (7, "same"), (7, "another text"), (8, "z")]))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert written(spark, [], f"{tmp_path}/none") == []


def test_words_give_what_whole_texts_give(library):
    codec = token_files.WordEncoder(token_files.read_tokenizer(PATH))
    rng = random.Random(2)
    odd = "ab1'.,!\n\t    \x1c\x1f\x85᠎​_é日<|>endoftext"
    texts = ["".join(rng.choices(odd, k=rng.randrange(80))) for _ in range(3000)] + ["", " ", "a" * 5000, "it's  we'll\n\n x"]
    assert [np.frombuffer(b, "<u4").tolist() for b in codec.encode_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


class Counted(dict):
    asked = 0

    def get(self, word):
        self.asked += 1
        return super().get(word)


def test_a_repeated_word_is_looked_up_once(library):
    codec = token_files.WordEncoder(token_files.read_tokenizer(PATH))
    codec.known = Counted()
    texts = ["one of the été words, one of them\n"] * 2000
    assert [np.frombuffer(b, "<u4").tolist() for b in codec.encode_all(texts)] == [library.encode(texts[0]).ids] * 2000
    assert codec.known.asked < 100


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_with_nulls_give_what_whole_texts_give(library, kind, monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 50)
    codec = token_files.WordEncoder(token_files.read_tokenizer(PATH))
    rng = random.Random(3)
    odd = "ab1'.\n\r \x0b\x00\x85\xa0߿ࠀ￿é日🙂𝒜 "
    texts = [None if rng.random() < 0.2 else "".join(rng.choices(odd, k=rng.randrange(30))) for _ in range(600)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(["é before", *texts, "after"], kind).slice(1, len(texts))], ["text"])
    for chars in (1, 200, 10 ** 6):
        got = []
        for _, own in batches.text_slices(iter([batch]), "text", chars):
            ids, ends = codec.encode(own)
            got += [part.tolist() for part in np.split(ids, ends[:-1])]
        assert got == [library.encode(t or "").ids for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40_000), min_size=1, max_size=5), st.integers(1, 60_000), st.integers(0, 10 ** 6))
def test_blocks_round_trip(sizes, spread, seed):
    rng = np.random.default_rng(seed)
    blocks = [np.minimum(rng.zipf(1.3, n) - 1, spread).astype(np.uint32) for n in sizes]
    ids, counts = np.unique(np.concatenate(blocks), return_counts=True)
    table = rans.Table.of_counts(ids, counts)
    assert table.freq.sum() == 1 << table.bits and table.freq.min() >= 1
    payloads = table.encode(blocks)
    assert all((a == b).all() for a, b in zip(table.decode(payloads), blocks, strict=True))
    assert all((table.decode([p])[0] == b).all() for p, b in zip(payloads, blocks))


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(4).zipf(1.2, 1 << 16) - 1, 50_000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    bits = -(counts * np.log2(counts / counts.sum())).sum()
    assert len(rans.Table.of_counts(found, counts).encode([ids])[0]) < bits / 8 * 1.06


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 97
    table = rans.Table.of_counts(*np.unique(ids, return_counts=True))
    payload = table.encode([ids])[0]
    for at in (0, 5, 40, len(payload) // 2, len(payload) - 1):
        with pytest.raises(ValueError):
            table.decode([payload[:at] + bytes([payload[at] ^ 1]) + payload[at + 1:]])
    with pytest.raises(ValueError):
        table.decode([payload[:20]])


@given(st.lists(st.binary(max_size=300), max_size=6))
def test_checksums_of_parts(parts):
    assert rans.crc_of_parts([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))
