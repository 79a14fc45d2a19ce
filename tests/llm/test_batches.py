"""Slices of Arrow batches."""

import random
import tracemalloc

import pyarrow as pa

from feedtriage.llm.batches import text_batches


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])


def test_slices_hold_so_many_characters_or_one_text():
    rng = random.Random(31)
    for _ in range(500):
        texts = [rng.choice([None, "", "é" * rng.randrange(1, 12), "a" * rng.randrange(1, 12)]) for _ in range(rng.randrange(9))]
        most, want = rng.randrange(1, 15), []
        for text in texts:
            size = sum(map(len, want[-1])) if want else 0
            if not want or size and size + len(text or "") > most:
                want.append([])
            want[-1].append(text or "")
        got = list(text_batches(iter([batch_of(texts)]), "text", most))
        assert [x for _, x in got] == want
        assert [i for b, _ in got for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))


def test_only_the_texts_of_a_slice_become_python_strings():
    batch = batch_of(["x" * 10_000] * 2_000)
    tracemalloc.start()
    slices = text_batches(iter([batch]), "text", 100_000)
    assert len(next(slices)[1]) == 10
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
