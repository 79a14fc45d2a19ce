"""Keys of lines that are made for many lines at once, and their blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from feedtriage.llm import edit_join, line_dedup


def by_line(lines):
    places, keys = edit_join.keys_of(lines)
    return [set(keys[places == i].tolist()) for i in range(len(lines))]


def edited(rng, line, k):
    for _ in range(k):
        at = rng.choice([i for i, c in enumerate(line) if c == " "] or [0]) if rng.random() < 0.5 else rng.randrange(len(line))
        line = line[:at] + rng.choice(["", " ", "x", "é", line[at:at + 1] + " "]) + line[at + 1:]
    return line


def test_lines_within_their_edits_of_characters_share_a_key():
    rng = random.Random(21)
    pool = ["w" * rng.randrange(1, 4) + str(i) for i in range(300)] + ["ä", "日本", "\U0001f600x", "i"]
    lines, pairs = [], []
    for _ in range(1_500):
        a = rng.choice([" ", "  ", " ", "　"]).join(rng.choice(pool) for _ in range(rng.randrange(15, 90)))
        pairs.append((len(lines), len(lines) + 1))
        lines += [a, edited(rng, a, 1 if len(a) < edit_join.SECOND else 2)]
    keys, met = by_line(lines), set()
    for i, j in pairs:
        a, b = lines[i], lines[j]
        if edit_join.within(*sorted([a, b], key=len), edit_join.edits(min(len(a), len(b)))):
            assert keys[i] & keys[j], (a, b)
            met.add(len(a.split()))
    assert set(range(20, 85)) <= met


def test_keys_do_not_depend_on_the_lines_beside(monkeypatch):
    rng = random.Random(22)
    lines = ["", "x", " \t ", "y" * 500] + [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 130))) for _ in range(60)]
    want = [edit_join.all_keys(x) for x in lines]
    for size in (1, 300, 5_000, 100_000):
        monkeypatch.setattr(edit_join, "SLICE", size)
        edit_join._kept_powers.cache_clear()
        assert by_line(lines) == want
    edit_join._kept_powers.cache_clear()


def test_lines_of_many_words_have_keys_of_runs_only():
    line = " ".join(f"word{i}" for i in range(50))
    windows = 50 - edit_join.GRAM + 1 - (edit_join.common_run(50) - edit_join.GRAM)
    assert len(edit_join.all_keys(line)) <= windows and len(edit_join.all_keys(line)) < len(edit_join.probe_keys(line))


def test_runs_of_equal_keys_are_linked_with_their_smallest_line():
    rng = np.random.default_rng(23)
    for n in (0, 1, 5, 400):
        keys, ids = rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58), rng.integers(-40, 40, n)
        own, least, a, b = line_dedup._runs(keys, ids)
        held = {k: set(ids[keys == k].tolist()) for k in keys}
        assert dict(zip(own, least.tolist())) == {k: min(v) for k, v in held.items()}
        assert sorted(zip(a.tolist(), b.tolist())) == sorted({(i, min(v)) for v in held.values() for i in v if i != min(v)})
        assert (own[1:] > own[:-1]).all()


@pytest.mark.parametrize("block, held", [(60, 1), (500, 40), (10 ** 9, 10 ** 9)])
def test_lines_meet_whatever_the_blocks(spark, monkeypatch, block, held):
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", block)
    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = random.Random(24)
    bases = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (9, 25, 38, 45, 70, 120)]
    docs = spark.createDataFrame([(i, b + "s" * i) for i in range(2) for b in bases] + [(7, None), (8, "")], "doc_id long, text string")
    near = {r.text: r.lines_removed for r in line_dedup.dedup_lines(docs.repartition(5)).where("doc_id < 2").collect() if r.text}
    assert near == {b: 0 for b in bases}


def test_texts_are_rebuilt_in_bounded_slices(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    wanted = spark.createDataFrame([], "doc_id long, lines array<struct<h1:long,line_class:long>>")
    taken, whole = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: taken.append(f) or whole(self, f, *a, **b))
    line_dedup._rebuilt(docs, wanted, 1.0)
    line, other = "a line that goes from all its places", "x" * 2_500
    h = int(line_dedup._signed([line_dedup.line_hash(line)])[0])
    texts = [f"{line}\n{other}", None, ""] * 500
    lines = [[{"h1": h, "line_class": None}], None, None] * 500
    rows = pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts)], pa.struct([("doc_id", pa.int64()), ("text", pa.string())]))
    given = pa.array(lines, pa.list_(pa.struct([("h1", pa.int64()), ("line_class", pa.int64())])))
    out = list(taken[0](iter([pa.RecordBatch.from_arrays([rows, given], ["row", "lines"])])))
    assert max(b.nbytes for b in out) < 2_000_000 and len(out) > 2
    assert [t for b in out for t in b.column("text").to_pylist()] == [other, None, ""] * 500
    assert [n for b in out for n in b.column("lines_removed").to_pylist()] == [1, 0, 0] * 500
    assert [r["doc_id"] for b in out for r in b.column("row").to_pylist()] == list(range(1_500))
