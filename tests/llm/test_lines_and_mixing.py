"""Line dedup and mixing."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feedtriage.llm import edit_join, line_dedup, mixing
from feedtriage.llm.queries import MIX


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert edit_join.within(a, b, k) == (distance(a, b) <= k)


def components(strings):
    root = list(range(len(strings)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(strings):
        for j, b in enumerate(strings[:i]):
            k = edit_join.edits(min(len(a), len(b)))
            if k >= 0 and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(strings))]


def test_edit_join_equals_brute_force(monkeypatch):
    monkeypatch.setattr(edit_join, "SHORTEST", 4)
    monkeypatch.setattr(edit_join, "SECOND", 9)
    rng = random.Random(5)
    for _ in range(150):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 14))) for _ in range(12)]
        got, want = edit_join.join(strings), components(strings)
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(12) for j in range(12))


def line_docs():
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    base = [line(n) for n in (45, 60, 120, 230, 300, 25, 19)]
    docs = []
    for i in range(40):
        lines = [line(70)]
        for b in rng.sample(base, 3):
            c = list(b)
            for _ in range(rng.randrange(3)):
                c[rng.randrange(len(c))] = "Z"
            lines.append("".join(c))
        docs.append((i * 3, "\n".join(lines + lines[1:2] * (i % 2))))
    return docs + [(500, None), (501, ""), (502, "\n\n"), (503, base[3] + "\n" + "x" * 150_000), (504, base[6]), (505, base[6])]


@pytest.mark.parametrize("most", [1.0, 0.5])
def test_line_dedup_equals_brute_force(spark, most):
    docs = line_docs()
    lines = sorted({x for _, t in docs for x in (t or "").split("\n") if len(x) >= line_dedup.MIN_CHARS})
    cls = dict(zip(lines, components(lines)))
    home, want = {}, {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if x in cls:
                home.setdefault(cls[x], i)
    for i, t in docs:
        kept, seen = [], set()
        for x in (t or "").split("\n"):
            if x in cls and (home[cls[x]] != i or cls[x] in seen):
                continue
            seen.add(cls.get(x))
            kept.append(x)
        if sum(map(len, (t or "").split("\n"))) - sum(map(len, kept)) > most * len(t or ""):
            kept = (t or "").split("\n")
        want[i] = None if t is None else "\n".join(kept)
    assert sum(want[i] != t for i, t in docs) > 3
    rows = [(i, t, "h", 1) for i, t in docs] + [(None, lines[0], "h", 1)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, row string, lines int"), most)
    assert out.columns == ["doc_id", "text", "row", "lines", "lines_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert {i: got[i].text for i in want} == want
    assert got[None].text == lines[0] and got[0].row == "h" and len(got) == len(rows)


def test_line_dedup_of_nothing_and_of_repeated_rows(spark):
    line = "one line that is long enough to take part in this"
    rows = [(1, line + "\nx"), (1, line + "\nx"), (2, line)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, line + "\nx"), (1, line + "\nx"), (2, "")]
    assert line_dedup.dedup_lines(out.select("doc_id", "text").limit(0)).count() == 0


TARGETS = mixing.Targets(source={"a": 0.5, "b": 0.5}, lang={"en": 0.7, "de": 0.3, "xx": 0.5}, topic={"prose": 0.5, "brief": 0.5}, rate=0.2)


def test_raking_meets_the_margins():
    rng = np.random.default_rng(8)
    cells = [((s, v, t), float(rng.integers(50, 5_000))) for s in ("a", "b", mixing.OTHER) for v in ("en", "de") for t in ("prose", "brief")]
    drawn = mixing.rake(cells, TARGETS)
    have, total = dict(cells), sum(n for _, n in cells)
    assert all(0 <= drawn[k] <= have[k] + 1e-6 for k in have)
    assert sum(drawn.values()) == pytest.approx(TARGETS.rate * total, rel=1e-6)
    other = sum(n for k, n in cells if k[0] == mixing.OTHER) / total
    assert sum(d for k, d in drawn.items() if k[0] == "a") == pytest.approx(0.5 * (1 - other) * TARGETS.rate * total, rel=1e-4)
    assert sum(d for k, d in drawn.items() if k[1] == "en") == pytest.approx(0.7 * TARGETS.rate * total, rel=1e-4)
    assert mixing.rake([], TARGETS) == {} and mixing.rake([(("a", "en", "prose"), 0.0)], TARGETS) == {("a", "en", "prose"): 0.0}


def test_mix_draws_whole_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 300)), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "en", "de"]), "p")
            for i in range(4_000)] + [(5_000, None, "a", "en", "p"), (5_001, "", None, None, "p"), (None, "w", "a", "en", "p"), (3, "w", "a", "en", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability string")
    out = mixing.mix(docs, TARGETS).collect()
    assert len(out) == len(rows)
    drawn = [r for r in out if r.selected]
    tokens = sum(r.tokens for r in drawn)
    assert tokens == pytest.approx(TARGETS.rate * sum(r.tokens for r in out), rel=0.1)
    share = lambda f, v: sum(r.tokens for r in drawn if r[f] == v) / tokens
    assert share("source", "a") == pytest.approx(share("source", "b"), rel=0.15)
    assert share("lang", "en") == pytest.approx(0.7, abs=0.05)
    kept = mixing.selected(docs, TARGETS)
    assert kept.columns == docs.columns
    key = lambda r: (r.doc_id is None, r.doc_id)
    assert sorted(map(key, kept.collect())) == sorted(map(key, drawn))
    assert mixing.mix(docs.limit(0), TARGETS).count() == 0 and mixing.selected(docs.limit(0), TARGETS).count() == 0


def test_edits_grow_with_the_words_of_a_line(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    lines = []
    for n in (20, 39, 40, 45, 99, 170, 600):
        base = [rng.choice(words) for _ in range(n)]
        for share in (0.0, 0.02, 0.04, 0.06, 0.09, 0.12, 0.3):
            c = list(base)
            for at in sorted(rng.sample(range(n), int(share * n)), reverse=True):
                c[at:at + 1] = rng.choice([[], ["Other"], [c[at], "More"]])
            lines.append(" ".join(c))
    root = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            x, y = a.split(), b.split()
            k, c = edit_join.word_edits(min(len(x), len(y))), edit_join.edits(min(len(a), len(b)))
            if abs(len(x) - len(y)) <= k and distance(x, y) <= k or abs(len(a) - len(b)) <= c and distance(a, b) <= c:
                root = [root[j] if r == root[i] else r for r in root]
    got = edit_join.join(lines)
    assert [[a == b for b in got] for a in got] == [[a == b for b in root] for a in root]
    assert 5 < len(set(root)) < len(lines) - 15
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {i: t if root.index(root[i]) == i else "" for i, t in enumerate(lines)}


def test_two_edits_of_characters_share_a_key():
    rng = random.Random(12)
    for _ in range(300):
        a = "".join(rng.choice("abcd efg ") for _ in range(rng.randrange(200, 330)))
        b = list(a)
        for _ in range(2):
            b[rng.randrange(len(b))] = rng.choice(["", " ", "x", "y z"[:2]])
        b = "".join(b)
        if edit_join.within(*sorted([a, b], key=len), edit_join.edits(min(len(a), len(b)))):
            assert edit_join.all_keys(a) & edit_join.all_keys(b)


def test_targets_out_of_reach_are_named():
    cells = [(("a", "en", "prose"), 1_000.0), (("b", "en", "prose"), 10.0)]
    targets = mixing.Targets({"a": 0.5, "b": 0.5}, {"en": 1.0}, {"prose": 1.0}, rate=0.5)
    got = mixing.raked(cells, targets)
    assert got[("b", "en", "prose")][0] == 10.0  # all that there is, of 252.5 tokens wanted
    assert got[("b", "en", "prose")][1] == pytest.approx(10 / 252.5)
    assert got[("a", "en", "prose")][1:] == pytest.approx((1.0, 262.5 / 505, 262.5 / 505))
    assert mixing.raked([(("a", "en", "prose"), 0.0)], targets) == {("a", "en", "prose"): (0.0, None, None, None)}


def test_the_registered_targets_are_reached_as_reported(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mix(docs, MIX).withColumn("spread", F.col("probability") * (1 - F.col("probability")) * F.col("tokens") * F.col("tokens"))
    total = out.agg(F.sum("tokens")).first()[0]
    for facet in mixing.FACETS:
        rows = out.groupBy(facet).agg(
            F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0)).alias("drawn"), F.sum(F.col("probability") * F.col("tokens")).alias("expected"),
            F.sqrt(F.sum("spread")).alias("deviation"), F.min(f"{facet}_reached").alias("reached")).collect()
        for r in rows:
            assert r.expected == pytest.approx(r.reached * getattr(MIX, facet)[r[facet]] * MIX.rate * total, rel=1e-6), r
            assert abs(r.drawn - r.expected) <= 4 * r.deviation, r  # long documents are drawn whole


def test_lines_within_their_edits_of_words_share_a_key():
    rng = random.Random(8)
    met = 0
    for _ in range(1500):
        a = [str(rng.randrange(60)) for _ in range(rng.randrange(20, 300))]
        b = list(a)
        for _ in range(rng.randrange(1, len(a) // 20 + 1)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at:at + (kind < 2)] = ["new"] * (kind > 0)
        k = edit_join.word_edits(min(len(a), len(b)))
        if k >= 0 and edit_join.within(*sorted([a, b], key=len), k):
            places, keys = edit_join.word_keys([a, ["too", "few"], b])
            assert set(places.tolist()) == {0, 2} and set(keys[places == 0].tolist()) & set(keys[places == 2].tolist())
            met += 1
    assert met > 1000
    assert len(edit_join.word_keys([["few"], []])[1]) == 0


def test_far_strings_are_told_apart_by_their_first_items():
    looked = []

    class Word(str):
        def __hash__(self):
            looked.append(self)
            return str.__hash__(self)

    a, b = [Word(f"a{i}") for i in range(5_000)], [Word(f"b{i}") for i in range(5_000)]
    assert not edit_join.within(a, b, 3) and len(looked) < 100


def test_keys_are_marked_without_sorting_the_frequent_ones():
    keys = np.array([5, -3, 7, 9, -3], np.int64)
    for frequent in ([], [-3], [-9, 5, 9], [8], [10, 11]):
        frequent = np.array(frequent, np.int64)
        assert line_dedup._among(keys, frequent).tolist() == np.isin(keys, frequent).tolist()


def test_few_strings_join_without_keys_as_with_them(monkeypatch):
    rng = random.Random(5)
    pool = [f"word{i}" for i in range(300)]
    for _ in range(150):
        base, lines = [rng.choice(pool) for _ in range(rng.choice([6, 20, 41, 80, 82, 100]))], set()
        for _ in range(rng.randint(1, 9)):
            line = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(line))
                line[at:at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(pool)], [line[at] + "y"]])
                line = line or ["x"]
            lines.add(" ".join(line))
        lines, found = sorted(lines), []
        for few in (0, 16):
            monkeypatch.setattr(edit_join, "FEW", few)
            roots = edit_join.join(lines)
            found.append([roots.index(r) for r in roots])
        assert found[0] == found[1]
