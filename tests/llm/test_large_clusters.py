"""Work of the line join where many lines share passages."""

import random

import numpy as np

from feedtriage.llm import edit_join, line_dedup


def passages(rng, families, others):
    """Lines that share one passage: families of near copies, and lines whose other words are their own."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, lines = [word() for _ in range(14)], set()
    for _ in range(families):
        base = shared + [word() for _ in range(26)]
        for _ in range(6):
            copy = list(base)
            copy[rng.randrange(20, 40)] = word()
            lines.add(" ".join(copy))
    for _ in range(others):
        lines.add(" ".join(shared + [word() for _ in range(rng.randrange(20, 34))]))
    return sorted(lines)


def components(lines):
    root = list(range(len(lines)))
    words = [x.split() for x in lines]
    sets = [set(w) for w in words]
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(lines)):
        for j in range(i):
            a, b = sorted((i, j), key=lambda k: len(lines[k]))
            if edit_join._by_characters(lines[a], lines[b], sets[a], sets[b]) or edit_join._by_words(words[a], words[b], sets[a], sets[b]):
                root[find(i)] = find(j)
    return {frozenset(k for k in range(len(lines)) if find(k) == find(i)) for i in range(len(lines))}


def groups(roots):
    return {frozenset(np.flatnonzero(np.array(roots) == r).tolist()) for r in roots}


def test_lines_that_share_a_passage_only_are_not_compared_word_by_word(monkeypatch):
    lines = passages(random.Random(5), 4, 80)
    want, calls, within = components(lines), [], edit_join.within
    monkeypatch.setattr(edit_join, "within", lambda *a: calls.append(1) or within(*a))
    assert groups(edit_join.join(lines)) == want and len(want) == 84
    assert len(calls) < 3 * len(lines)


def test_words_of_strings_that_are_within_their_edits_are_few_apart():
    rng = random.Random(6)
    for _ in range(2000):
        a = "".join(rng.choice("abc  ") for _ in range(rng.randrange(40, 260)))
        b = list(a)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(b))
            b[at:at + rng.randrange(2)] = rng.choice(["", " ", "x"])
        a, b = sorted((a, "".join(b)), key=len)
        k = edit_join.edits(len(a))
        if edit_join.within(a, b, k):
            assert edit_join._by_characters(a, b, set(a.split()), set(b.split()))
            n_words, bits = edit_join.sketches([a.split(), b.split()])
            assert len(set(edit_join.close_groups(n_words, bits).tolist())) == 1


def test_close_groups_hold_what_joins_and_part_the_rest():
    lines = passages(random.Random(7), 5, 60)
    found = groups(edit_join.close_groups(*edit_join.sketches([x.split() for x in lines])))
    want = components(lines)
    assert all(any(w <= f for f in found) for w in want) and len(found) > 40
    assert edit_join.close_groups(*edit_join.sketches([])).tolist() == []
    repeated = [[w] * 300 for w in ("one", "other", "third")] + [["one"] * 305]
    assert groups(edit_join.close_groups(*edit_join.sketches(repeated))) == {frozenset([0, 3]), frozenset([1]), frozenset([2])}


def test_large_clusters_are_parted_before_their_lines_meet(spark, monkeypatch):
    lines = passages(random.Random(8), 3, 50)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(900, None)], "doc_id long, text string").repartition(3)
    whole = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(docs).collect()}
    met, joined = [], line_dedup.joined
    monkeypatch.setattr(line_dedup, "joined", lambda texts, clusters, *a: met.append(clusters.count()) or joined(texts, clusters, *a))
    monkeypatch.setattr(line_dedup, "LARGE", 10)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 20)
    parted = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert parted == whole and sum(n for _, n in whole.values()) == len(lines) - len(components(lines))
    assert met[0] <= 25  # the near copies, of 68 lines in one cluster
