"""N-gram join, signature trees, n-gram hashes and components, against brute force."""

import random
import re

import numpy as np
import pytest

from feedtriage.llm import ngram_join
from feedtriage.llm.components import connected_components
from feedtriage.llm.shingles import shingle_sets
from feedtriage.llm.signature_tree import SignatureTree
from feedtriage.scratch import Scratch


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= n:
        return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def brute(sets, num, den):
    """Smallest key reachable by links, for each key."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def family_texts(seed=1):
    """Families of edited copies, a passage that most texts share, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(20)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.6:
                words += passage
            out.append(" ".join(words))
    return out + ["", "one", "ONE", "two words", "Two words", None, " \t\n", "É é É é", "é é é é", "x y " * 40_000]


@pytest.mark.parametrize("n,num,den,chunk", [(3, 90, 100, 3), (5, 80, 100, 2_000)])
def test_components_equal_brute_force(spark, monkeypatch, n, num, den, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)  # 3: clusters meet in pairs of chunks
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)  # weak ranges and salts come into play
    texts = family_texts()
    rows = [(7 * i % 1009, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2] + [(None, "one", "x", 1)], "doc_id long, text string, keys string, cluster int")
    out = ngram_join.ngram_components(docs, n, num, den).collect()
    sets = {i: grams(t, n) for i, t, _, _ in rows}
    want = brute(sets, num, den)
    assert len(out) == len(rows) + 3
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert len(set(want.values())) < len(want) - 5
    assert ngram_join.ngram_components(docs.limit(0), n, num, den).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_part_key(num):
    rng = np.random.default_rng(num)
    frequent = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    parts = ngram_join.Parts(num, 100, frequent)
    for _ in range(400):
        size = int(rng.integers(8, 400))
        a = np.unique(np.concatenate([rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2), frequent[:rng.integers(0, 40)]]))
        drop = rng.random(len(a)) > 0.1 * rng.random()
        b = np.unique(np.concatenate([a[drop], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= num * (len(a) + len(b) - both) and len(a) != both:
            ka, kb = [set(np.concatenate(parts.keys(x)).tolist()) for x in (a, b)]
            assert ka & kb


def test_signature_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, int(rng.integers(5, 200)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 12))):
            own = rng.integers(0, 1 << 63, int(rng.integers(0, 12)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[int(rng.integers(0, 3)):], own])))
    got = SignatureTree(sets, 90, 100).join()
    want = brute({i: set(s.tolist()) for i, s in enumerate(sets)}, 90, 100)
    same = lambda c: {tuple(np.flatnonzero(np.array(c) == x)) for x in set(c)}
    assert same(got.tolist()) == same([want[i] for i in range(len(sets))])
    assert SignatureTree([], 90, 100).join().tolist() == []


def test_hashes_follow_the_words():
    texts = family_texts(2)
    for n in (1, 3, 5):
        names = {}
        for text, found in zip(texts, shingle_sets([t or "" for t in texts], n)):
            want = grams(text, n)
            assert len(found) == len(want)
            for h in found.tolist():
                names.setdefault(h, []).append(want)
        assert all(set.intersection(*w) for w in names.values())


def test_components_of_links(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
