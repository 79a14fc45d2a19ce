"""Similar texts and vectors, window candidates and the pair model, against all pairs."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedtriage.operators import pair_model, similarity as S
from feedtriage.operators.matching import window_candidates
from feedtriage.operators.running import running_value
from feedtriage.scratch import Scratch

NOW = datetime(2026, 7, 1, tzinfo=timezone.utc)


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def alike(texts):
    """All pairs i > j with their similarity."""
    sets = {i: shingles(t) for i, t in texts.items()}
    out = {}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    out[i, j] = both / (len(sets[i]) + len(sets[j]) - both)
    return out


def groups(links, ids):
    low = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def corpus(rng):
    words = [f"w{i}" for i in range(3000)]
    licence = rng.choices(words, k=60)
    texts = {}
    for i in range(400):
        texts[len(texts)] = " ".join(rng.choices(words, k=rng.randrange(20, 200)) + licence * (i % 3 == 0))
    for k in range(150):  # near copies, some of near copies
        own = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randrange(0, max(1, len(own) // 60) + 1)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[len(texts)] = " ".join(own)
    for k in range(40):
        texts[len(texts)] = texts[7].upper().replace(" ", "  \t")
    texts |= {len(texts): "", len(texts) + 1: None, len(texts) + 2: "one two", len(texts) + 3: "One  two", len(texts) + 4: "w1 " * 30_000}
    return texts


def test_jaccard_links_against_all_pairs(spark):
    texts = corpus(random.Random(3))
    df = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in texts.items()], "seq long, text string, content string, side int, id long")
    scratch = Scratch(spark, "t")
    blocks = S.Texts(df, None, scratch=scratch)
    classes, links = blocks.links()
    want = alike(texts)
    found = {(r.id, r.other): r.score for r in links.collect()}
    assert all(abs(want[p] - s) < 1e-12 for p, s in found.items())
    got = {r.id: r.group_id for r in S.similar_groups(classes, links, scratch).collect()}
    low = groups(want, texts)
    assert set(got) == {i for i, t in texts.items() if shingles(t)}
    assert got == {i: low[i] for i in got}
    together = sum(got[a] == got[b] for a, b in want)
    assert together >= 0.95 * len(want) and len(want) > 100


def test_items_are_matched_with_records(spark):
    texts = corpus(random.Random(4))
    stored = {i: t for i, t in texts.items() if i % 2}
    df = lambda rows, c: spark.createDataFrame(list(rows.items()), f"{c} long, text string")
    pairs = S.similar_pairs(df({i: t for i, t in texts.items() if not i % 2}, "seq"), df(stored, "id")).collect()
    want = alike({i: t for i, t in texts.items()})
    want = {frozenset(p) for p in want}
    for p in pairs:
        assert frozenset((p.seq, p.cand_seq if p.record_id is None else p.record_id)) in want
    matched = {p.seq for p in pairs if p.record_id is not None}
    should = {i for i in texts if not i % 2 and any(frozenset((i, j)) in want for j in stored)}
    assert len(matched & should) >= 0.98 * len(should) and matched <= should


def test_a_block_of_any_size_gives_linear_pairs(spark):
    base = [f"w{i}" for i in range(200)]
    def variant(k):
        own = list(base)
        own[k % 200] = f"v{k}"
        return " ".join(own)
    df = spark.createDataFrame([(k, variant(k)) for k in range(1500)] + [(k, variant(0)) for k in range(1500, 3000)], "seq long, text string")
    scratch = Scratch(spark, "t")
    classes, links = S.Texts(df, None, scratch=scratch).links()
    assert links.count() < 20 * 1500  # of 1.1 million pairs
    assert S.similar_groups(classes, links, scratch).agg(F.max("group_id")).first()[0] == 0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " ")], [(None, "a b c d e f")]])
def test_nothing_to_link(spark, rows):
    df = spark.createDataFrame(rows, "seq long, text string")
    assert S.similar_pairs(df).count() == 0


def test_dedup_takes_similar_items_that_no_leader_shows(spark):
    """The earliest of a group goes by its URL; the others are then found among themselves."""
    words = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join(words[:-1] + [f"v{k}"])
    rows = [(0, "u", [], "k0", "other text that is long enough"), (1, "u", [], "k1", near(1)), (2, "u2", [], "k2", near(2)),
            (3, "u3", [], "k3", near(3)), (4, "u4", [], "k4", near(2)), (5, "u5", [], "k5", "something else that is new here")]
    df = spark.createDataFrame(rows, "seq long, url string, cve_ids array<string>, canonical_key string, text string")
    got = {r.seq: r.reason for r in S.dedup_similar(df).collect()}
    assert got == {0: "", 1: "layer1:url-seen(pending)", 2: "", 3: "layer3:semantic", 4: "layer3:semantic", 5: ""}


def vectors(rng, n, dims, near):
    base = rng.normal(size=(n, dims))
    copies = base[rng.integers(0, n, near)]
    copies = copies / np.linalg.norm(copies, axis=1, keepdims=True)
    off = rng.normal(size=copies.shape)
    off -= (off * copies).sum(1, keepdims=True) * copies
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.93, 1.0, (near, 1))
    return np.vstack([base, copies * cos + off * np.sqrt(1 - cos ** 2)]).astype(np.float32)


def test_cosine_links_find_what_all_pairs_have(spark):
    rng = np.random.default_rng(5)
    x = vectors(rng, 3000, 64, 600)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] + [1.0] * 63), (9006, [1.0, 2.0]), (9007, (x[4] * 2).tolist())]
    df = spark.createDataFrame(rows + bad, "seq long, embedding array<float>")
    scratch = Scratch(spark, "t")
    blocks = S.Vectors(df, None, scratch=scratch)
    assert "Python" not in blocks.rows._jdf.queryExecution().toString()
    classes, links = blocks.links()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.tril(c >= 0.93, -1)))}
    found = {(r.id, r.other) for r in links.where("id < 9000").collect()}
    assert found <= {p for p in want} | {(i, j) for i, j in found if abs(c[i, j] - 0.93) < 1e-9}
    got = {r.id: r.group_id for r in S.similar_groups(classes, links, scratch).collect()}
    recall = sum(got[a] == got[b] for a, b in want) / len(want)
    assert len(want) >= 600 and recall >= 0.99, recall
    assert got[9007] == got[4] and not {9001, 9002, 9003, 9004, 9005} & set(got) and got[9006] == 9006


def test_no_vectors(spark):
    assert S.similar_pairs(spark.createDataFrame([], "seq long, embedding array<double>"), method="cosine").count() == 0


def test_the_filter_of_keys_loses_none(spark):
    keys = Scratch(spark, "t").save(spark.range(0, 50_000, 7).withColumn("side", F.lit(0)), "keys")
    rows = spark.range(50_000).withColumn("side", F.lit(0)).where(S.maybe_among(keys, ["side", "id"]))
    kept = {r.id for r in rows.collect()}
    assert kept >= set(range(0, 50_000, 7)) and len(kept) < 50_000 / 7 * 1.5
    few = {r.id for r in spark.range(50_000).withColumn("side", F.lit(0)).where(S.maybe_among(keys, ["side", "id"], 1 << 10)).collect()}
    assert few >= set(range(0, 50_000, 7))


def test_running_value_over_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, rng.randrange(100)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r.m for r in running_value(df, ["k"], ["i"], "v", "m", Scratch(spark, "t"), F.min, F.least).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    low = {}
    for k, i, v in rows:
        assert got[i] == low.get(k)
        if v is not None:
            low[k] = min(v, low.get(k, v))


def test_window_candidates(spark):
    rng = random.Random(7)
    at = lambda: NOW + timedelta(minutes=rng.randrange(3000))
    records = [(i, at(), rng.choice("aaab")) for i in range(800)] + [(900, None, "a"), (901, NOW, None)]
    items = [(i, at(), rng.choice("aabc")) for i in range(500)] + [(600, None, "a"), (601, NOW, None)]
    records.append((902, items[0][1], items[0][2]))  # both ends of the window count
    records.append((903, items[0][1], items[0][2]))
    got = window_candidates(spark.createDataFrame(items, "seq long, at timestamp, block string"),
                            spark.createDataFrame(records, "id long, at timestamp, block string"), 2, Scratch(spark, "t"))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = {}
    for s, t, b in items:
        near = [(u, i) for i, u, c in records if t and u and c == b and t - timedelta(hours=2) <= u <= t]
        if near:
            want[s, b] = max(near)[1]
    assert {(r.seq, r.block): r.id for r in got.collect()} == want


def test_pair_answers_are_asked_once_and_failures_again(spark, tmp_path):
    root, log = f"{tmp_path}/cache", f"{tmp_path}/log"
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p2"), (4, "bad"), (5, "odd"), (6, None)], "n int, prompt string")

    def model(fails):
        def make():
            def fn(batch):
                with open(log, "a") as f:
                    f.write("".join(p + "\n" for p in batch))
                if fails and "bad" in batch:
                    raise RuntimeError("down")
                return ["yes" if p in ("p1", "bad") else "hm" if p == "odd" else '{"same": false}' for p in batch]
            return fn
        return make

    ask = lambda b, fails: {r.n: r.same for r in pair_model.ask_pairs(prompts, root, b, model(fails), NOW).collect()}
    assert ask("b1", True) == {1: True, 2: False, 3: False, 4: None, 5: None, 6: None}
    open(log, "w").close()
    assert ask("b1", False) == {1: True, 2: False, 3: False, 4: None, 5: None, 6: None}
    assert open(log).read() == ""  # the batch is committed
    assert ask("b2", False)[4] is True
    assert sorted(open(log).read().split()) == ["bad", "odd"]
    open(log, "w").close()
    assert ask("b3", False)[4] is True and open(log).read().split() == ["odd"]


def test_an_uncommitted_batch_of_answers_does_not_count(spark, tmp_path):
    root = f"{tmp_path}/cache"
    spark.createDataFrame([("k", True)], "key string, same boolean").write.parquet(f"{root}/answers/batch=half")
    assert pair_model.cached_answers(spark, root).count() == 0


def test_shingle_sets_of_many_texts_at_once():
    """Against sets made one by one, with nulls, empty and short texts, repeats and a slice."""
    import pyarrow as pa
    rng = random.Random(3)
    texts = [None, [], [1], [1, 2], [1, 2, 3, 1, 2, 3, 1, 2, 3]] + [[rng.randint(-2, 2) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    together, sizes = S.shingle_sets(pa.array(texts, pa.list_(pa.int64())).slice(1), 3)
    alone = [S.shingle_sets(pa.array([t], pa.list_(pa.int64())), 3)[0] for t in texts[1:]]
    assert sizes.tolist() == [len(x) for x in alone] and together.tolist() == [v for x in alone for v in x.tolist()]
    for t, values in zip(texts[1:], alone):
        assert len(values) == (len({tuple(t[i:i + 3]) for i in range(len(t) - 2)}) if len(t) >= 3 else min(len(t), 1))
        assert (np.diff(values.astype(object)) > 0).all()


def test_rows_are_dealt_by_block_once(spark):
    """Without records one shuffle serves the leaders and the rows that look for them."""
    texts = ["A b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i É", "a b c d e f g h i é", None, ""]
    rows = S.Texts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, text string"), None, threshold=0.1)
    met = rows._met_items(rows.rows)
    assert sorted(met.collect()) == sorted(rows._met(rows.rows).select("id", "side", "other").collect())
    assert met.groupBy("id").count().count() == 3
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1 or "ReusedExchange" in plan
