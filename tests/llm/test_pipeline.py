"""The pipeline's stages, one after the other, against brute-force versions."""

import hashlib

import public_tokenizers
import sentencepiece

from feedtriage.llm import line_dedup, mixing, quality
from feedtriage.llm.queries import MIX
from test_ngram_join import brute, grams

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SMALL).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in kept[:-1])
    rows = [{r.doc_id: r for r in d.collect()} for d in kept]
    model = quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(rows[1]) == {r.doc_id for r in quality.quality_scores(docs, model).where("score >= 0.7").collect()}
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(kept[1]).collect()}
    left = {i: r.text for i, r in lines.items() if not r.lines_removed or r.text.strip()}
    assert {i: r.text for i, r in rows[2].items()} == left and all(r.n_chars == len(r.text) for r in rows[2].values())
    assert all(r.text.strip() for r in rows[2].values())
    roots = brute({i: grams(r.text, 5) for i, r in rows[2].items()}, 80, 100)
    assert set(rows[3]) == {i for i, c in roots.items() if i == c} and len(rows[3]) < len(rows[2])
    assert set(rows[4]) == {r.doc_id for r in mixing.mix(kept[3], MIX).where("selected").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        ids = library.encode(rows[4][i].text, add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        size = len(rows[4][i].text.encode())
        assert len(r.begins) == len(r.ends) == len(ids) and r.ends[-1] == size and r.begins[1:-1] == [0, *r.ends[1:-2]][:len(ids) - 2]


def test_run_on_the_entry(spark):
    import __spark_entry__ as entry
    out = entry.queries()["pipeline"](spark, SMALL)
    assert out.count() > 0
    for name in entry.queries():
        if name.startswith("op"):
            assert name.split("_")[0][2:].isdigit()


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    text = "words of a text that is long enough to be a line of its own, number {}".format
    rows = [(1, None, "h", 0), (2, "", "h", 0), (3, text(1), "h", 0), (3, text(1), "h", 0), (None, text(1), "h", 0), (4, text(1) + "\n" + text(2)[::-1], "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.line_stage(spark, docs, "").collect())
    assert got == [("1", None), ("2", ""), ("3", text(1)), ("3", text(1)), ("4", text(2)[::-1]), ("None", text(1))]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "4", "None"]
    back = corpus_pipeline.encoding_stage(spark, docs, "").collect()
    assert len(back) == 6 and all(len(r.ids) == len(r.begins) == len(r.ends) == r.n_tokens for r in back)
    assert all(r.n_tokens == 2 for r in back if r.doc_id in (1, 2))
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.encoding_stage):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_line_stage_removes_most_of_a_text(spark):
    line = "this line comes back within one document, number {}".format
    rows = [(1, "\n".join([line(1)] * 4 + ["short"])), (2, "\n".join([line(2)[::-1], line(3).upper()])),
            (3, "\n".join([line(2)[::-1], line(3).upper()])), (4, line(2)[::-1] + "\nits own")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    want = {1: line(1) + "\nshort", 2: rows[1][1], 4: "its own"}
    assert got == {i: (t, len(t)) for i, t in want.items()}
