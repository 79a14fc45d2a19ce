"""One query per operator of this package over the given tables."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedtriage.llm import chat, embed_dedup, exact_dedup, line_dedup, merkle, mixing, ngram_join, pieces, quality, secret_scan, token_files, toxicity, whitening
from feedtriage.scratch import Scratch


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_exact_dedup(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"))


#: Equal parts of the twenty sources, mostly English, mostly prose; half of all tokens.
MIX = mixing.Targets(
    source={f"src{i}": 0.05 for i in range(20)}, lang={"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1},
    topic={"prose": 0.5, "long": 0.2, "brief": 0.1, "legal": 0.1, "table": 0.1}, rate=0.5)


def op2_mixing(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"), MIX)
    return mixed.withColumns({c: F.round(c, 6) for c in ("probability", "source_reached", "lang_reached", "topic_reached")})


def op3_ngram_join(spark, d):
    found = ngram_join.ngram_components(table(spark, d, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_sentencepiece(spark, d, model: str | None = None):
    model = pieces.read_model(model or public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.piece_digests(table(spark, d, "documents"), model)


def op5_embedding_dedup(spark, d):
    return embed_dedup.near_vectors(table(spark, d, "embeddings"))


def op6_quality(spark, d):
    return quality.classify_quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_toxicity(spark, d):
    return toxicity.classify_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_line_dedup(spark, d):
    out = line_dedup.dedup_lines(table(spark, d, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.size(F.split(text, "\n", -1)) * (text != "").cast("int")).cast("long").alias("n_lines"),
                      "lines_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op9_chat_formatting(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(hard).alias("text"))
    out = chat.format_chats(rows.unionByName(extra))
    back = out.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    script = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(script, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_secret_scan(spark, d):
    found = secret_scan.scan_secrets(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *count, F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.col("spans")).alias("spans"))


def op11_token_files(spark, d, tokenizer: str | None = None):
    scratch = Scratch(spark, "op11")
    path = f"{scratch.root}/files"
    text = token_files.read_tokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write_tokens(table(spark, d, "documents"), path, text, end_id=2)
    return token_files.read_documents(spark, path, scratch)


def op12_whitening(spark, d):
    return whitening.whitened_rows(table(spark, d, "embeddings"))


def op13_merkle_manifest(spark, d):
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaves = table(spark, d, "documents").select(
        "doc_id", "lang", merkle.leaf_digest(*fields, F.col("text")).alias("leaf"),
        F.when(tampered, merkle.leaf_digest(*fields, lower)).alias("claimed"))
    return merkle.check_proofs(merkle.merkle_manifest(leaves, "lang", ["doc_id"]), "doc_id", "claimed")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_ngram_join, op4_sentencepiece, op5_embedding_dedup, op6_quality, op7_toxicity, op8_line_dedup, op9_chat_formatting, op10_secret_scan,
                                  op11_token_files, op12_whitening, op13_merkle_manifest)}
