"""Model surface: prompts, a pluggable batch function, summaries of new items.

The model itself is the caller's function ``fn(list[str]) -> list[str | None]``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import text as X
from feedtriage.operators.running import running_count
from feedtriage.scratch import Scratch

ModelFn = Callable[[list[str]], list[str | None]]


def _ask(fn: ModelFn, prompts: list[str]) -> list[str | None]:
    """One batch; when it fails, its prompts are asked one by one, failures give null."""
    try:
        answers = list(fn(prompts))
        if len(answers) == len(prompts):
            return answers
    except Exception:
        pass
    out: list[str | None] = []
    for prompt in prompts:
        try:
            out.append(list(fn([prompt]))[0])
        except Exception:
            out.append(None)
    return out


def with_model(df: DataFrame, prompt_col: str, out_col: str,
               make_fn: Callable[[], ModelFn], batch_size: int = 64) -> DataFrame:
    """Add the model's answer to each prompt; null prompts are not asked.

    ``make_fn`` runs once per task, so it may open a client. Only the prompt
    column travels to Python. The result is marked non-deterministic so that
    Spark does not evaluate it twice; save it before branching on it.
    """

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_fn()
        for prompts in batches:
            out = pd.Series([None] * len(prompts), index=prompts.index, dtype="object")
            asked = prompts[prompts.notna()]
            for i in range(0, len(asked), batch_size):
                part = asked.iloc[i:i + batch_size]
                out.loc[part.index] = _ask(fn, part.tolist())
            yield out

    return df.withColumn(out_col, answer.asNondeterministic()(F.col(prompt_col)))


def article_prompt(title: Column, summary: Column) -> Column:
    """Prompt of the classify and summarise calls."""
    return F.concat(F.lit("Title: "), X.or_empty(title),
                    F.lit("\n\nSummary: "), X.or_empty(summary))


def _cve_list(cves: Column) -> Column:
    return X.first_non_empty(F.array_join(cves, ","), F.lit("none"))


def candidate_line(c: str = "") -> Column:
    """One already-reported record as shown to the model."""
    col = (lambda n: F.col(f"{c}.{n}")) if c else F.col
    return F.concat(F.lit("["), col("id").cast("string"), F.lit("] key="),
                    X.or_empty(col("canonical_key")), F.lit(" cves="), _cve_list(col("cve_ids")),
                    F.lit(" :: "), X.or_empty(col("title")), F.lit(" — "),
                    X.or_empty(col("description")))


def candidate_blocks(links: DataFrame, seen: DataFrame, page_lines: int = 200,
                     scratch: Scratch | None = None) -> DataFrame:
    """Candidate lines per item, newest first, from ``links(seq, id)``.

    Every linked record is shown. A long list goes on over pages of ``page_lines`` lines:
    page 0 holds the newest records, page 1 the next. Places in a list are counted along
    ranges, so no list is one task's. Records without a time come last.
    """
    scratch = scratch or Scratch(links.sparkSession, "blocks")
    age = F.coalesce(-F.unix_micros("first_seen_at"), F.lit(2 ** 63 - 1)).alias("age")
    placed = links.select("seq", "id").join(seen.select("id", age, (-F.col("id")).alias("rid")), "id")
    placed = running_count(placed, ["seq"], ["age", "rid"], "place", scratch)
    rows = (placed.withColumn("page", F.floor(F.col("place") / page_lines).cast("int"))
            .join(seen.select("id", candidate_line().alias("line")), "id"))
    grouped = rows.groupBy("seq", "page").agg(F.array_sort(F.collect_list(F.struct("place", "rid", "line"))).alias("l"))
    return grouped.select("seq", "page",
                          F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"),
                          F.transform("l", lambda x: -x["rid"]).alias("candidate_ids"))


def first_answer(answers: DataFrame, match_col: str = "match_id") -> DataFrame:
    """(seq, match_col): of the answers on an item's pages the first page's that names a
    record, thus the one among the newest; null if none does."""
    return answers.groupBy("seq").agg(F.min_by(match_col, F.when(F.col(match_col).isNotNull(), F.col("page"))).alias(match_col))


def match_prompts(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """The new item followed by its candidate block, one row per page."""
    prompt = F.concat(
        F.lit("NEW ITEM:\nkey="), X.or_empty(F.col("canonical_key")),
        F.lit(" cves="), _cve_list(F.col("cve_ids")),
        F.lit("\ntitle: "), X.or_empty(F.col("title")),
        F.lit("\nsummary: "), X.or_empty(F.col("summary")),
        F.lit("\n\nALREADY-REPORTED ITEMS:\n"), F.col("block"))
    return items.join(blocks, "seq").select("seq", "page", "candidate_ids", prompt.alias("prompt"))


def summarise(df: DataFrame, make_fn: Callable[[], ModelFn] | None = None,
              batch_size: int = 64) -> DataFrame:
    """Item summary: the model's text when there is a model, else the article's own.

    An empty result falls back to ``one_line``. Apply to new items only.
    """
    if make_fn is None:
        return df.withColumn("summary", X.first_non_empty(F.col("summary"), F.col("one_line")))
    asked = df.withColumn("_prompt", article_prompt(F.col("title"), F.col("summary")))
    asked = with_model(asked, "_prompt", "_answer", make_fn, batch_size)
    return (asked.withColumn("summary", F.coalesce(X.opt_string(F.col("_answer")),
                                                   F.col("one_line")))
            .drop("_prompt", "_answer"))
