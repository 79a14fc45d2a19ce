"""Classification: keyword heuristics, and parsing of model responses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import terms as K, text as X

VALID_CATEGORIES = ["vulnerability", "red_team", "other"]


def heuristic_classify(df: DataFrame, red_team_terms: Iterable[str] = K.RED_TEAM_TERMS,
                       vuln_terms: Iterable[str] = K.VULN_TERMS,
                       high_terms: Iterable[str] = K.HIGH_RELEVANCE_TERMS,
                       low_terms: Iterable[str] = K.LOW_RELEVANCE_TERMS,
                       zero_day_terms: Iterable[str] = K.ZERO_DAY_TERMS) -> DataFrame:
    """Add the classification columns from title and summary, by Column expressions only."""
    text = X.article_text(F.col("title"), F.col("summary"))
    df = df.withColumn("cve_ids", X.cves_in_text(text)).withColumn("_text", F.lower(text))
    low = F.col("_text")
    category = (F.when(X.any_term(low, red_team_terms), F.lit("red_team"))
                .when((F.size("cve_ids") > 0) | X.any_term(low, vuln_terms),
                      F.lit("vulnerability"))
                .otherwise(F.lit("other")))
    relevance = (F.when(X.any_term(low, high_terms), F.lit(5))
                 .when(X.any_term(low, low_terms), F.lit(2)).otherwise(F.lit(3)))
    unknown = F.lit(None).cast("string")
    return df.withColumns({
        "category": category,
        "canonical_key": X.first_non_empty(X.slug80(F.col("title")), F.lit("unknown")),
        "one_line": F.substring(X.or_empty(F.col("title")), 1, 140),
        "is_zero_or_nday": X.any_term(low, zero_day_terms),
        "vendor": unknown, "product": unknown, "vuln_class": unknown,
        "affected_component": unknown, "severity": unknown,
        "relevance": relevance,
    }).drop("_text")


def response_json(response: Column) -> Column:
    """JSON object in a noisy response: all of it, else fenced, else first { to last }.

    Each candidate begins with a brace, so what parses is an object, and the next one is
    only parsed if it does not.
    """
    body = X.strip(response)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(*[F.try_parse_json(F.when(F.startswith(c, F.lit("{")), c))
                        for c in (body, fenced, braces)])


def _text_field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def relevance_score(v: Column) -> Column:
    """Whole number clamped to 1..5: numbers are truncated, texts must be whole."""
    text = X.strip(_text_field(v, "relevance"))
    number = F.try_variant_get(v, "$.relevance", "double")
    is_text = F.rlike(F.schema_of_variant(F.try_variant_get(v, "$.relevance", "variant")),
                      F.lit("^STRING"))
    whole = F.rlike(text, F.lit(r"^[+-]?\d+$"))
    flag = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))
    value = F.coalesce(F.when(is_text, F.when(whole, text.try_cast("double"))).otherwise(number),
                       F.when(~is_text, flag))
    clamped = F.greatest(F.lit(1.0), F.least(F.lit(5.0), value)).cast("int")
    return F.when(value.isNotNull() & ~F.isnan(value), clamped)


def fallback_key(vendor: Column, product: Column, vuln_class: Column, title: Column) -> Column:
    """vendor:product:class slugs, else the title slug, else 'unknown'."""
    slugs = [F.nullif(X.slug(c), F.lit("")) for c in (vendor, product, vuln_class)]
    return X.first_non_empty(F.concat_ws(":", *slugs), X.slug(title), F.lit("unknown"))


def parse_classification(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Model response to classification columns; an unreadable one becomes 'other'.

    Untrusted fields are read one by one with try_variant_get, so a scalar
    ``cve_ids`` or a fractional relevance does not void the rest.
    """
    v = F.col("_json")
    field = {n: _text_field(v, n) for n in (
        "category", "canonical_key", "one_line", "vendor", "product", "vuln_class",
        "affected_component", "severity")}
    named = F.lower(X.strip(X.or_empty(field["category"])))
    many = F.try_variant_get(v, "$.cve_ids", "array<string>")
    one = F.array(_text_field(v, "cve_ids"))
    key = F.nullif(F.lower(X.strip(X.or_empty(field["canonical_key"]))), F.lit(""))
    keyed = F.coalesce(key, fallback_key(field["vendor"], field["product"],
                                         field["vuln_class"], F.col("title")))
    read = v.isNotNull()
    title = X.or_empty(F.col("title"))
    cves = F.coalesce(X.normalize_cve_list(F.coalesce(many, one)),
                      F.array().cast("array<string>"))
    truth = F.lower(X.strip(_text_field(v, "is_zero_or_nday")))
    df = df.withColumn("_json", response_json(F.col(response_col)))
    out = df.withColumns({
        "category": F.when(read & named.isin(VALID_CATEGORIES), named).otherwise(F.lit("other")),
        "canonical_key": F.when(read, keyed).otherwise(F.lit("")),
        "one_line": F.when(read, F.substring(X.first_non_empty(field["one_line"], title), 1, 200))
                     .otherwise(title),
        "is_zero_or_nday": F.coalesce(truth.isin("true", "1", "yes"), F.lit(False)),
        "cve_ids": cves,
        "relevance": relevance_score(v),
        **{n: X.opt_string(field[n]) for n in (
            "vendor", "product", "vuln_class", "affected_component", "severity")},
    })
    return out.drop("_json")


def parse_match(df: DataFrame, response_col: str = "response", out: str = "match_id",
                candidates: str | None = None) -> DataFrame:
    """Record id named by a match response, or null.

    Whole numbers and digit texts count, truth values do not. With ``candidates``
    (an array column of ids) an id that was not offered is dropped.
    """
    v = F.try_variant_get(response_json(F.col(response_col)), "$.match_id", "variant")
    text = X.strip(F.try_variant_get(v, "$", "string"))
    kind = F.schema_of_variant(v)
    whole = F.rlike(text, F.lit(r"^\d+$")) & F.rlike(kind, F.lit("^STRING"))
    number = F.rlike(text, F.lit(r"^-?\d+$")) & F.rlike(kind, F.lit("^BIGINT"))
    found = F.when(whole | number, text.try_cast("long"))
    if candidates is not None:
        found = F.when(F.array_contains(F.col(candidates), found), found)
    return df.withColumn(out, found)
