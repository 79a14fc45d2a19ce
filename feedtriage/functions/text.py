"""Text functions: cleaning, slugs, CVE ids, keyword tests, header-safe text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The id pattern and the tag pattern.
CVE_PATTERN = r"(?i)CVE-\p{Nd}{4}-\p{Nd}{4,}"
TAG_PATTERN = r"<[^>]+>"

# The characters that count as white space, alone and as a class.
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE_RUN = (r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def strip(c: Column) -> Column:
    """Remove white space (any Unicode kind) from both ends; looks at the ends only."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def opt_string(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def clean_html(c: Column) -> Column:
    """Tags to spaces, white space runs to one space, stripped; null to ''."""
    no_tags = F.regexp_replace(or_empty(c), TAG_PATTERN, " ")
    return F.trim(F.regexp_replace(no_tags, SPACE_RUN, " "))


def article_text(title: Column, summary: Column) -> Column:
    return strip(F.concat(or_empty(title), F.lit("\n\n"), or_empty(summary)))


def slug(c: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 to '-', no '-' at the ends."""
    return F.btrim(F.regexp_replace(F.lower(or_empty(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def slug80(c: Column) -> Column:
    return F.substring(slug(c), 1, 80)


def cves_in_text(c: Column) -> Column:
    """Sorted distinct upper-cased CVE ids found in the whole text."""
    found = F.regexp_extract_all(or_empty(c), F.lit(CVE_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def normalize_cve(c: Column) -> Column:
    """First CVE id in the text, upper-cased, or ''."""
    return F.upper(F.regexp_extract(or_empty(c), CVE_PATTERN, 0))


def normalize_cve_list(c: Column) -> Column:
    """Normalise each element, drop the empty ones, keep order and repeats."""
    return F.filter(F.transform(c, normalize_cve), lambda x: x != "")


def cve_set(c: Column) -> Column:
    """Sorted distinct upper-cased ids; null gives an empty array."""
    upper = F.filter(F.transform(c, F.upper), lambda x: x.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(upper)), F.array().cast("array<string>"))


def cves_from_json(c: Column) -> Column:
    """CVE array stored as JSON text; bad JSON gives an empty array."""
    return cve_set(F.from_json(c, "array<string>"))


def append_cve(title: Column, cve: Column) -> Column:
    """Add ' (CVE)' unless the title already names it or there is no id."""
    missing = (cve != "") & ~F.contains(title, cve)
    return F.when(missing, F.concat(title, F.lit(" ("), cve, F.lit(")"))).otherwise(title)


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """True if any term is a substring of the (already lower-cased) text."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    out = F.contains(text, F.lit(terms[0]))
    for term in terms[1:]:
        out = out | F.contains(text, F.lit(term))
    return out


def matches_any(text: Column, terms: Iterable[str]) -> Column:
    """The same test as one pattern, which evaluates ``text`` once per row.

    Use it in filters: a predicate that names ``text`` once per term would
    compute it again for each of them.
    """
    quoted = [re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII) for term in terms]
    return F.rlike(text, F.lit("|".join(quoted))) if quoted else F.lit(False)


def next_page_link(header: Column) -> Column:
    """Target of rel="next" in a Link header, or null."""
    return F.nullif(F.regexp_extract(header, r'<([^>]+)>;\s*rel="next"', 1), F.lit(""))


@F.pandas_udf(T.StringType())
def _nfkd_latin1(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.encode("latin-1", "ignore").str.decode("latin-1")


def transliterate(c: Column) -> Column:
    # Dashes, curly quotes, no-break space and ellipsis to ASCII.
    plain = F.translate(c, "—–‘’“”\u00a0", "--''\"\" ")
    return F.replace(plain, F.lit("…"), F.lit("..."))


def header_safe(c: Column) -> Column:
    """Latin-1 only text. Only rows that still need it go through Python."""
    plain = transliterate(c)
    beyond = F.rlike(plain, F.lit(r"[^\x{00}-\x{FF}]"))
    return strip(F.when(beyond, _nfkd_latin1(F.when(beyond, plain))).otherwise(plain))


def xml_text(c: Column) -> Column:
    """Escape text for use inside markup."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out
