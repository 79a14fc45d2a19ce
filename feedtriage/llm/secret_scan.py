"""Secret scan in DataFrame functions only: patterns, and windowed entropy.

A candidate is a run of key characters. What an allow-list pattern or a base span covers is
cut out of it; each piece that is left is judged by its class of characters. A window
slides over the piece; the counts of its characters change by one leaving and one entering
character, and with them the sum of count * log2(count), from which Shannon's entropy
follows. A piece whose windows reach the class's entropy gives a span. All steps are linear
in the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns of the base kinds.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of 32 or more is what remains of all runs of [0-9a-f] when shorter ones are dropped.
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy"]

KEY_CHARS = "A-Za-z0-9+/_=-"
#: Windows of runs of 24 characters or more, and of shorter ones.
LONG, SHORT = 24, 16
CANDIDATE = f"[{KEY_CHARS}]{{{SHORT},}}"
#: Placeholders and alphabets, UUIDs, and one repeated character are not secrets.
ALLOW_WORDS = "(?i)example|placeholder|changeme|your_|01234567|abcdefgh"
ALLOW_UUID = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
REPEATED = 8
ALLOW = (ALLOW_WORDS, ALLOW_UUID, rf"([{KEY_CHARS}])\1{{{REPEATED - 1},}}")


@dataclass(frozen=True)
class CharClass:
    """Pieces in which all ``patterns`` are found are judged by windows of ``width`` and ``bits``."""
    width: int
    bits: float
    patterns: tuple[str, ...] = ()

    @property
    def most(self) -> int:
        """The largest scaled sum of count * log2(count) at that entropy."""
        return math.floor(SCALE * self.width * (math.log2(self.width) - self.bits))


SCALE = 1 << 20
#: The first class that fits a piece counts; the last one of a width fits all others.
CLASSES = [CharClass(LONG, 2.9, ("^[0-9a-fA-F]+$",)),
           CharClass(LONG, 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
           CharClass(LONG, 3.7, ("^[A-Za-z0-9]+$", "[0-9]", "[a-zA-Z]")),
           CharClass(LONG, 4.0, ("[0-9]", "[a-zA-Z]")),
           CharClass(LONG, 4.2),
           CharClass(SHORT, 3.0, ("^[0-9a-fA-F]+$", "[0-9]", "[a-fA-F]")),
           CharClass(SHORT, 3.5, ("[0-9]", "[a-z]", "[A-Z]")),
           CharClass(SHORT, 3.6, ("[0-9]", "[a-zA-Z]")),
           CharClass(SHORT, 3.8)]
TABLE = [0] + [round(SCALE * c * math.log2(c)) for c in range(1, LONG + 1)]
#: Codes of key characters lie from "+" to "z".
FIRST_CODE, N_CODES = ord("+"), ord("z") - ord("+") + 1
#: Matches are put together block by block.
BLOCK = 256


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _no_spans() -> Column:
    return F.expr("array_repeat(struct(0 as start, 0 as end, '' as value), 0)")


def _placed(matches: Column) -> Column:
    """(at, spans) of matches that follow each other, with places from the first one's text on."""
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), _no_spans().alias("spans")), step)


def _matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """All matches, left to right, as (start, end, value); positions in code points.

    The pieces between the matches and the matches themselves add up to the text. They are
    added up by blocks, so that growing arrays stay short.
    """
    found, value = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), value_group)
    between = F.split(text, pattern, -1)
    matches = F.arrays_zip(found.alias("found"), value.alias("value"), F.slice(between, 1, F.size(found)).alias("before"))
    blocks = _with(matches, lambda m: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda k: _placed(F.slice(m, k * BLOCK + 1, BLOCK))))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["spans"], lambda s: F.struct(
            (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    none = F.struct(F.lit(0).alias("at"), F.array_repeat(_no_spans(), 0).alias("parts"))
    return F.flatten(F.aggregate(blocks, none, join, lambda acc: acc["parts"]))


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    return F.when(text.rlike(pattern), _matches(text, pattern, group)).otherwise(_no_spans())


def _found(text: Column, pattern: str, kind: int, at_least: int, group: int = 0) -> Column:
    return F.transform(F.filter(_spans(text, pattern, group), lambda s: F.length(s["value"]) >= at_least),
                       lambda s: F.struct(s["start"], F.lit(kind).alias("kind"), s["end"]))


def _added(counts: Column, place: Column, by: int) -> Column:
    """``counts`` with the one at ``place`` (from 1) changed by ``by``."""
    return F.concat(F.slice(counts, 1, place - 1), F.array(F.element_at(counts, place) + by), F.slice(counts, place + 1, N_CODES))


def window_span(piece: Column, width: Column, most: Column) -> Column:
    """(start, end) in ``piece`` from the first to the last window of ``width`` characters
    whose sum of count * log2(count) is at most ``most``; null if there is none or the
    piece is shorter than a window."""
    places = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - (FIRST_CODE - 1))
    table = F.array(*[F.lit(v).cast("long") for v in TABLE])

    def slide(codes: Column, table: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            into, gone = codes[i], codes[i - width]
            n_in, n_gone = F.element_at(acc["counts"], into), F.element_at(acc["counts"], gone)
            grown = acc["total"] + table[n_in + 1] - table[n_in]
            more = F.struct(grown.alias("total"), _added(acc["counts"], into, 1).alias("counts"))
            moved = F.struct((grown + table[n_gone - 1] - table[n_gone]).alias("total"),
                             _added(_added(acc["counts"], into, 1), gone, -1).alias("counts"))
            same = F.struct(acc["total"].alias("total"), acc["counts"].alias("counts"))
            return _with(F.when(i < width, more).when(into == gone, same).otherwise(moved), lambda now: judged(acc, now, i))

        def judged(acc: Column, now: Column, i: Column) -> Column:
            hit = (i >= width - 1) & (now["total"] <= most)
            return F.struct(
                now["counts"].alias("counts"), now["total"].alias("total"),
                F.when(hit & acc["first"].isNull(), i - (width - 1)).otherwise(acc["first"]).alias("first"),
                F.when(hit, i + 1).otherwise(acc["last"]).alias("last"))

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1),
            F.struct(F.array_repeat(F.lit(0), N_CODES).alias("counts"), F.lit(0).cast("long").alias("total"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")),
            step, lambda acc: F.struct(acc["first"].alias("start"), acc["last"].alias("end")))

    span = _with(F.struct(places.alias("codes"), table.alias("table")), lambda x: slide(x["codes"], x["table"]))
    return _with(span, lambda s: F.when(s["start"].isNotNull(), s))


def _pieces(runs: Column, cuts: Column) -> Column:
    """What the cuts leave of the runs, as (start, value), as far as a window fits: one sweep
    over both by their starts."""
    event = lambda kind: lambda s: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    events = F.array_sort(F.concat(F.transform(cuts, event(0)), F.transform(runs, event(1))))

    def out(acc: Column, until: Column) -> Column:
        n = F.least(until, acc["end"]) - acc["free"]
        piece = F.struct(acc["free"].alias("start"), F.substring(acc["value"], acc["free"] - acc["start"] + 1, n).alias("value"))
        return F.when(n >= SHORT, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        cut = x["kind"] == 0
        covered = F.when(cut, F.greatest(acc["covered"], x["end"])).otherwise(acc["covered"])
        return F.struct(
            covered.alias("covered"),
            F.when(cut, acc["start"]).otherwise(x["start"]).alias("start"), F.when(cut, acc["end"]).otherwise(x["end"]).alias("end"),
            F.when(cut, F.greatest(acc["free"], covered)).otherwise(F.greatest(x["start"], covered)).alias("free"),
            F.when(cut, acc["value"]).otherwise(x["value"]).alias("value"),
            out(acc, F.when(cut, x["start"]).otherwise(acc["end"])).alias("out"))

    none = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("free"), F.lit("").alias("value"),
                    F.expr("array_repeat(struct(0 as start, '' as value), 0)").alias("out"))
    return F.aggregate(events, none, step, lambda acc: out(acc, acc["end"]))


def _entropy(text: Column, base: Column, allow: tuple[str, ...]) -> Column:
    spans = F.transform(base, lambda b: F.struct(b["start"], b["end"], F.lit("").alias("value")))
    cuts = F.concat(spans, *[F.transform(_spans(text, p), lambda s: F.struct(s["start"], s["end"], F.lit("").alias("value"))) for p in allow])

    def judged(piece: Column) -> Column:
        value, limit = piece["value"], F.lit(None)
        for cls in reversed(CLASSES):
            fits = F.length(value) >= cls.width
            for pattern in cls.patterns:
                fits = fits & value.rlike(pattern)
            limit = F.when(fits, F.struct(F.lit(cls.width).alias("width"), F.lit(cls.most).cast("long").alias("most"))).otherwise(limit)
        span = _with(limit, lambda x: window_span(value, x["width"], x["most"]))
        return F.struct(piece["start"].alias("start"), span.alias("span"))

    hits = F.filter(F.transform(_pieces(_spans(text, CANDIDATE), cuts), judged), lambda x: x["span"].isNotNull())
    return F.when(text.rlike(CANDIDATE), F.transform(hits, lambda x: F.struct(
        (x["start"] + x["span"]["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"),
        (x["start"] + x["span"]["end"]).alias("end")))).otherwise(
            F.expr("array_repeat(struct(0 as start, 0 as kind, 0 as end), 0)"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans as (start, kind, end), by start and kind.

    ``kind`` is a place in KINDS. Positions are code points, end exclusive. Null text is
    empty; texts without matches get an empty array. Characters of a base span or an
    ``allow`` pattern count for no entropy; what stands beside them does. Repeated rows
    stay; other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_found(F.col("t"), ASSIGN, 0, 8, 2), _found(F.col("t"), ACCESS, 1, 16), _found(F.col("t"), HEX, 2, 32))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", base.alias("base"))
    return rows.select("doc_id", F.array_sort(F.concat("base", _entropy(F.col("t"), F.col("base"), allow))).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
