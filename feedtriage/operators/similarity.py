"""Semantic matches of items: similar texts and similar vectors.

They make pairs(seq, cand_seq, record_id, score), which ``greedy_dedup(pairs=)`` takes.
Blocking decides which rows meet; every pair is then checked exactly. Rows of one block are
not paired with each other but with the block's leader, its earliest holder, so a block of
any size gives as many pairs as it has rows. Blocks come in two depths, and each row is in
many, so that a leader that happens to be unlike a row does not hide the others from it.

Rows with the same tokens, or the same vector, are one class, for which its earliest row
stands; classes are what is blocked and compared.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import text as X
from feedtriage.operators.dedup import greedy_dedup
from feedtriage.scratch import Scratch

#: Words of a shingle, and the least share of shingles that two texts have in common.
WORDS, JACCARD = 5, 0.8
#: Bands of a signature, hashes of a band, and of the deeper block in it.
BANDS, ROWS, DEEP = 28, 4, 8
#: Least cosine; hash tables; hyperplanes they choose from; bits that a probe may flip.
COSINE, TABLES, PLANES, FLIPS = 0.93, 40, 256, 2
_WHITE = r"[\x20\x09-\x0D]+"


# --- token sets and their signatures --------------------------------------------

def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order; A-Z count as lower case, null as empty."""
    text = F.coalesce(text, F.lit(""))
    # in a text of one byte a character lower() changes the same letters, and costs less
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = F.filter(F.split(lower, _WHITE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; its constants are fixed values of a public mixing function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(words: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes): each text's distinct shingle hashes, one text after the other. A text
    of fewer than ``n`` words has its whole sequence as one shingle, without words none."""
    counts = np.asarray(words.value_lengths().fill_null(0), np.int64)
    hashes = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    factors = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    room = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts, ends = np.cumsum(counts) - counts, np.cumsum(room)
    owner = np.repeat(np.arange(len(counts)), room)
    first = starts[owner] + np.arange(len(owner)) - (ends - room)[owner]
    values = np.zeros(len(owner), np.uint64)
    whole = counts[owner] >= n
    first = first[whole]
    if len(first):  # all texts at once
        rolled = hashes[first] * factors[0]
        for k in range(1, n):
            rolled = rolled * np.uint64(31) + hashes[first + k] * factors[k]
        values[whole] = _mixed(rolled)
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        short = np.array([counts[i]], np.uint64)
        for k in range(counts[i]):
            short = short * np.uint64(31) + hashes[starts[i] + k:starts[i] + k + 1]
        values[ends[i] - 1:ends[i]] = _mixed(short)
    for low, high in zip((ends - room).tolist(), ends.tolist()):
        values[low:high].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def band_keys(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys a band for each set that is not empty: of its first ROWS minima, and of DEEP;
    and one bit of each minimum, in words of 64.

    A minimum is taken over the set's values under one multiplication modulo 2^64, an odd
    factor a hash; all sets are reduced at once, in the same two arrays.
    """
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    rng = np.random.default_rng(20240201)
    keys = np.empty((len(starts), BANDS, 2), np.uint64)
    bits = np.zeros((len(starts), -(-BANDS * DEEP // 64)), np.uint64)
    if not len(starts):
        return keys.reshape(0, 2 * BANDS).view(np.int64), bits.view(np.int64)
    spread, folded = np.empty_like(values), np.empty_like(values)
    for band in range(BANDS):
        key = np.full(len(starts), np.uint64(band + 1))
        for row, factor in enumerate(rng.integers(1, 2 ** 63, DEEP, np.uint64) * np.uint64(2) + np.uint64(1)):
            np.multiply(values, factor, out=spread)
            np.right_shift(spread, np.uint64(32), out=folded)
            least = np.minimum.reduceat(np.bitwise_xor(spread, folded, out=folded), starts)
            key = _mixed(key * np.uint64(31) + least)
            word, place = divmod(band * DEEP + row, 64)
            bits[:, word] |= (least & np.uint64(1)) << np.uint64(place)
            if row + 1 == ROWS:
                keys[:, band, 0] = key
        keys[:, band, 1] = key
    return keys.reshape(len(starts), 2 * BANDS).view(np.int64), bits.view(np.int64)


def most_differing(threshold: float) -> int:
    """How many of the bits of two sets may differ before their similarity is below the
    threshold for sure: five standard deviations (in 3 of 10 million cases a similar pair)."""
    n, differs = BANDS * DEEP, (1 - threshold) / 2
    return math.floor(n * differs + 5 * math.sqrt(n * differs * (1 - differs)))


#: Words worked on at once: their arrays fit a core's cache, which the hashes of a signature pass often.
SLICE_WORDS = 40_000


def _bounded(batches, most: int = SLICE_WORDS):
    """Slices of Arrow batches with a bounded number of words; a longer text is alone."""
    for batch in batches:
        counts = np.cumsum(np.asarray(batch.column("words").value_lengths().fill_null(0), np.int64))
        start = 0
        while start < len(batch):
            base = counts[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(counts, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_signatures(rows: DataFrame, text_col: str, n: int = WORDS) -> DataFrame:
    """side, id, size of the token set, its digest, keys and bits (null for an empty set)."""
    def run(batches):
        for batch in _bounded(batches):
            values, sizes = shingle_sets(batch.column("words"), n)
            keys, bits = band_keys(values, sizes)
            none, starts = pa.array(sizes == 0), (np.cumsum(sizes) - sizes)[sizes > 0]
            digests = np.zeros((len(sizes), 2), "<u8")
            if len(starts):  # two sums of mixed values, of a set in any order
                digests[sizes > 0, 0] = np.add.reduceat(_mixed(values), starts)
                digests[sizes > 0, 1] = np.add.reduceat(_mixed(values ^ np.uint64(0x5555555555555555)), starts)
            digests = [d.tobytes() if size else None for d, size in zip(digests, sizes.tolist())]
            before = np.append(0, np.cumsum(sizes > 0))
            lists = lambda rows: pa.ListArray.from_arrays(pa.array((before * rows.shape[1]).astype(np.int32)), pa.array(rows.reshape(-1)), mask=none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("side"), batch.column("id"), pa.array(sizes), pa.array(digests, pa.binary()), lists(keys), lists(bits)],
                ["side", "id", "size", "digest", "keys", "bits"])

    words = rows.select("side", "id", word_hashes(F.col(text_col)).alias("words"))
    return words.mapInArrow(run, "side int, id long, size long, digest binary, keys array<long>, bits array<long>")


def text_sets(rows: DataFrame, text_col: str, n: int = WORDS) -> DataFrame:
    """side, id and the token set as sorted hashes."""
    def run(batches):
        for batch in _bounded(batches):
            values, sizes = shingle_sets(batch.column("words"), n)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("side"), batch.column("id"), lists], ["side", "id", "tokens"])

    words = rows.select("side", "id", word_hashes(F.col(text_col)).alias("words"))
    return words.mapInArrow(run, "side int, id long, tokens array<long>")


# --- sign bits of hyperplanes ---------------------------------------------------

def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``c``, which is computed once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def unit_vector(v: Column) -> Column:
    """The vector in double precision, of length one; null if it is null, empty, zero, or has
    null or non-finite entries."""
    wide = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x))
    scaled = lambda w, m: F.transform(w, lambda x: x / m)  # noqa: E731  by the largest entry first, so no square overflows
    unit = bound(wide, lambda w: bound(F.array_max(F.transform(w, F.abs)), lambda m: F.when(m > 0, bound(
        scaled(w, m), lambda s: bound(length(s), lambda n: scaled(s, n))))))
    return F.when(finite, unit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def hyperplane_sides(unit: Column, dims: int, bits: int, seed: int = 7) -> Column:
    """For each table the planes that it chose, as structs (d, p, a): how far the vector is
    from the plane, the plane's place in the table, and on which side the vector lies."""
    rng = random.Random(seed)
    planes = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(PLANES)]
    chosen = [rng.sample(range(PLANES), bits) for _ in range(TABLES)]
    along = F.transform(_constant(planes, "array<array<double>>"), lambda p: dot(p, unit))
    side = lambda a, i, p: bound(F.get(a, i), lambda x: F.struct(F.abs(x).alias("d"), p.alias("p"), (x >= 0).cast("long").alias("a")))
    return bound(along, lambda a: F.transform(_constant(chosen, "array<array<int>>"), lambda t: F.transform(t, lambda i, p: side(a, i, p))))


def _constant(value: list, kind: str) -> Column:
    """One literal, which the optimiser makes of the text once."""
    return F.from_json(F.lit(str(value)), kind)


def hyperplane_keys(sides: Column, bits: int) -> tuple[Column, Column]:
    """(stored, probes): the buckets that a vector lies in, one a table, and those it looks in:
    its own, and those beyond the FLIPS planes that are nearest to it, in all combinations.
    A bucket's number ends in its table's."""
    zero = F.lit(0).cast("long")
    key = lambda s: F.aggregate(s, zero, lambda t, x: t * 2 + x["a"])
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits - 1) - s["p"])
    flips = _constant([[m >> i & 1 for i in range(FLIPS)] for m in range(1 << FLIPS)], "array<array<long>>")
    numbered = lambda q, k: q * TABLES + k
    stored = F.transform(sides, lambda s, k: numbered(key(s), k)).alias("stored")

    def probed(s: Column, k: Column) -> Column:
        masks = F.transform(F.slice(F.array_sort(s), 1, FLIPS), bit)
        change = lambda f, m: F.aggregate(F.zip_with(f, m, lambda on, b: on * b), zero, lambda t, x: t + x)
        return bound(key(s), lambda own: bound(masks, lambda m: F.transform(flips, lambda f: numbered(own.bitwiseXOR(change(f, m)), k))))

    return stored, F.flatten(F.transform(sides, probed)).alias("probes")


# --- blocks, leaders, and exact checks -------------------------------------------

#: Sides of a match: the items themselves, and stored records.
ITEM, RECORD = 0, 1


def _two_sides(items: DataFrame, candidates: DataFrame | None, column: str) -> DataFrame:
    rows = items.select(F.lit(ITEM).alias("side"), F.col("seq").cast("long").alias("id"), F.col(column).alias("content"))
    if candidates is not None:
        rows = rows.unionByName(candidates.select(F.lit(RECORD).alias("side"), F.col("id").cast("long").alias("id"), F.col(column).alias("content")))
    return rows.where(F.col("id").isNotNull())


def maybe_among(keys: DataFrame, columns: list[str], most_bits: int = 1 << 24) -> Column:
    """False only for rows whose columns are not in ``keys``, a saved table: a Bloom filter of
    sixteen bits a key, which goes to the tasks as one constant of ``most_bits`` / 8 bytes at
    most. It keeps wide rows out of the shuffle of a join; with more keys it keeps out fewer.
    """
    bits = 1 << min(most_bits.bit_length() - 1, max(10, (16 * keys.n_rows).bit_length()))
    places = [F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(bits)) for k in range(2)]
    set_bits = (keys.select(F.explode(F.array(*places)).alias("p")).groupBy(F.floor(F.col("p") / 8).alias("byte"))
                .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("value")).toArrow())
    table = np.zeros(bits // 8, np.uint8)
    table[set_bits.column("byte").to_numpy()] = set_bits.column("value").to_numpy()
    constant = F.lit(table.tobytes())
    byte = lambda p: F.conv(F.hex(F.substring(constant, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = F.lit(True)
    for p in places:
        out = out & (F.call_function("getbit", byte(p), (p % 8).cast("int")) == 1)
    return out


class Blocked:
    """Rows that are blocked once and linked as often as needed.

    ``rows`` has side, id, digest (equal for rows that count as the same), stored (the keys of
    the blocks a row lies in) and probes (of those it looks in).
    """

    #: Whether there are no records, and probes are the stored keys.
    items_only = False

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.rows = scratch.save(rows, "blocked")

    def checked(self, pairs: DataFrame) -> DataFrame:
        """links(id, side, other, score) of the pairs(id, side, other) that are similar."""
        raise NotImplementedError

    def _met(self, blocks: DataFrame) -> DataFrame:
        """(id, side, other): a row, and the leader of a block in which it looks."""
        held = blocks.select("side", "id", F.explode("stored").alias("key"))
        first_of = lambda side: F.min(F.when(F.col("side") == side, F.col("id")))
        leaders = held.groupBy("key").agg(first_of(ITEM).alias("item"), first_of(RECORD).alias("record"))
        asked = blocks.where(F.col("side") == ITEM).select("id", F.explode("probes").alias("key"))
        both = F.array(F.struct(F.lit(ITEM).alias("side"), F.when(F.col("item") < F.col("id"), F.col("item")).alias("other")),
                       F.struct(F.lit(RECORD).alias("side"), F.col("record").alias("other")))
        return (asked.join(leaders, "key").where((F.col("item") < F.col("id")) | F.col("record").isNotNull())
                .select("id", F.explode(both).alias("x")).select("id", "x.*").where(F.col("other").isNotNull()))

    def _met_items(self, blocks: DataFrame) -> DataFrame:
        """The same where items look in their own blocks only and there are no records: rows are
        dealt by block once, and the leaders are found where they lie."""
        dealt = (blocks.select("id", F.explode("stored").alias("key")).where(F.col("id").isNotNull() & F.col("key").isNotNull())
                 .repartition("key"))
        leaders = dealt.groupBy("key").agg(F.min("id").alias("other"))
        return dealt.join(leaders, "key").where("other < id").select("id", F.lit(ITEM).alias("side"), "other")

    def links(self, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(classes, links) of all rows, or of the records and the items ``among`` (id).

        classes(side, id, class_id): the earliest row of the side that is the same; links(id,
        side, other, score): a class of items, and an earlier one of items (side 0) or one of
        records (1) that is similar, and that leads a block in which the first one looks.
        """
        scratch, rows = self.scratch, self.rows
        if among is not None:
            rows = rows.where(F.col("side") == RECORD).unionByName(rows.where(F.col("side") == ITEM).join(among, "id", "left_semi"))
        first = rows.groupBy("side", "digest").agg(F.min("id").alias("class_id"))
        classes = scratch.save(rows.select("side", "id", "digest").join(first, ["side", "digest"]), "classes")
        heads = classes.where("id = class_id").select("side", "id", "digest")
        blocks = rows.join(heads.select("side", "id"), ["side", "id"], "left_semi")
        met = self._met_items(blocks) if self.items_only else self._met(blocks)
        pairs = scratch.save(met.distinct(), "pairs")
        mine = heads.where(F.col("side") == ITEM).select("digest", "id")
        stored = heads.where(F.col("side") == RECORD).select("digest", F.col("id").alias("other"))
        copies = mine.join(stored, "digest").select("id", F.lit(RECORD).alias("side"), "other", F.lit(1.0).alias("score"))
        found = self.checked(pairs).unionByName(copies).groupBy("id", "side", "other").agg(F.max("score").alias("score"))
        return classes.drop("digest"), scratch.save(found, "links")


class Texts(Blocked):
    """Texts by the Jaccard similarity of their sets of shingles of ``n`` words.

    A-Z count as lower case, and words are what white space parts. A text of fewer than ``n``
    words is one shingle; rows without words are left out. Sets are of 64-bit hashes.
    """

    def __init__(self, items: DataFrame, candidates: DataFrame | None, column: str = "text",
                 threshold: float = JACCARD, n: int = WORDS, scratch: Scratch | None = None):
        self.threshold, self.n, self.texts = threshold, n, _two_sides(items, candidates, column)
        self.items_only = candidates is None
        signed = text_signatures(self.texts, "content", n).where(F.col("size") > 0)
        super().__init__(signed.withColumnRenamed("keys", "stored").withColumn("probes", F.col("stored")),
                         scratch or Scratch(items.sparkSession, "jaccard"))

    def checked(self, pairs: DataFrame) -> DataFrame:
        sizes = self.rows.select("side", "id", "size", "bits")
        theirs = sizes.withColumnsRenamed({"id": "other", "size": "other_size", "bits": "other_bits"})
        mine = sizes.where(F.col("side") == ITEM).select("id", "size", "bits")
        fits = F.least("size", "other_size") >= F.greatest("size", "other_size") * F.lit(self.threshold)
        differing = F.aggregate(F.zip_with("bits", "other_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        met = pairs.join(theirs, ["side", "other"]).join(mine, "id").where(fits & (differing <= most_differing(self.threshold)))
        pairs = self.scratch.save(met.drop("bits", "other_bits"), "fitting")
        # sets are made again, of the rows that are in a pair only
        ends = (pairs.select(F.lit(ITEM).alias("side"), "id").unionByName(pairs.select("side", F.col("other").alias("id"))).distinct())
        ends = self.scratch.save(ends, "ends")
        texts = self.texts.where(maybe_among(ends, ["side", "id"])).join(ends, ["side", "id"], "left_semi")
        sets = self.scratch.save(text_sets(texts, "content", self.n), "sets")
        theirs = sets.select("side", F.col("id").alias("other"), F.col("tokens").alias("other_tokens"))
        mine = sets.where(F.col("side") == ITEM).select("id", "tokens")
        common = F.size(F.array_intersect("tokens", "other_tokens"))
        score = common / (F.col("size") + F.col("other_size") - common)
        return (pairs.join(theirs, ["side", "other"]).join(mine, "id").select("id", "side", "other", score.alias("score"))
                .where(F.col("score") >= self.threshold))


class Vectors(Blocked):
    """Vectors by cosine in double precision, in Spark's expressions only.

    Vectors that are null, empty, zero, or hold null or non-finite entries are left out;
    vectors of different lengths have no cosine. Buckets have as many bits as the number of
    vectors asks for, so that one in eight vectors meets another in a bucket by chance.
    """

    def __init__(self, items: DataFrame, candidates: DataFrame | None, column: str = "embedding",
                 threshold: float = COSINE, scratch: Scratch | None = None):
        self.threshold = threshold
        scratch = scratch or Scratch(items.sparkSession, "cosine")
        rows = _two_sides(items, candidates, column).withColumn("unit", unit_vector(F.col("content")))
        rows = rows.where(F.col("unit").isNotNull())
        self.units = scratch.save(rows.select("side", "id", "unit", F.sha2(F.to_json(F.struct("unit")), 256).alias("digest")), "units")
        blocked = None
        for dims, count in self.units.groupBy(F.size("unit")).count().collect():  # one row a length of vectors
            bits = max(8, min(56, math.ceil(math.log2(count + 1)) + 3))
            keys = bound(hyperplane_sides(F.col("unit"), dims, bits), lambda s: F.struct(*hyperplane_keys(s, bits)))
            own = self.units.where(F.size("unit") == dims).select("side", "id", "digest", keys.alias("k")).select("side", "id", "digest", "k.*")
            blocked = own if blocked is None else blocked.unionByName(own)
        if blocked is None:
            none = F.array().cast("array<long>")
            blocked = self.units.select("side", "id", "digest", none.alias("stored"), none.alias("probes"))
        super().__init__(blocked, scratch)

    def checked(self, pairs: DataFrame) -> DataFrame:
        theirs = self.units.select("side", F.col("id").alias("other"), F.col("unit").alias("other_unit"))
        mine = self.units.where(F.col("side") == ITEM).select("id", "unit")
        alike = F.when(F.size("unit") == F.size("other_unit"), dot(F.col("unit"), F.col("other_unit")))
        return (pairs.join(theirs, ["side", "other"]).join(mine, "id").select("id", "side", "other", alike.alias("score"))
                .where(F.col("score") >= self.threshold))


def blocked(items: DataFrame, candidates: DataFrame | None = None, method: str = "jaccard", column: str | None = None,
            threshold: float | None = None, scratch: Scratch | None = None) -> Blocked:
    """items(seq, column) and candidates(id, column), blocked by method 'jaccard' or 'cosine'."""
    if method == "jaccard":
        return Texts(items, candidates, column or "text", JACCARD if threshold is None else threshold, scratch=scratch)
    if method == "cosine":
        return Vectors(items, candidates, column or "embedding", COSINE if threshold is None else threshold, scratch=scratch)
    raise ValueError(f"unknown method {method!r}")


def as_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """pairs(seq, cand_seq, record_id, score) for ``greedy_dedup``: every item with what its
    class is linked to, and with the first item of its class."""
    mine = classes.where(F.col("side") == ITEM).select(F.col("id").alias("seq"), "class_id")
    none = F.lit(None).cast("long")
    found = mine.join(links.withColumnRenamed("id", "class_id"), "class_id").select(
        "seq", F.when(F.col("side") == ITEM, F.col("other")).alias("cand_seq"),
        F.when(F.col("side") == RECORD, F.col("other")).alias("record_id"), "score")
    copies = mine.where("seq <> class_id").select("seq", F.col("class_id").alias("cand_seq"), none.alias("record_id"), F.lit(1.0).alias("score"))
    return found.unionByName(copies)


def similar_pairs(items: DataFrame, candidates: DataFrame | None = None, method: str = "jaccard",
                  column: str | None = None, threshold: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """pairs of items(seq, column) with earlier items and with candidates(id, column)."""
    return as_pairs(*blocked(items, candidates, method, column, threshold, scratch).links())


def similar_articles(items: DataFrame, seen: DataFrame) -> DataFrame:
    """pairs of items and records whose titles and texts are similar; a job's ``Models.similar``."""
    whole = lambda df, key, text: df.select(key, X.article_text(F.col("title"), F.col(text)).alias("text"))
    return similar_pairs(whole(items, "seq", "summary"), whole(seen, "id", "description"))


def dedup_similar(items: DataFrame, seen: DataFrame | None = None, candidates: DataFrame | None = None, method: str = "jaccard",
                  column: str | None = None, threshold: float | None = None, scratch: Scratch | None = None, **options) -> DataFrame:
    """``greedy_dedup`` with similar items as its third layer.

    An item is linked to its blocks' leaders, and a leader may turn out to be a duplicate by
    another layer, which leaves the rest of its block without it. So the items found new are
    linked among themselves, where leaders are new, and the decisions made again with those
    links added, until no two new items are similar. ``candidates`` (id, column) are the
    stored records' contents.
    """
    scratch = scratch or Scratch(items.sparkSession, "similar")
    rows = blocked(items, candidates, method, column, threshold, scratch)
    pairs = scratch.save(as_pairs(*rows.links()), "pairs")
    while True:
        decided = scratch.save(greedy_dedup(items, seen, pairs=pairs, scratch=scratch, **options), "decided")
        more = as_pairs(*rows.links(decided.where(~F.col("is_duplicate")).select(F.col("seq").alias("id"))))
        more = scratch.save(more.where(F.col("cand_seq").isNotNull()), "more")
        if not more.n_rows:
            return decided
        pairs = scratch.save(pairs.unionByName(more), "pairs")


def similar_groups(classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, class_id, group_id) of the items: the smallest id that links between items reach."""
    mine = classes.where(F.col("side") == ITEM).select("id", "class_id")
    within = links.where(F.col("side") == ITEM).select(F.col("id").alias("a"), F.col("other").alias("b"))
    found = smallest_reached(within, scratch).select(F.col("node").alias("class_id"), "group_id")
    return mine.join(found, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))


def smallest_reached(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, group_id) of every node of links(a, b): the smallest node of its component.

    Each round a node takes the smallest label of its neighbours, then its label's label, so
    chains halve. It ends when a round changes no label, which its write counts; a count of
    zero is zero however often a task runs.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    labels = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    changed = both.n_rows
    while changed:
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "of_b"}), "b").groupBy("a").agg(F.min("of_b").alias("near"))
        seen = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        moved = seen.join(jump, "low").select("node", F.least("low", "lower").alias("new"), "label")
        turned = scratch.save(moved.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels", n_moved=F.count_if("moved"))
        scratch.drop(labels)
        labels, changed = turned.select("node", "label"), turned.metrics["n_moved"]
    return labels.select("node", F.col("label").alias("group_id"))
