"""Edit-distance join of strings by segments, of characters and of words.

A string within k edits of another contains one of its k + 1 segments unchanged, near
the segment's place. Which places need probing follows from the segment's number and
the difference of lengths. Candidates are verified by a bit-parallel edit distance that
computes a band of 2k + 1 diagonals per column.

Edits of characters are few whatever the length; edits of words grow with it. Strings
within k edits of words share a run whose length follows from theirs (``run_length``).
Each string chooses, of every so many following runs of GRAM words, the one of the
smallest hash. The least of a longer window is the least of each shorter one that holds
it, so two strings choose the same in the run they share, wherever it stands and whatever
the windows of each. These hashes are the keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

from feedtriage.llm.shingles import mix

#: Strings shorter than this join with nothing; of SECOND or more they may differ by two edits.
SHORTEST, SECOND = 40, 200
#: Strings of so many words or more may differ in one word of as many.
TWENTIETH = 20
#: Words of the runs that are hashed; strings of TWENTIETH words share ten.
#: Shorter runs recur in prose: runs of five words put half of all lines into one cluster.
GRAM = 8
#: From so many words on, two edits of characters are within those of words for both strings.
BY_WORDS = 82
#: From so many words on, strings within two edits of characters share a run of words that both choose from.
BY_RUNS = 40
#: Characters of which the keys are made at once: their sums fit a core's cache.
SLICE = 100_000
#: So many strings or fewer are compared with each other without keys.
FEW = 16
#: Bits of the sketch of a string's words, of which the first are looked at first.
SKETCH, FIRST = 1024, 256

_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Values of characters by their lower bits; such a key may be equal by chance, which costs a comparison.
_CODE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: Whether str.split() splits there; the last one stands for all characters beyond.
_WHITE = np.array([chr(c).isspace() for c in range(0x3002)])


def edits(length: int) -> int:
    """Edits allowed between strings whose shorter one has this length; -1: no join."""
    return -1 if length < SHORTEST else 1 if length < SECOND else 2


def word_edits(n_words: int) -> int:
    """Edits allowed between the words of strings whose shorter one has so many; -1: no join."""
    return -1 if n_words < TWENTIETH else n_words // TWENTIETH


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Start and size of the k + 1 segments of a string, sizes differing by one at most."""
    size, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i >= k + 1 - more)
        out.append((at, n))
        at += n
    return out


def index_keys(text: str) -> Iterator[int]:
    """Keys of the string's own segments, which are among those it probes."""
    n = len(text)
    k = edits(n)
    for i, (at, size) in enumerate(segments(n, k) if k >= 0 else ()):
        yield xxhash.xxh64_intdigest(text[at:at + size], seed=n << 3 | i)


@lru_cache(maxsize=20_000)
def probes(n: int, shortest: int, second: int) -> list[tuple[int, int, int]]:
    """Start, end and seed of the substrings of a string of length n that may equal segments
    of strings of its length or less. The other arguments name the limits of ``edits``."""
    out = []
    for length in range(n - edits(n) if edits(n) > 0 else n, n + 1):
        k, more = edits(length), n - length
        if k < more:
            continue
        for i, (at, size) in enumerate(segments(length, k)):
            low = max(0, at - i, at + more - (k - i))
            high = min(n - size, at + i, at + more + (k - i))
            out += [(start, start + size, length << 3 | i) for start in range(low, high + 1)]
    return out


def probe_keys(text: str) -> list[int]:
    """Keys of the segments of strings of its length or less that its substrings can equal."""
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], seed) for a, b, seed in probes(len(text), SHORTEST, SECOND)]


@lru_cache(maxsize=100_000)
def run_length(n_words: int) -> int:
    """Words that a string of so many surely shares, in one run, with each shorter one (or
    one of its length) that is within the shorter one's edits: m words with k edits leave
    k + 1 runs, the longest of (m - k) / (k + 1) words or more."""
    shortest = max(TWENTIETH, n_words * TWENTIETH // (TWENTIETH + 1) - 1)
    return min(-(-(m - word_edits(m)) // (word_edits(m) + 1))
               for m in range(shortest, n_words + 1) if m + word_edits(m) >= n_words)


@lru_cache(maxsize=100_000)
def common_run(n_words: int) -> int:
    """``run_length``, or less where lines of so many words have no keys but those of runs.
    An edit of characters changes two words at most, so m words with two edits leave m - 4
    in three runs; the other string has two words less at most."""
    return min(run_length(n_words), -(-(n_words - 6) // 3)) if n_words >= BY_RUNS - 2 else run_length(n_words)


@lru_cache(maxsize=1)
def _kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    powers, back = np.full(n, _BASE), np.full(n, _INVERSE)
    powers[0] = back[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(back)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, or some more, and their inverses."""
    return _kept_powers(2 * SLICE) if n <= 2 * SLICE else _kept_powers.__wrapped__(n)


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by powers, and the inverse powers: a stretch's hash is the difference
    of two sums, divided by the power at its start, so it does not depend on its place."""
    powers, back = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:len(values)], out=sums[1:])
    return sums, back


def _chosen(own: np.ndarray, sizes: np.ndarray, run) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines, ascending, and the hashes of their chosen runs of words. ``own``
    has the hashes of the words, line after line, ``sizes`` the number of each line's, and
    ``run`` gives the words of a shared run."""
    taking = np.array([i for i, k in enumerate(sizes.tolist()) if word_edits(k) >= 0], np.int64)
    if not len(taking):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    widths = np.array([run(k) - GRAM + 1 for k in sizes[taking].tolist()])
    order = np.argsort(widths, kind="stable")
    firsts = (np.cumsum(sizes) - sizes)[taking[order]]
    taking, widths, sizes = taking[order], widths[order], sizes[taking[order]]
    ends = np.cumsum(sizes)
    sums, back = _sums(own[np.repeat(firsts - ends + sizes, sizes) + np.arange(ends[-1])])
    n = int(ends[-1]) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[:n])
    owner = np.repeat(np.arange(len(taking)), sizes)[:n]
    found = np.zeros(n, np.uint64)
    stops = np.searchsorted(widths, widths, side="right")
    first = 0
    while first < len(taking):  # the lines of one width follow each other
        width, stop = int(widths[first]), int(stops[first])
        low, high = int(ends[first] - sizes[first]), min(int(ends[stop - 1]), n)
        least, wide = grams[low:high], 1
        while wide < width:  # the least of twice as many runs, or of as many as are wanted
            step = min(wide, width - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        found[low:low + len(least)] = least
        first = stop
    # Following windows mostly choose the same run. A window must end in its own line.
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    new &= np.arange(n) + np.repeat(widths + GRAM - 1, sizes)[:n] <= np.repeat(ends, sizes)[:n]
    places, found = taking[owner[new]], found[new]
    order = np.argsort(places, kind="stable")
    return places[order], found[order]


def word_keys(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines, ascending, and the hashes of their chosen runs of words; none
    for lines of too few words. A run that a line repeats may come more than once. All lines
    are worked on at once."""
    words = list(chain.from_iterable(lines))
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return _chosen(own, np.array([len(x) for x in lines], np.int64), run_length)


@lru_cache(maxsize=20_000)
def _probe_table(n: int, shortest: int, second: int) -> np.ndarray:
    """The starts, the ends and the seeds of ``probes``."""
    return np.array(probes(n, shortest, second), np.int64).reshape(-1, 3).T


def _slices(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Lines of SLICE characters or little more, with the place of the first; a long line may be alone."""
    start, size = 0, 0
    for i, line in enumerate(lines):
        if size and size + len(line) >= SLICE:
            yield start, lines[start:i]
            start, size = i, 0
        size += len(line) + 1
    if lines:
        yield start, lines[start:]


def _slice_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lines], np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    sums, back = _sums(_CODE[codes & 0xFFFF])
    white = np.ones(len(codes) + 1, bool)
    white[1:] = _WHITE[np.minimum(codes, len(_WHITE) - 1)]
    turns = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = turns[::2], turns[1::2]
    n_words = np.diff(np.searchsorted(starts, np.append(firsts, len(codes))))
    places, keys = _chosen(mix((sums[ends] - sums[starts]) * back[starts]), n_words, common_run)
    probing = np.flatnonzero((n_words < BY_RUNS) & (sizes >= SHORTEST))
    if not len(probing):
        return places, keys
    tables = [_probe_table(n, SHORTEST, SECOND) for n in sizes[probing].tolist()]
    owner = np.repeat(probing, [t.shape[1] for t in tables])
    low, high, seeds = np.concatenate(tables, axis=1)
    low, high = low + firsts[owner], high + firsts[owner]
    probed = mix((sums[high] - sums[low]) * back[low] ^ mix(seeds.astype(np.uint64)))
    return np.concatenate([places, owner]), np.concatenate([keys, probed])


def keys_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines and their keys, of which two lines that join share one. Lines of
    fewer words than BY_RUNS have those of ``probes``, all others of runs of words only."""
    found = [(start + places, keys) for start, part in _slices(lines) for places, keys in [_slice_keys(part)]]
    none = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    places, keys = zip(*(found or none))
    return np.concatenate(places), np.concatenate(keys)


def all_keys(text: str) -> set[int]:
    """The keys of one line."""
    return set(keys_of([text])[1].tolist())


def within(a: str | list[str], b: str | list[str], k: int) -> bool:
    """Whether the edit distance is at most k.

    Bit t of the vectors stands for row j - k + t of column j, so the band moves down one
    row a column. Along the diagonal of the last cell the distance grows by one where the
    diagonal bit is not set. Only rows that the band has reached are looked at, so strings
    that soon differ cost little, whatever their length.
    """
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= k
    places: dict[str, int] = {}
    for i, c in enumerate(a[:k]):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << width - 1
    diagonal = len(a) - len(b)
    bit, distance = 1 << diagonal + k, max(diagonal, 0)
    up, down = full ^ ((1 << k) - 1), 0  # in column 0 each row from 1 on is one more than the last
    for j, c in enumerate(b, 1):
        at, last = j - k - 1, j + k - 1
        if last < len(a):
            places[a[last]] = places.get(a[last], 0) | 1 << last
        equal = places.get(c, 0)
        equal = (equal >> at if at >= 0 else equal << -at) & full
        level = ((((equal & up) + up) ^ up) | equal | down) & full
        right_up = down | (full & ~(level | up))
        right_down = level & up
        if not level & bit:
            distance += 1
            if distance > k:
                return False
        up = (right_down | (full & ~(level >> 1 | right_up))) | top
        down = level >> 1 & right_up & ~top
    return distance <= k


def most_apart(n_words: int) -> tuple[int, int]:
    """How many words more one of two strings that join can have, if the one with fewer has so
    many, and how many words, with repeats, each of them can have that the other has not. An edit
    of characters changes two words to at most two, and their number by one at most."""
    by_words = max(word_edits(n_words), 0)
    return max(by_words, edits(SECOND)), max(by_words, 2 * edits(SECOND))


def sketches(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each line, and a row of SKETCH bits in which its words are set; a
    word that a line repeats counts as another one each time."""
    bits = np.zeros((len(lines), SKETCH // 64), np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(chain.from_iterable(lines))}
    for row, words in zip(bits, lines):
        own = np.sort(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        times = np.arange(len(own)) - np.searchsorted(own, own)
        places = (mix(own + times.astype(np.uint64) * _BASE) % np.uint64(SKETCH)).astype(np.int64)
        np.bitwise_or.at(row, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
    return np.array([len(x) for x in lines], np.int64), bits


def close_groups(n_words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The place of one line of the group of each, given their ``sketches``: two lines that join are in
    one group. Lines that a chain of close ones connects are, too."""
    order = np.argsort(n_words, kind="stable")
    n_words, bits = n_words[order], bits[order]
    bounds = {n: most_apart(n) for n in np.unique(n_words).tolist()}
    stops = np.searchsorted(n_words, [n + bounds[n][0] for n in n_words.tolist()], side="right")
    group = np.arange(len(order))
    first = FIRST // 64
    for i in range(len(order) - 1):
        others = i + 1 + np.flatnonzero(group[i + 1:stops[i]] != group[i])
        most = bounds[int(n_words[i])][1]
        for part in (slice(0, first), slice(first, None)):
            own, theirs = bits[i, part], bits[others, part]
            more, less = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (theirs & ~own, own & ~theirs))
            others = others[(more <= most) & (less <= most)]
        if len(others):
            group[np.isin(group, np.append(group[others], group[i]))] = group[i]
    out = np.empty(len(order), np.int64)
    out[order] = order[group]
    return out


def _apart(a: set[str], b: set[str], k: int) -> bool:
    """Whether one of the sets has more than k words that the other has not."""
    both = len(a & b)
    return len(a) - both > k or len(b) - both > k


def _by_characters(a: str, b: str, a_set: set[str], b_set: set[str]) -> bool:
    """Whether two strings, the shorter one first, are within their edits of characters."""
    k = edits(len(a))
    return k >= 0 and len(b) - len(a) <= k and not _apart(a_set, b_set, 2 * k) and within(a, b, k)


def _by_words(a: list[str], b: list[str], a_set: set[str], b_set: set[str]) -> bool:
    """Whether two strings are within their edits of words."""
    k = word_edits(min(len(a), len(b)))
    return k >= 0 and abs(len(a) - len(b)) <= k and not _apart(a_set, b_set, k) and within(a, b, k)


class _Index:
    """Strings by their keys. Those of one key lie in lists of strings known to be of one
    component, so that a string that joins one of a list is not compared with the others."""

    def __init__(self, find, unite):
        self.find, self.unite, self.lists = find, unite, {}

    def probe(self, i: int, keys, alike) -> None:
        """Unite i with the strings that share a key and for which ``alike`` holds."""
        seen = set()
        for key in keys:
            for held in self.lists.get(key, ()):
                if self.find(held[0]) == self.find(i):
                    continue
                for j in held:
                    if j not in seen:
                        seen.add(j)
                        if alike(j, i):
                            self.unite(i, j)
                            break

    def add(self, i: int, keys) -> None:
        for key in set(keys):
            lists = self.lists.setdefault(key, [])
            own = [held for held in lists if self.find(held[0]) == self.find(i)]
            if not own:
                lists.append([i])
                continue
            own[0].append(i)
            for held in own[1:]:
                own[0] += held
            if len(own) > 1:
                self.lists[key] = [x for x in lists if not any(x is y for y in own[1:])]


def join(texts: list[str]) -> list[int]:
    """The component of each string, as the place of one of its strings."""
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i]))
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(i: int, j: int) -> None:
        root[find(i)] = find(j)

    words = [t.split() for t in texts]
    sets = [set(w) for w in words]
    by_characters = lambda j, i: _by_characters(texts[j], texts[i], sets[j], sets[i])
    by_words = lambda j, i: _by_words(words[j], words[i], sets[j], sets[i])
    if len(texts) <= FEW:
        for n, i in enumerate(order):
            for j in order[:n]:
                if find(i) != find(j) and (max(len(words[i]), len(words[j])) < BY_WORDS and by_characters(j, i) or by_words(j, i)):
                    unite(i, j)
        return [find(i) for i in range(len(texts))]
    index = _Index(find, unite)
    for i in order:
        if len(words[i]) < BY_WORDS:
            index.probe(i, probe_keys(texts[i]), by_characters)
            index.add(i, index_keys(texts[i]))
    index = _Index(find, unite)
    places, found = word_keys(words)
    chosen = [k.tolist() for k in np.split(found, np.searchsorted(places, np.arange(1, len(texts))))]
    for i in sorted(range(len(texts)), key=lambda i: (len(words[i]), texts[i])):
        index.probe(i, chosen[i], by_words)
        index.add(i, chosen[i])
    return [find(i) for i in range(len(texts))]
