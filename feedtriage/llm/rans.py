"""Range asymmetric numeral systems with a static table, in interleaved lanes.

A block of ids is dealt to LANES states in turn, which share one stream of 32-bit words: at
each step all lanes code one id, and those that run over (or dry) write (or read) one word
in lane order. Steps work on the lanes of many blocks at once, in numpy.

Every EVERY steps the encoder notes the states and the place in the stream. From any such
checkpoint decoding can start, so the stretches between checkpoints are decoded side by side,
and each must end in the states that the next one begins with.

Block: header (magic, version, bits, lanes, ids, steps per checkpoint, words, CRC-32 of the
ids as 32-bit integers), checkpoints (place, states), words, CRC-32 of all before; all
little-endian.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LANES, EVERY = 64, 256
_LOW = np.uint64(1 << 31)  # states lie in [2^31, 2^63)
_WORD = np.uint64(32)
_HEADER = struct.Struct("<4sBBHIIII")
_MAGIC, _VERSION = b"RANS", 1


def quantised(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(frequencies, bits): shares of 2**bits in proportion to positive counts, one at least."""
    bits = max(12, len(counts).bit_length() + 2)
    share = counts / counts.sum() * (1 << bits)
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    spare = (1 << bits) - int(freq.sum())
    if spare > 0:
        freq[np.argsort(-(share - freq), kind="stable")[:spare % len(freq)]] += 1
        freq[:] += spare // len(freq)
    for i in np.argsort(-freq, kind="stable"):  # the ones above took more than there is
        if spare >= 0:
            break
        taken = min(-spare, int(freq[i]) // 2)
        freq[i], spare = freq[i] - taken, spare + taken
    return freq, bits


@dataclass
class Table:
    """Frequencies of the ids that occur, shared by all blocks of a file."""
    ids: np.ndarray
    freq: np.ndarray
    bits: int

    def __post_init__(self):
        ends = np.cumsum(self.freq)
        if len(self.ids) and ends[-1] != 1 << self.bits:
            raise ValueError("frequencies do not fill the table")
        size = int(self.ids.max(initial=0)) + 1
        self.freq_of, self.start_of = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq_of[self.ids], self.start_of[self.ids] = self.freq, ends - self.freq
        self.id_at = np.repeat(self.ids.astype(np.uint32), self.freq)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        return cls(ids, *quantised(counts)) if len(ids) else cls(ids, counts, 0)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """The blocks (arrays of ids, none empty) as bytes, coded side by side."""
        sizes = np.array([len(b) for b in blocks])
        steps = -(-sizes // LANES)
        most, bits = int(steps.max()), np.uint64(self.bits)
        ids = np.full((len(blocks), most * LANES), blocks[0][0], np.uint32)
        for row, block in zip(ids, blocks):
            row[:len(block)] = block
        ids = ids.reshape(len(blocks), most, LANES)
        place = np.arange(LANES)
        x = np.full((len(blocks), LANES), _LOW)
        words, written = np.empty((most, len(blocks), LANES), np.uint32), np.empty((most, len(blocks), LANES), bool)
        states: dict[int, np.ndarray] = {}
        for t in reversed(range(most)):
            freq, start = self.freq_of[ids[:, t]], self.start_of[ids[:, t]]
            over = x >= freq << (np.uint64(63) - bits)
            whole = (t + 1) * LANES <= sizes.min()
            if not whole:
                live = t * LANES + place < sizes[:, None]
                over &= live
            words[t], written[t] = x.astype(np.uint32), over
            y = np.where(over, x >> _WORD, x)
            turns = y // freq
            y = (turns << bits) + (y - turns * freq) + start
            x = y if whole else np.where(live, y, x)
            if t % EVERY == 0:
                states[t] = x
        before = np.cumsum(written.sum(2, dtype=np.int64), axis=0)
        out = []
        for g, block in enumerate(blocks):
            stream = words[:, g][written[:, g]]
            head = _HEADER.pack(_MAGIC, _VERSION, self.bits, LANES, len(block), EVERY, len(stream), zlib.crc32(block.astype("<u4").tobytes()))
            marks = b"".join(struct.pack("<I", before[t - 1, g] if t else 0) + states[t][g].astype("<u8").tobytes() for t in range(0, int(steps[g]), EVERY))
            body = head + marks + stream.astype("<u4").tobytes()
            out.append(body + struct.pack("<I", zlib.crc32(body)))
        return out

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The ids of blocks; all stretches between checkpoints side by side. A damaged block
        raises ValueError."""
        parsed = [_Block(p, self.bits) for p in payloads]
        streams = np.concatenate([b.words for b in parsed] + [np.zeros(LANES, np.uint32)]).astype(np.uint64)
        begins = np.cumsum([0] + [len(b.words) for b in parsed])
        sizes = np.concatenate([np.diff(np.append(np.arange(0, b.n, b.every * LANES), b.n)) for b in parsed])
        x = np.concatenate([b.states for b in parsed])
        ends = np.concatenate([np.concatenate([b.states[1:], np.full((1, LANES), _LOW)]) for b in parsed])
        at = np.concatenate([b.places + begin for b, begin in zip(parsed, begins)])
        most, bits, mask = int(-(-sizes.max() // LANES)), np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        ids, place = np.empty((most, len(sizes), LANES), np.uint32), np.arange(LANES)
        for t in range(most):
            slot = x & mask
            ids[t] = found = self.id_at[slot]
            y = self.freq_of[found] * (x >> bits) + slot - self.start_of[found]
            dry = y < _LOW
            if (t + 1) * LANES > sizes.min():
                live = t * LANES + place < sizes[:, None]
                y, dry = np.where(live, y, x), dry & live
            turn = np.cumsum(dry, axis=1)
            word = streams[np.where(dry, at[:, None] + turn - 1, 0)]
            x = np.where(dry, (y << _WORD) | word, y)
            at = at + turn[:, -1]
        if (x != ends).any():
            raise ValueError("a stretch does not end where the next begins")
        stretches = [s[:n] for s, n in zip(ids.transpose(1, 0, 2).reshape(len(sizes), -1), sizes)]
        out, k = [], 0
        for b in parsed:
            block = np.concatenate(stretches[k:k + len(b.states)])
            k += len(b.states)
            if zlib.crc32(block.astype("<u4").tobytes()) != b.ids_crc:
                raise ValueError("ids do not match their checksum")
            out.append(block)
        return out


class _Block:
    """A block's parts, checked."""

    def __init__(self, payload: bytes, bits: int):
        if len(payload) < _HEADER.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("a block does not match its checksum")
        magic, version, own_bits, lanes, self.n, self.every, size, self.ids_crc = _HEADER.unpack_from(payload)
        if (magic, version, own_bits, lanes) != (_MAGIC, _VERSION, bits, LANES):
            raise ValueError("not a block of this format and table")
        count = -(-self.n // (self.every * LANES))
        kind = np.dtype([("place", "<u4"), ("states", "<u8", (LANES,))])
        marks = np.frombuffer(payload, kind, count, _HEADER.size)
        self.states, self.places = marks["states"].astype(np.uint64), marks["place"].astype(np.int64)
        self.words = np.frombuffer(payload, "<u4", size, _HEADER.size + count * kind.itemsize)


def _zeros_after(crc: int, n: int) -> int:
    """What a CRC-32 without its inversions becomes after ``n`` zero bytes: it is multiplied
    by x^(8n), in the field of its polynomial (low bits are high powers)."""
    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, e = 1 << 31, 1 << 30, 8 * n
    while e:
        if e & 1:
            power = times(power, square)
        square, e = times(square, square), e >> 1
    return times(power, crc)


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a text of bytes whose parts have these (CRC-32, size)."""
    crc = 0
    for own, size in parts:
        crc = _zeros_after(crc, size) ^ own
    return crc
