"""A log-frequency Bloom filter in segments: approximate counts of 64-bit keys in about one byte per key.

A count c is quantised to q = 1 + floor(log_base c), and the key is stored q times, tagged 1 .. q. Asking probes
tags in turn until one is missing. A key that was never stored is found with the small error rate of the bits
alone, and each further step of error is as unlikely again. Counts are never taken too low.
"""

from __future__ import annotations

import numpy as np

from .common import MASK, mix

BASE = 1.5
BITS_PER_ENTRY = 10
HASHES = 7
#: Keys looked at together, few enough for the cache.
ASKED = 1 << 15


def quantised(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


def values(most: int = 120) -> np.ndarray:
    """What a quantised count stands for: the middle of the whole numbers in its range; 0 for none."""
    low = np.ceil(BASE ** np.arange(most) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.arange(1, most + 1) - 1e-9) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Rising with the key, so sorted keys of a segment stand together."""
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray, segments: int):
    """(segment, start, stop) of the segments that sorted keys fall into."""
    own = segment_of(keys, segments)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    return zip(own[first].tolist(), first.tolist(), np.append(first[1:], len(own)).tolist())


def _tagged(keys: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """First hash of the tagged keys, and the step to each further one."""
    a = mix(keys + np.uint64(tag * 0x9E3779B97F4A7C15 & MASK))
    return a, mix(a) | np.uint64(1)


def _place(a: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    """Bit positions below ``size``."""
    place = a >> np.uint64(32)
    place *= size
    place >>= np.uint64(32)
    return place.view(np.int64)


def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of one segment, sized by what it stores. Segments stay below 2**32 bits."""
    q = quantised(counts)
    bits = np.zeros(-(-max(int(q.sum()), 1) * BITS_PER_ENTRY // 8), np.uint8)
    flat = np.zeros(len(bits) * 8, bool)
    for tag in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= tag], q[q >= tag]
        a, step = _tagged(keys, tag)
        for _ in range(HASHES):
            flat[_place(a, np.uint64(len(flat)))] = True
            a = a + step
    return np.packbits(flat, bitorder="little").tobytes()


class Filter:
    """Segments put together for asking. ``parts``: (segment, bits); segments without one hold nothing."""

    def __init__(self, segments: int, parts: list[tuple[int, bytes]]):
        self.segments = segments
        self.start, self.size = np.zeros(segments, np.int64), np.zeros(segments, np.int64)
        at = 0
        parts = sorted(parts, key=lambda part: part[0])
        for s, bits in parts:
            self.start[s], self.size[s] = at * 8, len(bits) * 8
            at += len(bits)
        self.bits = np.frombuffer(b"".join(b for _, b in parts), np.uint8)

    def ask(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, 0 for absent. Of sorted keys, those looked at together lie in few segments."""
        out = np.zeros(len(keys), np.uint8)
        for at in range(0, len(keys), ASKED):
            self._ask(keys[at:at + ASKED], out[at:at + ASKED])
        return out

    def _ask(self, keys: np.ndarray, out: np.ndarray) -> None:
        own = segment_of(keys, self.segments)
        alive = np.flatnonzero(self.size[own] > 0)
        keys, own = keys[alive], own[alive]
        start, size = self.start[own], self.size[own].astype(np.uint64)
        tag = 1
        while len(alive):
            a, step = _tagged(keys, tag)
            here, base, wide = np.arange(len(keys)), start, size
            hit = np.ones(len(keys), bool)
            for n in range(HASHES):
                place = _place(a, wide)
                place += base
                hit &= (self.bits.take(place >> 3, mode="clip") >> (place.astype(np.uint8) & np.uint8(7)) & np.uint8(1)).view(bool)
                if n in (0, 2, HASHES - 1):  # seldom, as most keys that pass the first hashes pass all
                    here = here[hit]
                    if n < HASHES - 1 and len(here) < len(hit):
                        a, step, base, wide, hit = a[hit], step[hit], base[hit], wide[hit], hit[hit]
                a += step
            out[alive[here]] = tag
            if len(here) < len(alive):
                alive, keys, start, size = alive[here], keys[here], start[here], size[here]
            tag += 1
