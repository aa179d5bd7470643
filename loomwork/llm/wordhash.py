"""Vectorised word splitting and hashing for batches of whole texts.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` (bytes; UTF-8 never contains those bytes inside a character).
All hashes are 64-bit and depend only on the bytes of the words, never on the place, process or batch, so they can
be compared between tasks.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _S32)
    x = x * _C3
    x = x ^ (x >> _S29)
    x = x * _C1
    return x ^ (x >> _S32)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _C1 + (b ^ (b >> _S32)) * _C2 + _C3)


class Words:
    """The words of a batch: byte spans, hashes and, for each document, where its words begin and end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        raw = b" " + b" ".join(texts) + b" " * 9
        self.raw = raw
        buf = np.frombuffer(raw, np.uint8)
        ws = _WS[buf]
        edges = np.flatnonzero(ws[1:] != ws[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        first_byte = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
        self.first = np.searchsorted(self.starts, first_byte)
        self.last = np.searchsorted(self.starts, first_byte + sizes)
        self.hashes = self._hash(buf)

    def _hash(self, buf: np.ndarray) -> np.ndarray:
        lanes = np.lib.stride_tricks.as_strided(np.frombuffer(buf.data, np.uint64, 1), (len(buf) - 7,), (1,))
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) * _C2)
        live, at = None, 0
        starts, left = self.starts, size
        while len(starts):
            lane = lanes[starts + at] & _MASKS[np.minimum(left, 8)]
            if live is None:
                h = mix((h ^ lane) * _C1 + _C2)
                live = np.flatnonzero(size > 8)
            else:
                h[live] = mix((h[live] ^ lane) * _C1 + _C2)
                live = live[left > 8]
            at += 8
            starts, left = self.starts[live], size[live] - at
        return h

    def counts(self) -> np.ndarray:
        return self.last - self.first

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.counts())


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes, built by doubling; it ignores document limits (mask these outside)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = len(h) - (done + size) + 1
                out = pair(out[:m], power[done : done + m])
            done += size
        if size * 2 > n:
            return out[: len(h) - n + 1]
        power = pair(power[: len(power) - size], power[size:])
        size *= 2


def batches(rows: Iterator[tuple], size_of, most: int = 1_000_000) -> Iterator[list[tuple]]:
    """Lists of rows of about ``most`` bytes of text; one longer text makes a list of its own."""
    held, total = [], 0
    for row in rows:
        n = size_of(row)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += n
    if held:
        yield held
