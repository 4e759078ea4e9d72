"""A wavelet matrix over the token ids of one shard, kept as one compressed blob.

Layout of a blob (little endian): magic ``WVM1``, u32 header length, a JSON header, then the parts that the
header lists as (name, offset, length), each a zstandard frame. Parts: the document table (``docs``, ``starts``),
and for every bit plane from the most significant one the packed bits (``p0``, ``p1``, ...) and a rank directory
with the number of ones before every block of 512 bits (``r0``, ``r1``, ...). A reader inflates only the planes it needs.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVM1"
BLOCK = 512  # bits between two entries of a rank directory


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, starts: np.ndarray, bits: int, level: int = 1) -> bytes:
    """Blob of the shard with these token ids; ``starts`` has one entry per document and the total at its end."""
    squeeze = zstandard.ZstdCompressor(level=level)
    parts, zeros = {"docs": doc_ids.astype("<i8").tobytes(), "nulls": np.packbits(doc_null.astype(bool)).tobytes(), "starts": starts.astype("<u4").tobytes()}, []
    order = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    spare = np.empty_like(order)
    for k in range(bits):
        bit = (order & order.dtype.type(1 << (bits - 1 - k))).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.uint32) if len(padded) else np.zeros(0, np.uint32)
        rank = np.zeros(len(ones) + 1, "<u4")
        np.cumsum(ones, out=rank[1:])
        parts[f"p{k}"], parts[f"r{k}"] = packed.tobytes(), rank.tobytes()
        zeros.append(int(len(order) - rank[-1]))
        np.compress(~bit, order, out=spare[: zeros[-1]])
        np.compress(bit, order, out=spare[zeros[-1] :])
        order, spare = spare, order
    frames = {k: squeeze.compress(v) for k, v in parts.items()}
    where, at = {}, 0
    for k, v in frames.items():
        where[k] = (at, len(v))
        at += len(v)
    head = json.dumps({"n": int(len(ids)), "docs": int(len(doc_ids)), "bits": bits, "zeros": zeros, "parts": where}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(frames.values())


class Shard:
    """Reads a blob: ``tokens``, ``access``, ``count`` and ``locate``."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (n,) = struct.unpack("<I", blob[4:8])
        self.head, self._blob, self._from = json.loads(blob[8 : 8 + n]), blob, 8 + n
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _part(self, name: str) -> bytes:
        at, n = self.head["parts"][name]
        return zstandard.ZstdDecompressor().decompress(self._blob[self._from + at : self._from + at + n])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, which of them are null, and the starts (with the total at the end)."""
        n = self.head["docs"]
        return np.frombuffer(self._part("docs"), "<i8"), np.unpackbits(np.frombuffer(self._part("nulls"), np.uint8), count=n).astype(bool), np.frombuffer(self._part("starts"), "<u4").astype(np.int64)

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            packed = np.frombuffer(self._part(f"p{k}"), np.uint8)
            padded = np.zeros((-(-len(packed) // 64) or 1) * 64, np.uint8)
            padded[: len(packed)] = packed
            self._planes[k] = padded.view(np.uint64), np.frombuffer(self._part(f"r{k}"), "<u4").astype(np.int64)
        return self._planes[k]

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each position."""
        words, rank = self._plane(k)
        block = at // BLOCK
        total = rank[np.minimum(block, len(rank) - 1)].copy()
        inside = at % BLOCK
        for j in range(BLOCK // 64):
            left = np.clip(inside - 64 * j, 0, 64).astype(np.uint64)
            word = words[np.minimum(block * 8 + j, len(words) - 1)]
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
            total += np.bitwise_count(word & mask).astype(np.int64)
        return total

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        words, _ = self._plane(k)
        return (words[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)

    def access(self, at) -> np.ndarray:
        """Tokens at these positions, by walking down the planes."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for k in range(self.bits):
            one, ones = self._bit(k, at), self._rank1(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
            out = out << np.uint32(1) | one
        return out

    def _interval(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            r = self._rank1(k, np.array([lo, hi], np.int64))
            lo, hi = (self.zeros[k] + int(r[0]), self.zeros[k] + int(r[1])) if token >> (self.bits - 1 - k) & 1 else (lo - int(r[0]), hi - int(r[1]))
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token between two positions."""
        if token >> self.bits or not self.n:
            return 0
        a, b = self._interval(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """Positions of a token, ascending: its interval at the bottom is carried up by select."""
        if token >> self.bits or not self.n:
            return np.zeros(0, np.int64)
        lo, hi = self._interval(token, 0, self.n)
        at = np.arange(lo, hi)
        for k in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - k) & 1
            at = self._select(k, at - self.zeros[k] * one, one)
        return at

    def _select(self, k: int, nth: np.ndarray, one: int) -> np.ndarray:
        """Positions of the nth (from 0) ones or zeros of plane ``k``."""
        words, rank = self._plane(k)
        before = rank if one else np.minimum(np.arange(len(rank)) * BLOCK, self.n) - rank
        block = np.searchsorted(before, nth, side="right") - 1
        out = np.empty(len(nth), np.int64)
        for b in np.unique(block):
            here = block == b
            bits = np.unpackbits(words[b * 8 : b * 8 + 8].view(np.uint8), bitorder="little")
            found = np.flatnonzero(bits[: max(0, self.n - b * BLOCK)] == one)
            out[here] = b * BLOCK + found[nth[here] - before[b]]
        return out

    def tokens(self) -> np.ndarray:
        """All token ids in order: the stable partitions undone from the last plane to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            bit = np.unpackbits(np.frombuffer(self._part(f"p{k}"), np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            if self.zeros[k]:
                np.place(up, ~bit, out[: self.zeros[k]])
            if self.zeros[k] < self.n:
                np.place(up, bit, out[self.zeros[k] :] | out.dtype.type(1 << (self.bits - 1 - k)))
            out = up
        return out
