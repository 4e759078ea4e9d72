"""Bit-sliced Hamming distances: 64 fingerprints side by side in one machine word per bit plane.

The planes are stored vertically: word ``planes[k, w]`` has bit ``k`` of the 64 fingerprints of block ``w``.
A query is compared with all 64 at once by exclusive or with its own bit, and the differing bits are added up by a
carry-save counter: ``c[j]`` holds bit j of the 64 running distances, ``over`` the lanes beyond the radius. A (query, block)
pair is abandoned as soon as all its lanes are over.
"""

from __future__ import annotations

import numpy as np

ALL = ~np.uint64(0)
CHECK_EVERY = 8  # planes between two looks for blocks to abandon
AT_ONCE = 1 << 16  # (query, block) pairs in memory


def slice_planes(prints: np.ndarray) -> np.ndarray:
    """Planes of 64 * m fingerprints of shape (64 * m, lanes): uint64 of shape (64 * lanes, m)."""
    n, lanes = prints.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, lanes * 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(planes: np.ndarray, queries: np.ndarray, block: np.ndarray, radius: int, open_lanes: np.ndarray) -> np.ndarray:
    """For each pair of a query (row of ``queries``) and a block: the word of open lanes within the radius."""
    width = max(1, int(radius + 1).bit_length())
    out = np.zeros(len(block), np.uint64)
    for start in range(0, len(block), AT_ONCE):
        alive = np.arange(start, min(start + AT_ONCE, len(block)))
        over = ~open_lanes[alive]
        # counting starts so that the counter's carry out marks the first difference beyond the radius
        first = (1 << width) - 1 - radius
        c = [np.full(len(alive), ALL if first >> j & 1 else 0, np.uint64) for j in range(width)]
        for k in range(planes.shape[0]):
            q = queries[alive, k // 64] >> np.uint64(k % 64) & np.uint64(1)
            carry = planes[k, block[alive]] ^ (np.uint64(0) - q)
            for j in range(width):
                c[j], carry = c[j] ^ carry, c[j] & carry
            over |= carry
            if k % CHECK_EVERY == CHECK_EVERY - 1:
                left = over != ALL
                if not left.all():
                    alive, over, c = alive[left], over[left], [x[left] for x in c]
                    if not len(alive):
                        break
        out[alive] = ~over
    return out


def _pad(prints: np.ndarray) -> np.ndarray:
    short = -len(prints) % 64
    return np.concatenate([prints, np.zeros((short, prints.shape[1]), np.uint64)]) if short else prints


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within the radius would, at most one fewer than there are fingerprints.

    A search from each unvisited fingerprint compares the ones found last with those not found yet, so that a dense
    group of copies costs little more than one comparison for each member.
    """
    n = len(prints)
    planes = slice_planes(_pad(prints))
    blocks = planes.shape[1]
    todo = np.full(blocks, ALL, np.uint64)
    if n % 64:
        todo[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    left, right = [], []
    for seed in range(n):
        if not todo[seed // 64] >> np.uint64(seed % 64) & np.uint64(1):
            continue
        todo[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        front = [seed]
        while front:
            at, front = front.pop(), front
            live = np.flatnonzero(todo)
            if not len(live):
                return np.array(left, np.int64), np.array(right, np.int64)
            hit = near(planes, np.broadcast_to(prints[at], (len(live), prints.shape[1])), live, radius, todo[live])
            for w in np.flatnonzero(hit):
                todo[live[w]] &= ~hit[w]
                lanes = np.flatnonzero(np.unpackbits(hit[w : w + 1].view(np.uint8), bitorder="little")) + 64 * live[w]
                left += [at] * len(lanes)
                right += lanes.tolist()
                front += lanes.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def small_groups(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within groups of at most 64 consecutive fingerprints each, every group being one block."""
    starts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(prints)) - starts[group]
    padded = np.zeros((len(sizes) * 64, prints.shape[1]), np.uint64)
    padded[group * 64 + lane] = prints
    planes = slice_planes(padded)
    # lanes after the query's own, up to the group's size
    full = np.where(sizes[group] >= 64, ALL, (np.uint64(1) << (sizes[group] & 63).astype(np.uint64)) - np.uint64(1))
    later = full & np.where(lane >= 63, np.uint64(0), ALL << ((lane + 1) & 63).astype(np.uint64))
    ask = np.flatnonzero(later)
    hit = near(planes, prints[ask], group[ask], radius, later[ask])
    found = np.flatnonzero(hit)
    bits = np.unpackbits(hit[found].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, to = np.nonzero(bits)
    at = ask[found[row]]
    return at, starts[group[at]] + to
