"""Largest differencing for many bins (Karmarkar and Karp), shared by the splitting and the packing operator.

Every item starts as a partial partition with one filled bin. The two partial partitions with the largest spread are
merged again and again, the fullest bins of one with the emptiest bins of the other, until one is left.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Sequence


def difference(sizes: Sequence[int], bins: int) -> tuple[list[int], list[int]]:
    """(bin of each item, total of each bin). Ties are broken by position, so the result is the same on every run.
    Items of size 0 are allowed; no items give empty bins."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    n = len(sizes)
    if bins == 1 or n == 0:
        return [0] * n, [sum(sizes)] * (bins == 1) or [0] * bins
    left, right = [], []  # of the nodes n, n + 1, ...: two bins made one
    heap = [(-size, at, [(size, at)]) for at, size in enumerate(sizes)]  # partial partitions: filled bins, smallest first
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - bins
        if shared <= 0:
            if len(b) == 1:
                insort(a, b[0])
            else:
                a = sorted(a + b)
        else:
            both = []
            for (x, i), (y, j) in zip(a[:shared], reversed(b[:shared])):
                both.append((x + y, n + len(left)))
                left.append(i)
                right.append(j)
            a = sorted(both + a[shared:] + b[shared:])
        spread = a[-1][0] - (a[0][0] if len(a) == bins else 0)
        heapq.heappush(heap, (-spread, stamp, a))
        stamp += 1
    final = heap[0][2]
    place = [0] * (n + len(left))
    totals = [0] * bins
    for slot, (total, node) in enumerate(reversed(final)):
        place[node] = slot
        totals[slot] = total
    for k in range(len(left) - 1, -1, -1):
        place[left[k]] = place[right[k]] = place[n + k]
    return place[:n], totals


def windows(sizes: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Differencing into as few windows as it manages: the window count starts at the least possible and rises whenever
    the fullest window exceeds the capacity. No size may exceed the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        place, totals = difference(sizes, count)
        worst = max(totals, default=0)
        if worst <= capacity:
            return place, totals
        count += 1
