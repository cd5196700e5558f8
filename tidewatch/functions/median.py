"""Exact median over a changing set of values, a helper for per-row work inside tasks."""

from __future__ import annotations

import heapq
import sys

from pyspark import cloudpickle


class RollingMedian:
    """Two heaps with lazy removal: add, expire and median in O(log n) amortised.

    Samples carry a time; ``expire`` removes for good those before a cutoff. NaN sorts last.
    """

    def __init__(self):
        self.low = []  # max-heap by negated key: the smaller half
        self.high = []  # min-heap: the larger half
        self.times = []  # min-heap of (time, sample id)
        self.side = {}  # live sample id -> True when it sits in the smaller half
        self.low_size = 0
        self.next_id = 0

    def __len__(self) -> int:
        return len(self.side)

    def add(self, time: int, value: float) -> None:
        key = float("inf") if value != value else value
        # a dead top still separates the halves, so no clean-up is needed here
        to_low = bool(self.low) and key <= -self.low[0][0]
        sample = self.next_id
        self.next_id += 1
        self.side[sample] = to_low
        if to_low:
            heapq.heappush(self.low, (-key, sample, value))
            self.low_size += 1
        else:
            heapq.heappush(self.high, (key, sample, value))
        heapq.heappush(self.times, (time, sample))

    def expire(self, cutoff: int) -> None:
        while self.times and self.times[0][0] < cutoff:
            _, sample = heapq.heappop(self.times)
            self.low_size -= self.side.pop(sample)
        if len(self.low) + len(self.high) > 2 * len(self.side) + 1024:
            self._drop_dead()

    def median(self) -> float:
        """Middle value, or the mean of the middle two. The set must not be empty."""
        self._settle()
        if len(self.side) % 2:
            return self.low[0][2]
        return (self.low[0][2] + self.high[0][2]) / 2.0

    def _drop_dead(self) -> None:
        """Dead samples far from the median never reach a top; rebuild once they outnumber the live."""
        for heap in (self.low, self.high):
            heap[:] = [entry for entry in heap if entry[1] in self.side]
            heapq.heapify(heap)

    def _settle(self) -> None:
        """Drop dead tops and restore: smaller half holds the extra sample when the count is odd."""
        low, high, side = self.low, self.high, self.side
        push, pop = heapq.heappush, heapq.heappop
        surplus = self.low_size - (len(side) + 1) // 2
        while surplus > 0:
            key, sample, value = pop(low)
            if sample in side:
                push(high, (-key, sample, value))
                side[sample] = False
                surplus -= 1
        while surplus < 0:
            key, sample, value = pop(high)
            if sample in side:
                push(low, (-key, sample, value))
                side[sample] = True
                surplus += 1
        while low and low[0][1] not in side:
            pop(low)
        while high and high[0][1] not in side:
            pop(high)
        self.low_size = (len(side) + 1) // 2


# ship this module inside serialized functions, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
