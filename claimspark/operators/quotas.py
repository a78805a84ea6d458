"""Several quotas taken in turn from one candidate table, each by the smallest draws.

Which rows a rule takes depends on what the earlier rules left, so rule after rule would
cost counting jobs of its own. Here rows are counted once per (flags, leading bits of the draw).
The takes are played through on these counts. Only the ranges of draws in which a take ends need
to be seen more closely, and all of them are counted finer, or fetched as rows, in the same job.
A counting job returns at most 2^8 ranges per set of flags, and a fetch at most `FETCH` rows per range,
whatever the number of rows; a table 256 times as large costs one more job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.draws import DRAW_BITS
from claimspark.operators.sampling import Cut

_LEVEL_BITS = 8
#: A range with at most this many rows is fetched instead of counted again.
FETCH = 2_000


@dataclass(frozen=True)
class Take:
    """The `n` rows (None: all) of smallest draw among those with flag `bit`.

    Counted among the rows no earlier take has, or, with `of_all`, among all rows with the flag: then rows
    that an earlier take has use up the quota but stay where they are.
    """

    bit: int
    n: int | None
    of_all: bool = False


@dataclass
class _Ranges:
    """Counts per (range of draws, flags), ordered by draw. Level -1 marks a single row."""

    start: np.ndarray
    level: np.ndarray
    key: np.ndarray
    mask: np.ndarray
    count: np.ndarray

    def ordered(self) -> _Ranges:
        order = sorted(range(len(self.start)), key=lambda i: (self.start[i], self.key[i]))
        return _Ranges(self.start[order], self.level[order], self.key[order], self.mask[order], self.count[order])

    def without(self, ranges: set[tuple[int, int]]) -> _Ranges:
        stay = np.array([(s, v) not in ranges for s, v in zip(self.start, self.level)], bool)
        return _Ranges(self.start[stay], self.level[stay], self.key[stay], self.mask[stay], self.count[stay])

    def plus(self, rows: list[tuple[int, int, str, int, int]]) -> _Ranges:
        start, level, key, mask, count = zip(*rows) if rows else ((), (), (), (), ())
        return _Ranges(
            np.concatenate([self.start, np.array(start, np.int64)]),
            np.concatenate([self.level, np.array(level, np.int64)]),
            np.concatenate([self.key, np.array(key, object)]),
            np.concatenate([self.mask, np.array(mask, np.int64)]),
            np.concatenate([self.count, np.array(count, np.float64)]),
        )


def _shift(level: int) -> int:
    return max(DRAW_BITS - _LEVEL_BITS * (level + 1), 0)


class Quotas:
    """Finds the cuts of takes over `rows` (columns of draw, unique key and an integer of flags)."""

    def __init__(self, rows: DataFrame, draw: str = "_draw", key: str = "claim_id", mask: str = "_mask") -> None:
        self.rows = rows.select(F.col(draw).alias("d"), F.col(key).cast("string").alias("k"), F.col(mask).alias("m"))
        self.jobs = 0
        nothing = np.zeros(0)
        empty = _Ranges(nothing.astype(np.int64), nothing.astype(np.int64), nothing.astype(object), nothing.astype(np.int64), nothing)
        self._seen = empty.plus(self._counted(F.lit(True), 0)).ordered()

    def _counted(self, where: Column, level: int) -> list[tuple[int, int, str, int, int]]:
        self.jobs += 1
        shift = _shift(level)
        counts = self.rows.where(where).groupBy(F.shiftright("d", shift).alias("b"), "m").count().collect()
        return [(r["b"] << shift, level, "", r["m"], r["count"]) for r in counts]

    def _fetched(self, where: Column) -> list[tuple[int, int, str, int, int]]:
        self.jobs += 1
        return [(r["d"], -1, r["k"], r["m"], 1) for r in self.rows.where(where).collect()]

    def _look_closer(self, ranges: set[tuple[int, int]]) -> None:
        """Replace the counts of some ranges by finer ones."""
        sizes = {r: 0.0 for r in ranges}
        for start, level, count in zip(self._seen.start, self._seen.level, self._seen.count):
            if (start, level) in sizes:
                sizes[start, level] += count

        def inside(chosen: list[tuple[int, int]]) -> Column:
            hit = F.lit(False)
            for level in {v for _, v in chosen}:
                numbers = [int(s) >> _shift(level) for s, v in chosen if v == level]
                hit = hit | F.shiftright("d", _shift(level)).isin(numbers)
            return hit

        few = [r for r in ranges if sizes[r] <= FETCH or _shift(r[1]) == 0]
        rows = self._fetched(inside(few)) if few else []
        for level in {v for _, v in ranges.difference(few)}:
            rows += self._counted(inside([r for r in ranges.difference(few) if r[1] == level]), level + 1)
        self._seen = self._seen.without(ranges).plus(rows).ordered()

    def _play(self, takes: Sequence[Take]) -> tuple[list[Cut], list[int], set[tuple[int, int]]]:
        """Cuts, new rows per take, and the ranges in which a take ends without its row being known."""
        seen = self._seen
        left = seen.count.copy()
        single = seen.level < 0
        fresh = np.ones(len(left), bool)  # a row, or the first cell of its range
        fresh[1:] = single[1:] | single[:-1] | (seen.start[1:] != seen.start[:-1])
        group = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        cuts, sizes, open_ranges = [], [], set()
        for take in takes:
            flagged = (seen.mask >> take.bit) & 1 == 1
            weight = np.where(flagged, seen.count if take.of_all else left, 0.0)
            upto = np.cumsum(np.bincount(group, weight, len(first))) if len(first) else np.zeros(0)
            if take.n is None or not len(upto) or upto[-1] <= take.n:
                share, cut = flagged.astype(float), Cut(all=True)
            elif take.n <= 0:
                share, cut = np.zeros(len(left)), Cut()
            else:
                edge = int(np.searchsorted(upto, take.n))
                at = first[edge]
                before = upto[edge - 1] if edge else 0.0
                part = 1.0 if single[at] else (take.n - before) / (upto[edge] - before)
                share = np.where(group < edge, 1.0, np.where(group == edge, part, 0.0)) * flagged
                cut = Cut(draw=int(seen.start[at]), key=seen.key[at])
                if not single[at]:
                    open_ranges.add((int(seen.start[at]), int(seen.level[at])))
            sizes.append(int(round(float((left * share).sum()))))
            left = left * (1.0 - share)
            cuts.append(cut)
        return cuts, sizes, open_ranges

    def cuts(self, takes: Sequence[Take]) -> tuple[list[Cut], list[int]]:
        """One cut per take, and how many rows each take adds."""
        while True:
            cuts, sizes, open_ranges = self._play(takes)
            if not open_ranges:
                return cuts, sizes
            self._look_closer(open_ranges)
