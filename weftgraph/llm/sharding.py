"""Shards by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import functools
import operator
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

SHARDS = 8
#: Key ranges for which sums are held on the driver, as bits; an opened range is divided by as many again.
RANGE_BITS = 14
#: Groups that the driver reads at once; a range with more of them is divided before it is opened.
OPEN_GROUPS = 200_000


def greedy_cuts(capacity: int, shards: int, total: int, last_end: Callable[[int], int]) -> list[int] | None:
    """Ends of shards filled greedily up to ``capacity`` (sums of sizes so far), or None if not all fits.

    ``last_end(goal)`` is the largest sum at the end of a group that does not exceed the goal.
    """
    at, ends = 0, []
    for _ in range(shards):
        at = total if at + capacity >= total else last_end(at + capacity)
        ends.append(at)
    return ends if at == total else None


def smallest_capacity(low: int, high: int, feasible: Callable[[int], bool]) -> int:
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


class _Sums:
    """Sums of group sizes in the order of keys, opened where they are asked for.

    The driver has the sums of 2^14 ranges of keys. A range is opened into its groups, or,
    if these are too many, into the sums of 2^14 ranges again, and those into their groups.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        found = self._ranges(groups, RANGE_BITS)
        self.most = int(found["most"].max()) if len(found) else 0
        self.top = self._prefix(found, RANGE_BITS, -(1 << (RANGE_BITS - 1)), 0)
        self.count = dict(zip((found["r"] + (1 << (RANGE_BITS - 1))).tolist(), found["n"].tolist()))
        self.inner: dict[int, np.ndarray] = {}  # prefix sums of a range's ranges
        self.ends: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # last keys and sums at the end of groups
        self.total = int(self.top[-1])

    @staticmethod
    def _ranges(groups: DataFrame, bits: int):
        return groups.groupBy(F.shiftright("key", 64 - bits).alias("r")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.count(F.lit(1)).alias("n")).toPandas()

    @staticmethod
    def _prefix(found, bits: int, first: int, before: int) -> np.ndarray:
        """Sums before each of 2^14 ranges, and after the last; ``first`` is the first one's number."""
        sums = np.zeros(1 << RANGE_BITS, np.int64)
        sums[found["r"].to_numpy(np.int64) - first] = found["bytes"].to_numpy(np.int64)
        return before + np.concatenate([[0], np.cumsum(sums)])

    def place(self, goal: int) -> tuple[int, int]:
        """The range, and the range within it (-1: undivided), in which the sum ``goal`` falls."""
        r = min(bisect_right(self.top, goal) - 1, len(self.top) - 2)
        inner = self.inner.get(r)
        return r, -1 if inner is None else min(bisect_right(inner, goal) - 1, len(inner) - 2)

    def _low(self, r: int, k: int) -> int:
        """The least key of a range."""
        low = (r << (64 - RANGE_BITS)) - (1 << 63)
        return low + (max(k, 0) << (64 - 2 * RANGE_BITS))

    def _within(self, ranges: list[tuple[int, int]]) -> DataFrame:
        width = lambda k: 1 << (64 - (1 if k < 0 else 2) * RANGE_BITS)
        tests = [F.col("key").between(self._low(r, k), self._low(r, k) + width(k) - 1) for r, k in ranges]
        return self.groups.filter(functools.reduce(operator.or_, tests))

    def divide(self, wanted: set[int]) -> None:
        """Divides those of the ranges that hold too many groups to be read together."""
        wanted = sorted(w for w in wanted if w not in self.inner and (w, -1) not in self.ends)
        if sum(self.count.get(r, 0) for r in wanted) <= OPEN_GROUPS:
            return
        found = self._ranges(self._within([(r, -1) for r in wanted]), 2 * RANGE_BITS)
        for r in wanted:
            first = (r << RANGE_BITS) - (1 << (2 * RANGE_BITS - 1))
            own = found[(found["r"] >= first) & (found["r"] < first + (1 << RANGE_BITS))]
            self.inner[r] = self._prefix(own, 2 * RANGE_BITS, first, int(self.top[r]))

    def open(self, wanted: set[tuple[int, int]]) -> None:
        """Reads the groups of ranges."""
        wanted = sorted(wanted - self.ends.keys())
        if not wanted:
            return
        found = self._within(wanted).select("key", "bytes").toPandas().sort_values("key")
        keys, sizes = found["key"].to_numpy(np.int64), found["bytes"].to_numpy(np.int64)
        for r, k in wanted:
            low, bits = self._low(r, k), 64 - (1 if k < 0 else 2) * RANGE_BITS
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, low + (1 << bits) - 1, side="right")
            before = int(self.top[r] if k < 0 else self.inner[r][k])
            self.ends[r, k] = keys[a:b], before + np.cumsum(sizes[a:b])

    def between_ranges(self, goal: int) -> int:
        """The largest sum at the end of a known range that does not exceed the goal: no finer cuts."""
        r, k = self.place(goal)
        return int(self.top[r] if k < 0 else self.inner[r][k])

    def last_end(self, goal: int) -> int:
        return self.last(goal)[0]

    def last(self, goal: int) -> tuple[int, int]:
        """The largest sum at the end of a group that does not exceed the goal, and that group's key (or the last key before the range)."""
        r, _ = self.place(goal)
        self.divide({r})
        place = self.place(goal)
        self.open({place})
        keys, sums = self.ends[place]
        k = bisect_right(sums, goal)
        return (int(sums[k - 1]), int(keys[k - 1])) if k else (self.between_ranges(goal), self._low(*place) - 1)


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row in one of ``shards`` shards of nearly equal bytes; rows of equal texts stay together.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (law ``bytes``, so
    grown_shard is null). Size is the text's UTF-8 bytes plus 1.

    Groups are equal texts, ordered by the leading 60 bits of the text's MD5. The smallest capacity for
    which a greedy walk along the groups needs no more than ``shards`` shards is found by
    binary search, and the groups are cut there. The driver holds sums for 2^14 ranges of
    the hash and opens single ranges where a greedy walk ends a shard, by way of the sums
    of 2^14 parts of a range if it has many groups; it reads at most ``OPEN_GROUPS`` groups
    at once, or those of a 2^28th of the hash. As shards are ranges of the hash, a row
    finds its shard by comparing with the cuts, without a join. Slots are numbered within
    each scanned partition and shard, and shifted by sums over partitions, so neither a
    hot text nor a whole shard meets in one task.

    Null text has size 1, crc32 0, and is one group with empty texts; a null id stays
    null; repeated rows keep their own slots; a text that is larger than the fair share
    has its shard to itself, and some shards may be empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(df, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        ((F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") - (1 << 59)) * 16).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")).sortWithinPartitions("key"), "shard-groups")
    sums = _Sums(groups)
    cuts = _cuts(sums, shards) if sums.total else []
    which = F.lit(0)
    for key in cuts:
        which = which + (F.col("key") > key).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "place", which.alias("shard"), F.shiftright("place", 33).cast("int").alias("part"))
    before = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("shift"))
    local = F.row_number().over(Window.partitionBy("part", "shard").orderBy("place"))
    return (
        rows.withColumn("local", local)
        .join(before, ["part", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("shift") + F.col("local") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def _cuts(sums: _Sums, shards: int) -> list[int]:
    """The last key of each shard but the final one."""
    total = sums.total
    low = max(-(-total // shards), sums.most)
    high = total
    for finer in (False, True):  # cuts between ranges, then between the ranges of those that cuts fall in: also feasible for groups
        high = smallest_capacity(low, high, lambda c: greedy_cuts(c, shards, total, sums.between_ranges) is not None)
        near = [min(end + c, total) for c in (low, high) for end in [0, *(greedy_cuts(c, shards, total, sums.between_ranges) or [k * c for k in range(1, shards)])]]
        if not finer:
            sums.divide({r for goal in near for r in (sums.place(goal)[0],)})
    sums.open({sums.place(goal) for goal in near if sums.place(goal)[1] >= 0 or sums.count.get(sums.place(goal)[0], 0) <= OPEN_GROUPS})
    best = smallest_capacity(low, high, lambda c: greedy_cuts(c, shards, total, sums.last_end) is not None)
    ends = greedy_cuts(best, shards, total, sums.last_end)
    return [(1 << 63) - 1 if end == total else sums.last(end)[1] for end in ends[:-1]]
