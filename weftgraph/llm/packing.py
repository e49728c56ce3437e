"""Best-fit packing of token sequences: patterns fitted by non-negative least squares, then residuals."""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_rows, only, slices, written
from .pretokens import pieces_of

LENGTH = 4096
END_ID = 1
#: Length classes that the patterns are made of, and the most documents in a pattern.
CLASSES = 64
DEPTH = 3
#: Shares of the fitted repeat counts that are tried; the plan with the fewest sequences stands.
SHARES = (1.0, 0.95, 0.9, 0.75, 0.5, 0.25)
#: Texts whose pre-tokens are held at once, in characters.
SLICE_CHARS = 2_000_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: active sets after Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= small:
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            down = free & (z <= 0)
            step = (x[down] / (x[down] - z[down])).min()
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of two to ``depth`` classes that fill a sequence: class numbers add up to ``classes``, largest first."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if len(head) >= 2 and left == 0:
            found.append(head)
        if left and len(head) < depth:
            for c in range(min(left, head[-1] if head else classes - 1), 0, -1):
                extend((*head, c), left - c)

    extend((), classes)
    return found


def fitted(left: np.ndarray, length: int, classes: int, depth: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns of length classes, and repeat counts of each that fit a histogram (by length) best."""
    width = length // classes
    histogram = np.zeros(classes + 1)
    for s in np.flatnonzero(left):
        histogram[min(-(-int(s) // width), classes)] += left[s]
    shapes = patterns(classes, depth)
    a = np.zeros((classes, len(shapes)))
    for j, shape in enumerate(shapes):
        for c in shape:
            a[c - 1, j] += 1
    weight = np.arange(1, classes + 1)[:, None] / classes  # a token is as dear in a short piece as in a long one
    b = histogram[1:].copy()
    b[classes - 1] = 0  # pieces of the top class stand alone or take a short residual
    return shapes, nnls(a * weight, b * weight[:, 0])


class Plan:
    """Which pieces go where, as runs: equally long pieces of consecutive ranks, one to a sequence.

    Work is on the histogram of lengths alone, so its cost depends on the number of
    distinct lengths and not on that of documents. ``fit`` has the patterns and their
    fitted repeat counts, of which ``share`` are used; by default they are fitted here.
    """

    def __init__(self, histogram: dict[int, int], length: int = LENGTH, classes: int = CLASSES, depth: int = DEPTH, share: float = 1.0, fit: tuple[list[tuple[int, ...]], np.ndarray] | None = None):
        self.length = length
        self.left = np.zeros(length + 1, np.int64)
        for size, n in histogram.items():
            self.left[size] = n
        self.rank = np.zeros(length + 1, np.int64)
        self.have = sum(1 << int(s) for s in np.flatnonzero(self.left))
        self.open: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, count)
        self.room = 0  # bits: free sizes that have an open sequence
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        if length // classes and self.have:
            shapes, times = fit or fitted(self.left, length, classes, depth)
            self._pattern_pass(shapes, np.floor(share * times + 1e-9).astype(np.int64), length // classes)
        self._residual_pass()

    def _place(self, size: int, first: int, n: int, free: int) -> None:
        """``n`` pieces of ``size`` tokens into sequences first.. that have ``free`` tokens left."""
        self.runs.append((size, int(self.rank[size]), n, first, self.length - free))
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            self.have &= ~(1 << size)

    def _keep(self, free: int, first: int, n: int) -> None:
        if free:
            self.open.setdefault(free, []).append((first, n))
            self.room |= 1 << free

    def _longest(self, most: int) -> int:
        """The longest piece left of at most ``most`` tokens, or 0."""
        return (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.have & ((1 << (most + 1)) - 2) else 0

    def _pattern_pass(self, shapes: list[tuple[int, ...]], times: np.ndarray, width: int) -> None:
        for j in sorted(np.flatnonzero(times), key=lambda j: shapes[j], reverse=True):
            self._repeat(shapes[j], int(times[j]), width)

    def _repeat(self, shape: tuple[int, ...], times: int, width: int) -> None:
        """Up to ``times`` sequences of one pattern: its classes from the longest pieces, the last by best fit."""
        first, self.sequences = self.sequences, self.sequences + times
        runs = [(first, times, self.length)]
        for k, c in enumerate(shape):
            last, after = k == len(shape) - 1, []
            for at, n, free in runs:
                while n:
                    # The last piece may come from the next class as well, when the first ones leave room for it.
                    size = self._longest(min(free, (c + 1) * width if last else c * width))
                    if size <= (c - 1) * width:
                        break
                    take = min(n, int(self.left[size]))
                    self._place(size, at, take, free)
                    after.append((at, take, free - size))
                    at, n = at + take, n - take
                if n:
                    after.append((at, n, free))
            runs = after
        for at, n, free in runs:
            self._keep(free, at, n)

    def _residual_pass(self) -> None:
        """Best-fit decreasing: each piece left, longest first, into the open sequence with the least room that takes it."""
        while size := self._longest(self.length):
            n = int(self.left[size])
            while n:
                fits = self.room >> size
                if not fits:
                    self._place(size, self.sequences, n, self.length)
                    self._keep(self.length - size, self.sequences, n)
                    self.sequences += n
                    n = 0
                    continue
                free = size + (fits & -fits).bit_length() - 1
                first, count = self.open[free].pop()
                if not self.open[free]:
                    self.room &= ~(1 << free)
                take = min(n, count)
                self._place(size, first, take, free)
                self._keep(free - size, first, take)
                if count > take:
                    self._keep(free, first + take, count - take)
                n -= take


def best_plan(histogram: dict[int, int], length: int = LENGTH) -> Plan:
    """The plan with the fewest sequences over shares of the fitted counts and two widths of classes; each width is fitted once."""
    left = np.zeros(length + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    tried = []
    for classes in (CLASSES, 2 * CLASSES):
        fit = fitted(left, length, classes, DEPTH) if length // classes and left.any() else None
        tried += [Plan(histogram, length, classes, DEPTH, share, fit) for share in SHARES]
    return min(tried, key=lambda p: p.sequences)


def _ids(encoding) -> bytes:
    return array("I", encoding.ids).tobytes()


def encode(texts: list[str], path: str, end_id: int = END_ID) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers (byte-swapped on big-endian machines)."""
    tok, end = pieces_of(path, "ids"), array("I", [end_id]).tobytes()
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        held, runs = 0, []
        start = at
        while at < len(texts) and (at == start or held + len(texts[at]) <= SLICE_CHARS):
            text = texts[at]
            held += len(text)
            at += 1
            if tok.fast(text):
                parts, special = tok.segments(text)
                runs.append(([tok.split(p) for p in parts], special))
            else:
                runs.append((None, tok.whole(text)))
        ids = tok.learn(set().union(*(r for parts, _ in runs if parts for r in parts)), _ids)
        for parts, rest in runs:
            if parts is None:
                out.append(array("I", rest).tobytes() + end)
                continue
            found = list(map(ids.__getitem__, parts[0]))
            for name, part in zip(rest, parts[1:]):
                found.append(array("I", [tok.special[name]]).tobytes())
                found += map(ids.__getitem__, part)
            found.append(end)
            out.append(b"".join(found))
    if sys.byteorder == "big":
        out = [np.frombuffer(x, ">u4").astype("<u4").tobytes() for x in out]
    return out


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut_pieces(df: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, with the partition that made them and their rank there among equally long ones."""
    fields = [f.split() for f in PIECES.split(", ")]

    def run(batches):
        part, ranks = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in slices(batches):
            out = {name: [] for name, _ in fields}
            for doc, raw in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()], tokenizer_path, end_id)):
                total = len(raw) // 4
                for piece, start in enumerate(range(0, total, length)):
                    size = min(length, total - start)
                    for name, value in zip(out, (doc, piece, start, size, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + size)]), part, int(ranks[size]))):
                        out[name].append(value)
                    ranks[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int32() if kind == "int" else pa.int64()) for n, kind in fields], names=[n for n, _ in fields])

    return df.mapInArrow(run, PIECES)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """All documents in sequences of at most ``length`` tokens, as few as can be.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    A document is its ids and ``end_id``; only a longer one than ``length`` is cut.

    Each text is tokenized once and its pieces are written to the shared folder. The
    histogram of lengths (at most ``length`` rows) goes to the driver, where repeat counts
    of patterns of two or three length classes are fitted to it by non-negative least
    squares, rounded down, and filled; what is left is packed best-fit decreasing. The
    plan is a list of runs (equally long pieces of consecutive ranks), whose number
    follows the distinct lengths. A piece's rank is its rank in its partition plus what
    earlier partitions have of its length, so a length that a third of all pieces share
    meets in no one task; the piece finds its run by binary search. What earlier partitions
    have is a row per partition and length, which is broadcast only if counted and few.

    Null and empty texts are one piece of one token; a null id stays null; repeated rows
    are packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = written(cut_pieces(only(df, doc_id=id_col, text=text_col), tokenizer_path, length, end_id), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    plan = best_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    held = df.sparkSession.sparkContext.broadcast(runs)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("shift"))
    before = F.broadcast(before) if counts.count() <= BROADCAST_ROWS else before.hint("merge")
    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))

    def fold(batch: pa.RecordBatch) -> dict[str, list]:
        found = held.value
        size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        key = found[:, 0] * (1 << 46) + found[:, 1]
        at = np.searchsorted(key, size * (1 << 46) + rank, side="right") - 1
        own = found[at]
        return {
            **{n: batch.column(k) for k, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))},
            "sequence_id": own[:, 3] + rank - own[:, 1],
            "offset": own[:, 4],
        }

    return map_rows(ranked, fold, PACKED)
