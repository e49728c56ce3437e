"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filter_rows, map_rows, only, worker_state, written

WINDOW = 10
#: Words of a block, of the shift and suffix-hash tables.
BLOCK = 2
#: Bytes of benchmark text whose tables are held at once; a larger benchmark is searched in several such blocks.
PATTERN_BYTES = 16 << 20

# Bytes that are words (digits, letters, anything beyond ASCII); A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_STATE = "doc_id bigint, text binary, starts array<int>, ends array<int>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: maximal runs of ASCII digits, letters (lower-cased) and non-ASCII characters."""
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Search for patterns of exactly ``m`` words each.

    ``shift`` has, for each block of words in a pattern, the least distance from the block to
    the pattern's end; any other block lets the search skip the most. Blocks that end a
    pattern (shift 0) lead to the bucket of the patterns with that suffix, which are
    compared directly.
    """

    def __init__(self, m: int):
        self.m, self.b = m, min(BLOCK, m)
        self.skip = m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, pattern: tuple, item: str) -> None:
        for end in range(self.b, self.m + 1):
            block, far = pattern[end - self.b : end], self.m - end
            if far < self.shift.get(block, self.skip):
                self.shift[block] = far
        self.bucket.setdefault(pattern[-self.b :], {}).setdefault(pattern, set()).add(item)

    def find(self, run: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """First word's place and items of each occurrence, from left to right."""
        shift, skip, m, b = self.shift.get, self.skip, self.m, self.b
        at, n = m - 1, len(run)
        if b == 2:
            while at < n:
                far = shift((run[at - 1], run[at]), skip)
                if far:
                    at += far
                    continue
                items = self.bucket[run[at - 1], run[at]].get(tuple(run[at - m + 1 : at + 1]))
                if items:
                    yield at - m + 1, items
                at += 1
        else:
            while at < n:
                block = tuple(run[at - b + 1 : at + 1])
                far = shift(block, skip)
                if far:
                    at += far
                    continue
                items = self.bucket[block].get(tuple(run[at - m + 1 : at + 1]))
                if items:
                    yield at - m + 1, items
                at += 1


def tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One search for each length of window that the items have: ``window``, and those of shorter items."""
    by: dict[int, WuManber] = {}
    for item, text in items:
        run = words(text)
        m = min(window, len(run))
        for at in range(len(run) - m + 1 if run else 0):
            by.setdefault(m, WuManber(m)).add(tuple(run[at : at + m]), item)
    return list(by.values())


def search(run: list[bytes], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words, and the items that occur."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for s in searches:
        for at, found in s.find(run):
            items |= found
            if spans and at <= spans[-1][1] and at >= spans[-1][0]:
                spans[-1] = spans[-1][0], max(spans[-1][1], at + s.m)
            else:
                spans.append((at, at + s.m))
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _searches(key: str, items, window: int) -> list[WuManber]:
    return worker_state(("searches", key), lambda: tables(items.value, window))


def blocks_of(benchmark: DataFrame, limit: int = PATTERN_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's texts in blocks of at most ``limit`` bytes (or one longer text), read one partition at a time."""
    held, size = [], 0
    for item, text in benchmark.toLocalIterator():
        if item is None or text is None:
            continue
        raw = text.encode()
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((str(item), raw))
        size += len(raw)
    if held:
        yield held


def hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Spans of contaminated words: ``doc_id, text, starts, ends, items`` for every row, contaminated or not.

    One narrow pass over the documents for each block of the benchmark; only a block of
    bounded size is ever broadcast. What one block found travels with the row to the next.
    """
    rows = only(df, doc_id=id_col, text=text_col)
    rows = rows.selectExpr("doc_id", "cast(text as binary) as text", "cast(array() as array<int>) as starts", "cast(array() as array<int>) as ends", "cast(array() as array<string>) as items")
    context = df.sparkSession.sparkContext
    for k, block in enumerate(blocks_of(only(benchmark, item=item_col, text=item_text_col))):
        items, key = context.broadcast(block), uuid.uuid4().hex
        if k and k % 8 == 0:
            rows = written(rows, "hits")

        def fold(batch: pa.RecordBatch, items=items, key=key) -> dict[str, list]:
            searches = _searches(key, items, window)
            starts, ends, names = [], [], []
            for text, *held in zip(*(batch.column(c).to_pylist() for c in range(1, 5))):
                spans, found = search(words(text), searches)
                if held[0]:
                    spans = merged([*zip(held[0], held[1]), *spans])
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                names.append(sorted(found.union(held[2])))
            return {"doc_id": batch.column(0), "text": batch.column(1), "starts": starts, "ends": ends, "items": names}

        rows = map_rows(rows, fold, _STATE)
    return rows


def contamination(df: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a
    word of the document inside any occurrence of a window is hit. Items with equal
    windows all count. Null text has no words; items with a null id or text, or without
    words, take no part; an empty benchmark hits nothing; repeated rows give repeated
    results; other columns are ignored. Long texts are searched whole.
    """

    def fold(batch: pa.RecordBatch) -> dict[str, list]:
        text, starts, ends, items = (batch.column(c).to_pylist() for c in range(1, 5))
        n_hit = [sum(e) - sum(s) for s, e in zip(starts, ends)]
        return {
            "doc_id": batch.column(0),
            "n_words": [len(words(t)) for t in text],
            "n_hit": n_hit,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
            "contaminated": [n > 0 for n in n_hit],
        }

    return map_rows(hits(df, benchmark, **names), fold, SCHEMA)


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df``, with all their columns, that no window of the benchmark occurs in; a narrow pass for each block of it.

    Null and empty texts, and texts without words, stay; null items and items without words
    have no windows, so an empty benchmark keeps all rows; null ids and repeated rows are
    rows like others; an empty table gives none.
    """
    context = df.sparkSession.sparkContext
    for k, block in enumerate(blocks_of(only(benchmark, item=item_col, text=item_text_col))):
        items, key = context.broadcast(block), uuid.uuid4().hex
        if k and k % 8 == 0:
            df = written(df, "clean")

        def keep(texts: list, items=items, key=key) -> list[bool]:
            searches = _searches(key, items, window)
            return [not t or not any(next(s.find(run), None) for run in (words(t.encode()),) for s in searches) for t in texts]

        df = filter_rows(df, text_col, keep)
    return df
