"""Similarity join of documents on the Jaccard coefficient of their word n-grams, by MinHash banding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, BROADCAST_ROWS, map_rows, only, worker_state, written
from .components import components
from .decontaminate import words

N = 5
THRESHOLD = 0.8
#: Probability with which a pair exactly at the threshold becomes a candidate, and the most hashes spent on it.
RECALL = 0.99999
MAX_HASHES = 240
#: Documents, and distinct n-grams, of a verification chunk; bounds a task's memory.
CHUNK_DOCS = 256
CHUNK_GRAMS = 400_000
_WORD_CACHE = 250_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that reach the recall within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within so many hashes")
    return best


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def trim(self) -> None:
        self.clear()


_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) | 1 for k in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(text: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    A text of fewer than n words has one gram, of all its words; one without words has
    the whole text as its gram.
    """
    run = words(text)
    if not run:
        return np.array([xxhash.xxh3_64_intdigest(text, seed=1)], np.uint64)
    hash_of = worker_state("word hashes", _WordHash)
    h = np.fromiter(map(hash_of.__getitem__, run), np.uint64, len(run))
    m = min(n, len(h))
    total = np.zeros(len(h) - m + 1, np.uint64)
    for k in range(m):
        x = h[k : len(h) - m + 1 + k] * _ODD[k % 64]
        total = _mix(total + x) if k >= 63 else total + (x ^ (x >> np.uint64(29)))
    return np.unique(_mix(total + np.uint64(m)))


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = (rng.integers(0, 1 << 32, k, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)

    def signature(self, g: np.ndarray) -> np.ndarray:
        h, least = (g >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(h), 512):
            x = h[at : at + 512, None] * self.a
            x += self.b
            x = x.min(0)
            least = x if least is None else np.minimum(least, x)
        return least

    def band_keys(self, g: np.ndarray) -> list[int]:
        s = self.signature(g)
        raw = s.tobytes()
        width = 4 * self.rows
        return [xxhash.xxh3_64_intdigest(raw[k * width : (k + 1) * width], seed=k) - (1 << 63) for k in range(self.bands)]


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs (not i, i) whose exact Jaccard coefficient reaches the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    many = np.diff(np.concatenate([first, [len(every)]]))
    shared = np.repeat(many > 1, many)
    column = np.repeat(np.cumsum(many > 1) - 1, many)[shared]
    owner = owner[shared]
    common = np.zeros((n, n), np.float32)
    step = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, (at, at + step))
        block = np.zeros((n, min(step, int(column[-1]) + 1 - at)), np.float32)
        block[owner[low:high], column[low:high] - at] = 1
        common += block @ block.T
    out = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """The least index of each one's component."""
    root = np.arange(len(link))
    for i in range(len(link)):
        if root[i] == i:
            stack = [i]
            while stack:
                k = stack.pop()
                for j in np.flatnonzero(link[k] & (root >= np.arange(len(link))) & (root > i)):
                    if root[j] != i:
                        root[j] = i
                        stack.append(int(j))
    return root


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """All links of Jaccard at least ``threshold`` on word n-grams, as one row per input row.

    Returns ``doc_id, class_id, n_links, n_class``: class_id is the least doc_id of the
    connected group, n_links the number of other rows whose text is at least that similar
    (copies counted, not expanded into pairs), n_class the group's rows.

    1. One pass hashes each text's set of n-grams and its MinHash bands; bands and rows
       come from the target recall at the threshold (see :func:`bands_and_rows`).
    2. Rows of equal sets fold into one set row (a partial aggregate, so hot copies never
       meet in a task); only these are banded.
    3. Band hashes are shuffled; a bucket of k sets gives k - 1 edges to its least member,
       never its pairs. Components of these edges hold every pair that shares a band.
    4. Each component is cut by hash into chunks of about 256 sets or 400,000 n-grams, and
       each pair of chunks is one group: full n-gram sets are compared by blocked matrix
       products, which count links and give spanning edges, again not pairs.
    5. Components of the spanning edges are the classes.

    A text of fewer than n words has one gram of all its words; a text without words (an
    empty one too) equals only texts that are the same; null text is a class of its own
    without links; class_id is null if no row of the class has an id; repeated rows are
    copies of each other; an empty table gives none.
    """
    source = written(only(df, doc_id=id_col, text=text_col).withColumn("place", F.monotonically_increasing_id()), "docs")
    rows = groups(source, n, threshold, recall)
    rows = written(source.select("place", "doc_id").join(rows, "place", "left").withColumn("root", F.coalesce("root", "place")), "rows")
    classes = written(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_class")), "classes")
    return rows.join(classes, "root").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_class")


def one_of_each(df: DataFrame, text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The first row of each group of :func:`near_duplicates`, with all columns of ``df`` as they are.

    Only the places of rows that go are joined to the rows: broadcast up to a counted
    bound, shuffled beyond it.
    """
    columns = [f"c{k}" for k in range(len(df.columns))]
    source = written(df.toDF(*columns).withColumn("place", F.monotonically_increasing_id()), "docs")
    rows = groups(source.select("place", F.col(columns[df.columns.index(text_col)]).alias("text")), n, threshold, recall)
    gone = written(rows.filter("place <> root").select("place"), "gone")  # a root is the least place of its class
    return source.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "place", "left_anti").select(*columns).toDF(*df.columns)


def groups(source: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``place, root, n_links`` of rows with a text: ``source`` has ``place`` (a written row number) and ``text``."""
    source = source.select("place", F.col("text").cast("binary").alias("text"))
    bands, rows_per = bands_and_rows(threshold, recall)
    minhash = MinHash(bands, rows_per)

    def sign(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"place": batch.column(0), "h1": [], "h2": [], "n": [], "bands": []}
        for text in batch.column(1).to_pylist():
            g = grams(text, n)
            digest = xxhash.xxh3_128_intdigest(g.tobytes())
            out["h1"].append((digest >> 64) - (1 << 63))
            out["h2"].append((digest & ((1 << 64) - 1)) - (1 << 63))
            out["n"].append(len(g))
            out["bands"].append(minhash.band_keys(g))
        return out

    signed = written(map_rows(source.filter("text is not null").select("place", "text"), sign, "place bigint, h1 bigint, h2 bigint, n int, bands array<bigint>"), "signed")
    sets = signed.groupBy("h1", "h2").agg(F.min("place").alias("rep"), F.count(F.lit(1)).alias("m"))
    sets = written(sets, "sets")
    banded = signed.join(sets.select(F.col("rep").alias("place")), "place", "left_semi").select("place", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("band", "least")
    edges = banded.join(full, "band").filter("place <> least").select(F.col("place").alias("a"), F.col("least").alias("b")).distinct()
    near = components(edges)

    members = near.select(F.col("node").alias("place"), F.col("root").alias("comp")).join(signed.select("place", "n", "h1", "h2"), "place").join(sets.select("h1", "h2", "m"), ["h1", "h2"]).select("place", "comp", "n", "m")
    members = written(members, "members")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-int(total) // CHUNK_GRAMS))
    dealt = members.join(sizes, "comp").withColumn("chunk", F.pmod(F.xxhash64("place"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    small = F.col("chunks") == 1
    dealt = dealt.select(
        "place",
        "comp",
        "m",
        "chunk",
        F.when(small, F.lit(-1)).otherwise(F.col("comp")).alias("g0"),
        F.when(small, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.least("chunk", "other")).cast("bigint").alias("g1"),
        F.when(small, F.lit(0)).otherwise(F.greatest("chunk", "other")).alias("g2"),
    )
    dealt = written(dealt, "dealt")
    # Few rows have a partner at all: their numbers go to the texts, up to a counted bound, so that only
    # candidates' texts are shuffled.
    texts = source.select("place", "text")
    if members.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(members.select("place")), "place", "left_semi")
    texts = texts.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt, "place")

    def verify(group: pa.Table) -> pa.Table:
        place, comp, m, chunk = (group.column(c).to_numpy() for c in ("place", "comp", "m", "chunk"))
        text = group.column("text")
        cross = len(chunk) > 0 and group.column("g0")[0].as_py() != -1 and group.column("g1")[0].as_py() != group.column("g2")[0].as_py()
        out_place, out_links, out_root = [], [], []
        order = np.argsort(comp, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            own = own[np.argsort(place[own])]
            link = linked([grams(text[int(k)].as_py(), n) for k in own], threshold)
            if cross:  # pairs within a chunk are counted by that chunk's own group
                link &= chunk[own][:, None] != chunk[own][None, :]
            out_place.append(place[own])
            out_links.append(link @ m[own])
            out_root.append(place[own][_roots(link)])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"place": cat(out_place), "links": cat(out_links), "root": cat(out_root)})

    checked = written(texts.groupBy("g0", "g1", "g2").applyInArrow(verify, "place bigint, links bigint, root bigint"), "links")
    links = checked.groupBy("place").agg(F.sum("links").alias("links"))
    roots = components(checked.filter("place <> root").select(F.col("place").alias("a"), F.col("root").alias("b")))
    per_set = sets.join(links.withColumnRenamed("place", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    per_set = written(per_set.select("h1", "h2", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "per-set")
    return written(signed.select("place", "h1", "h2").join(per_set, ["h1", "h2"]).select("place", "root", "n_links"), "grouped")
