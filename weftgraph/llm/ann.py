"""Approximate nearest neighbours: stable random projections in kd-trees, with a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, only, written

#: Projected dimensions; probability of the stopping test; vectors in a kd-tree and in a leaf.
DIMS = 12
STOP = 0.97
TREE_ROWS = 16_384
LEAF_ROWS = 256
#: Queries in a block, and bytes of their vectors; vectors of a partition of the index. They bound what the driver and a task hold.
BLOCK_QUERIES = 32_768
BLOCK_BYTES = 32 << 20
PART_ROWS = 1_000_000
#: Vectors of the sample that the space is divided by (its bound does not depend on the table).
SAMPLE = 8_192


def chi_square_quantile(p: float, k: int) -> float:
    """The value below which a chi-square variable of ``k`` degrees of freedom falls with probability ``p``."""

    def cdf(x: float) -> float:  # the regularised lower incomplete gamma function, by its series
        a, y = k / 2, x / 2
        if y <= 0:
            return 0.0
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a))

    low, high = 0.0, 20.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def project(x: np.ndarray, most: float, dims: int) -> np.ndarray:
    """Gaussian (2-stable) projections of vectors lengthened to norm sqrt(``most``).

    The added coordinate makes the nearest by Euclidean distance the largest by inner
    product; a query has 0 there. A squared projected distance divided by the squared
    true one is a chi-square variable of ``dims`` degrees of freedom.
    """
    a = np.random.default_rng(11).standard_normal((x.shape[1] + 1, dims))
    more = np.sqrt(np.maximum(0.0, most - (x * x).sum(1))) if most > 0 else np.zeros(len(x))
    return x @ a[:-1] + more[:, None] * a[-1]


def leaves_of(p: np.ndarray, size: int = LEAF_ROWS) -> list[np.ndarray]:
    """Leaves of a kd-tree: each node halves its points along its widest coordinate."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        spread = np.ptp(p[own], axis=0)
        order = own[np.argpartition(p[own, int(spread.argmax())], len(own) // 2)]
        todo += [order[len(own) // 2 :], order[: len(own) // 2]]
    return out


def cell_edges(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A kd-tree over a sample as a heap of (coordinate, threshold), its leaves numbered 0 to ``cells`` - 1 (a power of 2)."""
    heap: list[tuple[int, float]] = []
    level = [sample]
    while len(level) < cells:
        after = []
        for part in level:
            j = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            t = float(np.median(part[:, j])) if len(part) else 0.0
            heap.append((j, t))
            after += [part[part[:, j] <= t], part[part[:, j] > t]]
        level = after
    return heap


def cell_of(p: np.ndarray, heap: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(p), np.int64)
    if heap:
        js, ts = np.array([j for j, _ in heap]), np.array([t for _, t in heap])
        for _ in range((len(heap) + 1).bit_length() - 1):
            at = 2 * at + 1 + (p[np.arange(len(p)), js[at]] > ts[at])
        at -= len(heap)
    return at


class Found:
    """The best k different answers (id and score) of each query so far: scores descending, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, most: float, floor: np.ndarray):
        """``floor``: a score that each query's k-th best reaches for sure; what is below it is no answer."""
        self.q, self.ids, self.k, self.most, self.floor = queries, ids, k, most, floor
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.norm = (queries * queries).sum(1)

    def reach(self, stop: float) -> np.ndarray:
        """Squared projected distance beyond which the stopping test holds for each query."""
        d = np.maximum(0.0, self.norm + self.most - 2 * self.worst())
        return stop * d * (1 + 1e-9)

    def worst(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, which: np.ndarray, x: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        """Verifies for queries ``which`` the vectors ``x`` where ``near`` says so."""
        rough = self.q[which] @ x.T
        rough[~near | (self.ids[which][:, None] == ids[None, :])] = -np.inf
        worst = self.worst()[which]
        with np.errstate(invalid="ignore"):
            r, c = np.nonzero((rough > -np.inf) & (rough >= (worst - 1e-9 * (1 + np.abs(worst)))[:, None]))
        if not len(r):
            return
        exact = (self.q[which[r]] * x[c]).sum(1)  # alike wherever a vector stands, so that equal vectors tie
        r, c, exact = (v[exact >= self.floor[which[r]]] for v in (r, c, exact))
        rows = np.unique(r)
        for row in rows:
            own = slice(*np.searchsorted(r, (row, row + 1)))
            q = which[row]
            s = np.concatenate([self.score[q], exact[own]])
            i = np.concatenate([self.id[q], ids[c[own]]])
            order = np.lexsort((i, -s))
            s, i = s[order], i[order]
            best = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])]))[: self.k]
            self.score[q], self.id[q] = -np.inf, np.iinfo(np.int64).max
            self.score[q, : len(best)], self.id[q, : len(best)] = s[best], i[best]


def search_tree(found: Found, projected: np.ndarray, x: np.ndarray, ids: np.ndarray, p: np.ndarray, stop: float, queries: np.ndarray) -> None:
    """Incremental search of one kd-tree for ``queries`` of a block.

    Each query visits the leaves by their least projected distance; before each visit the
    stopping test compares that distance with what its k-th best so far allows, and ends
    the search if no unvisited vector can pass any more. Queries that visit the same leaf
    in a round are verified together.
    """
    leaves = leaves_of(p)
    low = np.stack([p[v].min(0) for v in leaves])
    high = np.stack([p[v].max(0) for v in leaves])
    step = max(1, 4_000_000 // (len(leaves) * p.shape[1]))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        q = projected[some][:, None, :]
        away = (np.maximum(np.maximum(low[None] - q, q - high[None]), 0) ** 2).sum(2)
        order = np.argsort(away, axis=1, kind="stable")
        for t in range(len(leaves)):
            leaf = order[:, t]
            live = away[np.arange(len(some)), leaf] <= found.reach(stop)[some]
            if not live.any():
                break
            order, away, some = order[live], away[live], some[live]
            leaf = leaf[live]
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                own, which = leaves[leaf[group[0]]], some[group]
                d = (projected[which] ** 2).sum(1)[:, None] + (p[own] ** 2).sum(1)[None] - 2 * projected[which] @ p[own].T
                near = d <= (found.reach(stop)[which] * (1 + 1e-9) + 1e-9)[:, None]
                found.add(which, x[own], ids[own], near)


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, stop: float = STOP) -> DataFrame:
    """For each vector whose id is divisible by ``every``, its ``k`` nearest of all others by inner product.

    Returns ``query_id, rank, vec_id, score``. Scores are double precision inner products of
    the vectors given; ties go to the smaller id.

    The index has all rows: each vector's projections to ``dims`` dimensions put it in a
    cell of a kd-tree over a bounded sample, cells are dealt to partitions of about a
    million vectors at most (so partitions grow with the table), and a task builds a
    kd-tree for each run of at most 16,384 vectors. Queries come in blocks of bounded
    bytes. A block first searches each query's own cell; its k-th best there is a floor
    that the search of the whole index starts from, so that every task prunes by a bound
    of the query and not only by what it has seen itself, and gives only answers that
    reach it. Every visit is checked by the stopping test at probability ``stop``, and a
    vector that passes is verified on its full coordinates. The answers of all tasks are
    merged by a ranked window.

    Rows that repeat both id and vector count once. Of equal vectors only the k + 1 of
    smallest ids can be an answer, so the others are left out before anything is dealt
    (Spark ranks within each partition first, which keeps a vector that a third of rows
    share from meeting in one task).

    Vectors that are null, zero, of another length than most (the longest wins a tie), or
    that hold null or non-finite numbers take no part, nor do rows with a null id.
    Repeated ids with other vectors are rows like any other (answers alike in id and score
    count once), but never answer the same id's query. With fewer
    than k candidates all are returned; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = only(df, vec_id=id_col, vec=vector_col)
    exact = isinstance(rows.schema["vec"].dataType, T.ArrayType) and rows.schema["vec"].dataType.elementType == T.DoubleType()
    kind = T.ArrayType(T.DoubleType() if exact else T.FloatType())
    rows = rows.withColumn("vec", F.col("vec").cast(kind)).filter("vec_id is not null and vec is not null and size(vec) > 0")
    rows = rows.filter(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0))
    widths = rows.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["w"]
    rows = rows.filter(F.size("vec") == width)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    copies = Window.partitionBy("vec").orderBy("vec_id")
    kept = written(rows.select("vec_id", "vec").distinct().withColumn("rank", F.row_number().over(copies)).filter(F.col("rank") <= k + 1).select("vec_id", "vec", norm.alias("norm")), "vectors")
    n, most = kept.agg(F.count(F.lit(1)), F.max("norm")).first()
    cells = 1
    while cells * TREE_ROWS // 2 < n and cells < SAMPLE // 8:
        cells *= 2
    sample = kept.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vec"]
    heap = cell_edges(project(np.stack(sample.to_list()).astype(np.float64), most, dims), cells)
    indexed = T.StructType([T.StructField("cell", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("vec", kind)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = project(_matrix(batch.column(1), width), most, dims)
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(p, heap)), batch.column(0), batch.column(1)], schema=arrow_schema(indexed))

    salts = -(-n // (cells * PART_ROWS))  # more than one where a cell is too large for a partition
    dealt = kept.select("vec_id", "vec").mapInArrow(deal, indexed).repartition(cells * salts, "cell", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    index = written(dealt, "index")
    test = chi_square_quantile(stop, dims)
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vec").distinct()

    def answers(block: tuple[np.ndarray, np.ndarray], floor: np.ndarray | None) -> DataFrame:
        """What the index answers to a block; without floors, only each query's own cell is searched."""
        held = spark.sparkContext.broadcast((*block, floor))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, floor = held.value
            q = q.astype(np.float64)
            projected, home = project(q, 0.0, dims), None
            if floor is None:
                home, floor = cell_of(projected, heap), np.full(len(q), -np.inf)
            every_one = Found(q, ids, k, most, floor)
            wait: list[pa.RecordBatch] = []

            def trees() -> None:
                t = pa.Table.from_batches(wait).combine_chunks()
                cell = t.column(0).to_numpy()
                for own in ([np.flatnonzero(cell == c) for c in np.unique(cell)] if home is not None else [np.arange(len(cell))]):
                    which = np.flatnonzero(home == cell[own[0]]) if home is not None else np.arange(len(q))
                    for at in range(0, len(own) if len(which) else 0, TREE_ROWS):
                        part = t.take(pa.array(own[at : at + TREE_ROWS]))
                        x = _matrix(part.column(2), width)
                        search_tree(every_one, projected, x, part.column(1).to_numpy(), project(x, most, dims), test, which)
                wait.clear()

            for batch in batches:
                if batch.num_rows:
                    wait.append(batch)
                if sum(b.num_rows for b in wait) >= TREE_ROWS:
                    trees()
            if wait:
                trees()
            r, c = np.nonzero(every_one.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(r), pa.array(every_one.id[r, c]), pa.array(every_one.score[r, c])], schema=arrow_schema(_FOUND))

        found = written(index.mapInArrow(search, _FOUND), "found")
        held.destroy()
        return found

    best = None
    for block in _blocks(queries, max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * width)))):
        near = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
        home = answers(block, None).distinct()
        floors = home.withColumn("rank", near).filter(F.col("rank") == k).select("place", "score").toPandas()
        floor = np.full(len(block[0]), -np.inf)
        floor[floors["place"].to_numpy(np.int64)] = floors["score"].to_numpy(np.float64)
        some = home.unionByName(answers(block, floor)).select("query_id", "vec_id", "score")
        best = some if best is None else best.unionByName(some)
    if best is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries in blocks of at most ``most``, read one partition at a time."""
    ids, vecs = [], []
    for vec_id, vec in queries.toLocalIterator():
        ids.append(vec_id)
        vecs.append(np.array(vec))
        if len(ids) == most:
            yield np.array(ids, np.int64), np.stack(vecs)
            ids, vecs = [], []
    if ids:
        yield np.array(ids, np.int64), np.stack(vecs)
