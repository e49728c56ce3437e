"""Language identification by prediction by partial matching (PPM) with frozen statistics."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checked_broadcast, filter_rows, map_rows, only, worker_state, written

#: Labelled rows of a language that the trees are grown from: those with the smallest hashes of their ids.
TRAIN_DOCS = 1000
ORDER = 3
UNKNOWN = "und"
#: Bytes of a worker's table of costs; languages beyond what it holds are judged in further passes.
TABLE_BYTES = 256 << 20
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
_PAD = b" " * ORDER


def seen_bytes(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    seen = np.zeros(256, bool)
    for codes, _ in grams.values():
        seen[codes & 255] = True
    seen[32] = True
    return seen


def language_blocks(langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], most: int | None = None) -> list[list[str]]:
    """Languages in blocks whose tables of costs take at most ``most`` bytes (or hold one language)."""
    a = int(seen_bytes(grams).sum()) + 1
    out: list[list[str]] = []
    contexts = 0
    for lang in langs:
        own = len(np.unique(grams[lang][0] >> 8)) if lang in grams else 0
        if out and 4 * (a * a + contexts + own) * a * (len(out[-1]) + 1) <= (most or TABLE_BYTES):
            out[-1].append(lang)
            contexts += own
        else:
            out.append([lang])
            contexts = own
    return out


class Trees:
    """Per-language context trees of order 0 to 3, compiled to one table of exact code lengths.

    Escapes follow PPM method C without exclusion: a context with N symbols seen, D of them
    distinct, gives a seen symbol count / (N + D) and an escape D / (N + D) to the next
    shorter context; order -1 is uniform over 256 bytes. A context never seen costs nothing
    to leave. Bytes never seen in training share one class, whose cost is the escapes
    plus 8 bits. The three bytes before a text count as spaces. ``langs`` may be some of
    those that ``grams`` has.
    """

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        seen = seen_bytes(grams)
        self.classes = np.cumsum(seen) - 1
        a = self.size = int(seen.sum()) + 1
        self.of_byte = np.where(seen, self.classes, a - 1).astype(np.int64)
        split = {}
        for lang in langs:
            codes, n = grams.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            split[lang] = np.stack([self.of_byte[(codes >> s) & 255] for s in (24, 16, 8, 0)]) if len(codes) else np.zeros((4, 0), np.int64), n
        c3 = np.unique(np.concatenate([(g[0] * a + g[1]) * a + g[2] for g, _ in split.values()] or [np.zeros(0, np.int64)]))
        self.row = np.tile(np.arange(a * a, dtype=np.int32), a)
        self.row[c3] = a * a + np.arange(len(c3), dtype=np.int32)
        self.cost = np.empty(((a * a + len(c3)) * a, len(langs)), np.float32)
        for k, lang in enumerate(langs):
            g, n = split[lang]
            below = np.full((1, a), 8.0)
            for order, rows in ((0, 1), (1, a), (2, a * a)):
                context = np.zeros(len(n), np.int64)
                for j in range(3 - order, 3):
                    context = context * a + g[j]
                below = self._level(np.bincount(context * a + g[3], n, rows * a).reshape(rows, a), np.tile(below, (rows // len(below), 1)))
            self.cost[: a * a * a, k] = below.ravel()
            if len(c3):
                context = np.searchsorted(c3, (g[0] * a + g[1]) * a + g[2])
                top = self._level(np.bincount(context * a + g[3], n, len(c3) * a).reshape(len(c3), a), below[c3 % (a * a)])
                self.cost[a * a * a :, k] = top.ravel()

    @staticmethod
    def _level(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = -np.log2(count / (total + distinct))
            escape = -np.log2(distinct / (total + distinct))
        return np.where(total == 0, below, np.where(count > 0, here, escape + below))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        step, a = 1 << 18, self.size
        ends = np.cumsum([len(t) + ORDER for t in texts])
        run = self.of_byte[np.frombuffer(b"".join([x for t in texts for x in (_PAD, t)]) or _PAD, np.uint8)]
        for at in range(ORDER, len(run), step):
            to = min(at + step, len(run))
            context = (run[at - 3 : to - 3] * a + run[at - 2 : to - 2]) * a + run[at - 1 : to - 1]
            bits = self.cost[self.row[context].astype(np.int64) * a + run[at:to]]
            doc = np.searchsorted(ends, np.arange(at, to), side="right")
            pad = np.arange(at, to) - (ends[doc] - np.array([len(t) + ORDER for t in texts])[doc]) < ORDER
            bits[pad] = 0
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[first]] += np.add.reduceat(bits.astype(np.float64), first)
        return out


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of 4 bytes (three of context) with their counts, each text padded in front by spaces."""
    codes = []
    for t in texts:
        b = np.frombuffer(_PAD + t, np.uint8).astype(np.int64)
        codes.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
    return np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)


def held_out(doc_id: str) -> F.Column:
    """crc32 of the id as text, mod 3, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(df: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Languages, and counts of each one's 4-grams, over at most ``train_docs`` whole texts of a language.

    ``df`` has ``doc_id, text, lang``. Rows are named by a hash of id and text; those of a
    language are thinned by it to about twice as many as wanted and the least ranked, so a
    hot language does not gather in one task, and repeated rows or ids (also null ones)
    bring no more texts than others. The texts are then read for those hashes alone, once
    each. What reaches the driver is bounded by languages times ``train_docs`` texts'
    distinct 4-grams.
    """
    rows = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # A hash below the share that leaves about twice as many rows as wanted: a hot language is thinned in the scan.
    share = rows.groupBy("lang").agg((F.lit(2.0 * train_docs) / F.approx_count_distinct("h")).alias("share"))
    unit = F.col("h") / F.lit(2.0**64) + 0.5
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keep = rows.select("lang", "h").join(checked_broadcast(share), "lang").filter(unit < F.col("share")).select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= train_docs).select("lang", "h")
    few = keep.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        keep = F.broadcast(df.sparkSession.createDataFrame(few, keep.schema))
    chosen = rows.join(keep, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            by.setdefault(lang, []).append(text)
        out: dict[str, list] = {"lang": [], "code": [], "n": []}
        for lang, texts in by.items():
            codes, n = gram_counts(texts)
            out["lang"] += [lang] * len(codes)
            out["code"] += codes.tolist()
            out["n"] += n.tolist()
            if not len(codes):
                out["lang"].append(lang), out["code"].append(None), out["n"].append(0)
        return out

    counts = map_rows(chosen, count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    grams = {}
    for lang, part in counts[counts["code"].notna()].groupby("lang"):
        part = part.sort_values("code")
        grams[lang] = part["code"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
    return langs, grams


def code_lengths(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> list[Callable[[list], list[tuple[str, float, float] | None]]]:
    """Functions for executors, one for each block of languages, learned from ``rows`` (``doc_id, text, lang``).

    Each tells of a text the block's best language, its code length in bits, and the sum of
    2^-(a language's length - the best's) over the block; None of a text without letters.
    """
    langs, grams = fit(rows, train_docs)
    model = rows.sparkSession.sparkContext.broadcast(grams)

    def judge(texts: list[str | None], block: list[str], key: str) -> list[tuple[str, float, float] | None]:
        out: list[tuple[str, float, float] | None] = [None] * len(texts)
        trees = worker_state(("trees", key), lambda: Trees(block, model.value))
        judged = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in range(0, len(judged), 128):
            some = judged[at : at + 128]
            bits = trees.bits([texts[k].encode() for k in some])
            least = bits.min(1, keepdims=True)
            total = np.exp2(np.clip(least - bits, -1074, 0)).sum(1)
            for k, b, x, s in zip(some, bits.argmin(1).tolist(), least[:, 0].tolist(), total.tolist()):
                out[k] = trees.langs[b], x, s
        return out

    return [functools.partial(judge, block=block, key=uuid.uuid4().hex) for block in language_blocks(langs, grams)]


def _said(judges: list, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, where one block has all languages (or there are none)."""
    found = judges[0](texts) if judges else [None] * len(texts)
    return [(f[0], 1 / f[2]) if f else (UNKNOWN, 0.0) for f in found]


def _in_passes(judges: list, source: DataFrame) -> DataFrame:
    """``place, lang_pred, score`` of texts with a letter (``source`` has ``place, text``): a narrow pass for each block of languages, merged by place."""

    def one(judge) -> DataFrame:
        def fold(batch: pa.RecordBatch) -> dict[str, list]:
            found = [(p, *f) for p, f in zip(batch.column(0).to_pylist(), judge(batch.column(1).to_pylist())) if f]
            return dict(zip(("place", "lang", "bits", "total"), map(list, zip(*found)) if found else ([], [], [], [])))

        return written(map_rows(source.select("place", "text"), fold, "place bigint, lang string, bits double, total double"), "languages")

    every = functools.reduce(DataFrame.unionByName, [one(judge) for judge in judges])
    best = every.groupBy("place").agg(F.min(F.struct("bits", "lang")).alias("best"), F.collect_list(F.struct("bits", "total")).alias("parts"))  # a part a block
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["total"] * F.pow(F.lit(2.0), F.col("best.bits") - x["bits"]))
    return best.select("place", F.col("best.lang").alias("lang_pred"), (1 / total).alias("score"))


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score``.

    Learned from rows with a language whose crc32(id as text) mod 3 is not 1, at most
    ``train_docs`` a language. The prediction has the least exact code length over all
    bytes of the text (ties: the first name); ``score`` is its share of 2^-length over
    all languages. Prediction sees the text alone and is one narrow pass; where the tables of all
    languages take more than ``TABLE_BYTES``, one for each block of languages, merged.

    Null text, or one without a letter: ``und`` with score 0. No labelled rows: all are
    ``und``. A null id is scored like any other; repeated rows give repeated results;
    an empty table gives none; other columns are ignored.
    """
    rows = only(df, doc_id=id_col, text=text_col, lang=lang_col)
    judges = code_lengths(rows, train_docs)
    wanted = rows.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    if len(judges) > 1:
        source = written(wanted.withColumn("place", F.monotonically_increasing_id()), "docs")
        found = source.drop("text").join(_in_passes(judges, source), "place", "left")
        return found.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))

    def fold(batch: pa.RecordBatch) -> dict[str, list]:
        said = _said(judges, batch.column(2).to_pylist())
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [p for p, _ in said], "score": [s for _, s in said]}

    return map_rows(wanted, fold, SCHEMA)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is known with a score of at least ``least``.

    Rows of null or empty text or without a letter go, as do all rows if none has a
    language to learn from. A null id is one like others; repeated rows stay or go alike;
    an empty table gives none. Of languages that tie the first name counts.
    """
    judges = code_lengths(only(df, doc_id=id_col, text=text_col, lang=lang_col))
    if len(judges) > 1:
        columns = [f"c{k}" for k in range(len(df.columns))]
        source = written(df.toDF(*columns).withColumn("place", F.monotonically_increasing_id()), "docs")
        known = _in_passes(judges, source.select("place", F.col(columns[df.columns.index(text_col)]).alias("text"))).filter(F.col("score") >= least)
        return source.join(known, "place", "left_semi").select(*columns).toDF(*df.columns)

    def keep(texts: list) -> list[bool]:
        return [p != UNKNOWN and s >= least for p, s in _said(judges, texts)]

    return filter_rows(df, text_col, keep)
