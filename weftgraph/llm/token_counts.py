"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies, without ids."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, only, written
from .pretokens import pieces_of

#: Distinct pre-tokens, and their characters, that are broadcast with their counts; beyond, only the most frequent ones are.
BROADCAST_WORDS = 500_000
BROADCAST_CHARS = 32_000_000


def frequencies(text: str, path: str) -> tuple[Counter, int]:
    """How often each pre-token occurs in a text, and the number of special strings in it (a token each).

    A tokenizer whose special strings take blanks with them, say, is asked for the whole text's tokens instead.
    """
    tok = pieces_of(path, "counts")
    if not tok.plain_special:
        return Counter(), len(tok.whole(text))
    parts, special = tok.segments(text)
    freq: Counter = Counter()
    for part in parts:
        freq.update(tok.pretokens(part))
    return freq, len(special)


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit).

    No begin, end or added tokens; special strings inside a text count as the library
    takes them by default (one token each).

    1. One narrow pass splits every text and writes its pre-tokens with their frequencies.
    2. The distinct pre-tokens of the whole table (partial aggregates first, so frequent
       ones never meet in a task) are encoded once each, for their number of pieces.
    3. Frequencies are joined to these numbers and summed by document. If the counted
       pre-tokens are few, they are broadcast. If not, only the most frequent ones are, up
       to the same bound, and the rest, none of which is in many documents, is joined by a
       shuffle: so no key is hot in it.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    give repeated results; an empty table gives none; other columns are ignored.
    """

    def split(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"place": batch.column(0), "doc_id": batch.column(1), "n_bytes": batch.column(2), "special": [], "words": [], "times": []}
        for text in batch.column(3).to_pylist():
            freq, special = frequencies(text or "", tokenizer_path)
            out["special"].append(special)
            out["words"].append(list(freq))
            out["times"].append(list(freq.values()))
        return out

    def encode(batch: pa.RecordBatch) -> dict[str, list]:
        return {"word": batch.column(0), "docs": batch.column(1), "pieces": pieces_of(tokenizer_path, "counts").numbers(batch.column(0).to_pylist())}

    rows = only(df, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("place"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    freqs = written(map_rows(rows, split, "place bigint, doc_id bigint, n_bytes bigint, special bigint, words array<string>, times array<int>"), "frequencies")
    distinct = freqs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    pieces = written(map_rows(distinct, encode, "word string, docs bigint, pieces bigint"), "pieces")

    each = freqs.select("place", F.explode(F.arrays_zip("words", "times")).alias("x")).select("place", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    n, chars = pieces.agg(F.count(F.lit(1)), F.sum(F.length("word"))).first()
    share = min(1.0, BROADCAST_WORDS / max(1, n), BROADCAST_CHARS / max(1, chars or 0))
    if share >= 1.0:
        found = each.join(F.broadcast(pieces.select("word", "pieces")), "word")
    else:
        least = pieces.agg(F.percentile_approx("docs", 1.0 - share / 2, 10_000)).first()[0]
        frequent = (F.col("docs") > least) & (F.length("word") <= 64)
        often = F.broadcast(pieces.filter(frequent).select("word", "pieces"))
        found = each.join(often, "word").unionByName(each.join(often.select("word"), "word", "left_anti").join(pieces.filter(~frequent).select("word", "pieces"), "word"))
    sums = found.groupBy("place").agg(F.sum(F.col("times") * F.col("pieces")).alias("n"))
    counted = freqs.select("place", "doc_id", "n_bytes", "special").join(sums, "place", "left")
    tokens = F.col("special") + F.coalesce("n", F.lit(0))
    return counted.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
