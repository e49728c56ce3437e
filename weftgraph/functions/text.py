"""Column expressions for identifiers: tokens, hash buckets, trigrams, fuzzy scores, BM25. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 8-bit residues of the 64-bit FNV-1a offset and prime; sizes and cut-offs of the search operators.
FNV_OFFSET_LOW = 0x25
FNV_PRIME_LOW = 0xB3
DIMS = 256
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
FUZZY_LEAST = 0.15
COSINE_LEAST = 0.05
SUBSTRING_BONUS = 0.3
RANK_WEIGHT = 5.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def identifier_tokens(c: Column) -> Column:
    """Words of an identifier: split at anything but letters and digits, at lower-to-upper and letter-digit borders;
    ASCII-lowered, those of at least two bytes. Null gives an empty array."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    return F.filter(F.split(ascii_lower(spaced), " "), lambda t: F.octet_length(t) >= 2)


def fnv_bucket(token: Column) -> Column:
    """FNV-1a of a token's UTF-8 bytes modulo 256. Only the low byte of the state matters for that residue, so the
    fold stays within small integers."""
    spelled = F.hex(F.encode(token, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(token) - 1), lambda i: F.conv(F.substring(spelled, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.octet_length(token) > 0, F.aggregate(bytes_, F.lit(FNV_OFFSET_LOW), lambda h, b: h.bitwiseXOR(b) * FNV_PRIME_LOW % 256)).otherwise(FNV_OFFSET_LOW)


def trigrams(c: Column) -> Column:
    """Distinct 3-character windows of the text with two spaces at either end; other characters than letters and digits count as spaces."""
    padded = F.concat(F.lit("  "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", " ")), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct elements (1 if both are empty)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def fuzzy_score(query: Column, name: Column, qualified: Column) -> Column:
    """min(1, best trigram similarity of the two names, plus a bonus when the name contains the query)."""
    q = trigrams(query)
    best = F.greatest(jaccard(q, trigrams(name)), jaccard(q, trigrams(qualified)))
    bonus = F.when(F.contains(ascii_lower(name), ascii_lower(query)), F.lit(SUBSTRING_BONUS)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), best + bonus)


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, for full-text search."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25_part(tf: Column, length: Column, mean_length: Column, n: Column, df: Column) -> Column:
    """One term's share of the Okapi score."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
