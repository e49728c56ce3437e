"""What web pages carry: script blocks, links, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"


def script_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, block, body, first_line``: each script element with the line that its text starts in."""
    found = pages.select(key, F.col(html).alias("_h"), F.posexplode(F.regexp_extract_all(html, F.lit(_SCRIPT), 1)).alias("block", "body"))
    before = F.split("_h", r"(?i)<script[^>]*>", -1)[0]
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return found.select(key, "block", "body", F.when(F.col("block") == 0, line).alias("first_line"))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), 1)


def resolved(base: Column, link: Column) -> Column:
    """A link as an address: absolute links stay, rooted ones take the base's host, others its folder."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(link.rlike("^[a-z]+://"), link).when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(F.concat(folder, link))


def links(pages: DataFrame) -> DataFrame:
    """``page_id, target``: distinct addresses that each page links to."""
    return pages.select("page_id", "url", F.explode(hrefs(F.col("html"))).alias("link")).select("page_id", resolved(F.col("url"), F.col("link")).alias("target")).distinct()
