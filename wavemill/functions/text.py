"""Text helpers of playlists and protocols, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_match(x: Column, patterns: str) -> Column:
    """Whether x matches one of the patterns, which `,`, `;` or `|` part: `*` is any text, `?` any character. An empty pattern matches only empty text."""
    parts = [p.strip() for p in re.split("[,;|]", patterns)]
    return x.rlike("^(?s:" + "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) for p in parts) + ")$")


def url_parts(url: Column) -> list[Column]:
    """protocol, host (both in lower case) and path; empty where the URL doesn't have it."""
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    return [
        F.lower(part("^([A-Za-z][A-Za-z0-9+.-]*)://")).alias("protocol"),
        F.lower(part("^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")).alias("host"),
        part("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)").alias("path"),
    ]


def playlist_segments(lists: DataFrame) -> DataFrame:
    """(list_id, seq, seconds, url) of m3u8 texts (list_id, text): each URL line takes the EXTINF line before it; a repeated URL counts once."""
    lines = lists.select("list_id", F.posexplode(F.split("text", "\r?\n")).alias("k", "line"))
    order = Window.partitionBy("list_id").orderBy("k")
    tag = F.last(F.when(F.col("line").startswith("#EXTINF:"), F.regexp_extract("line", "^#EXTINF:([0-9.]+)", 1).cast("double")), ignorenulls=True).over(order)
    urls = lines.withColumn("seconds", tag).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    once = urls.groupBy("list_id", F.col("line").alias("url")).agg(F.min("k").alias("k"), F.min_by("seconds", "k").alias("seconds"))
    return once.select("list_id", (F.row_number().over(order) - 1).alias("seq"), "seconds", "url")


def playlist_variants(lists: DataFrame) -> DataFrame:
    """(list_id, seq, bandwidth, url) of master m3u8 texts (list_id, text): each URL line takes the STREAM-INF line before it; URLs without one are left out."""
    lines = lists.select("list_id", F.posexplode(F.split("text", "\r?\n")).alias("k", "line"))
    order = Window.partitionBy("list_id").orderBy("k")
    named = lines.filter(F.trim("line") != "").withColumn("tag", F.lag("line").over(order)).filter(F.col("tag").startswith("#EXT-X-STREAM-INF:") & ~F.col("line").startswith("#"))
    bandwidth = F.regexp_extract("tag", "[:,]BANDWIDTH=([0-9]+)", 1).try_cast("long")
    return named.select("list_id", (F.row_number().over(order) - 1).alias("seq"), bandwidth.alias("bandwidth"), F.col("line").alias("url"))
