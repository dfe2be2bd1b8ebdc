"""Image files: a binary source, PNG checks, and the images that pages refer to."""

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from auditloom.functions import html, urls

# Fixed values
SIGNATURE, LEAST_BYTES, MOST_PROBES = bytes.fromhex("89504e470d0a1a0a"), 1000, 15
REFERRED = r'(?i)"(?:logo|image|primaryImageOfPage|thumbnailUrl|url)"\s*:\s*"(https?://[^"]+\.(?:png|jpe?g|gif|webp|avif|svg))"'


def files(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, length, modificationTime, content) of the files below a folder, in any store that Spark reads; files without a byte aren't
    listed by it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def _problem(data: bytes | None, least: int) -> str | None:
    if data is None or len(data) <= least:
        return "too short"
    if data[:8] != SIGNATURE:
        return "signature"
    at, seen_data = 8, False
    while at < len(data):
        if at + 12 > len(data):
            return "truncated header"
        length, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        end = at + 12 + length
        if end > len(data):
            return "truncated chunk"
        if zlib.crc32(memoryview(data)[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return "checksum"
        seen_data = seen_data or kind == b"IDAT"
        if kind == b"IEND":
            return "ending" if length else "no data" if not seen_data else "trailing data" if end < len(data) else None
        at = end
    return "no ending"


def png_problem(content: Column, least: int = LEAST_BYTES) -> Column:
    """What is wrong with a PNG file, null if nothing: too short (at most `least` bytes), signature, truncated header, truncated chunk,
    checksum, ending (not empty), no data, trailing data or no ending. Chunks are walked in order, each by its own length."""

    @pandas_udf("string")
    def judge(contents: pd.Series) -> pd.Series:
        return contents.map(lambda data: _problem(data, least)).astype(object)

    return judge(content)


def referenced(pages: DataFrame, most: int = MOST_PROBES) -> DataFrame:
    """(site, url): the images of a site that its pages name in JSON-LD or og:image, at most `most` a site: those of its first pages, in their
    order. Only addresses of the site itself, with or without www. pages: (page_id, site, url, status, html)."""
    raw = F.coalesce(F.col("html"), F.lit(""))
    named = F.flatten(F.transform(html.ld_json_bodies(raw), lambda b: F.regexp_extract_all(b, F.lit(REFERRED), F.lit(1))))
    card = html.meta_content(html.without_raw(raw), "property", "og:image")
    found = pages.where("status between 200 and 299").select("site", "page_id", F.col("url").alias("page"), F.posexplode(F.concat(F.array(card), named)).alias("pos", "href"))
    full = found.where("href <> ''").withColumn("url", urls.resolve(F.col("href"), F.col("page")))
    own = full.where(urls.scheme(F.col("url")).isin("http", "https") & (urls.strip_www(urls.host(F.col("url"))) == urls.strip_www(F.col("site"))))
    first = own.groupBy("site", "url").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    place = F.row_number().over(W.partitionBy("site").orderBy("at", "url"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("site", "url")


def probed(images: DataFrame, captured: DataFrame) -> DataFrame:
    """images (site, url) with the status of their capture (url, status), 0 where there is none; for site_rows.probe_rows()."""
    status = captured.groupBy("url").agg(F.max("status").alias("status"))
    return images.join(status, "url", "left").select("site", "url", F.coalesce("status", F.lit(0)).alias("status"))
