"""PNG files as bytes, and images that pages refer to."""

import struct
import zlib

from pyspark.sql import functions as F

from auditloom.sources import images


def chunk(kind, data=b""):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


HEAD = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
DATA, END = chunk(b"IDAT", bytes(range(256)) * 5), chunk(b"IEND")
GOOD = HEAD + DATA + END


def test_png_files(spark, tmp_path):
    corrupt = bytearray(GOOD)
    corrupt[-40] ^= 1
    made = {
        "good": GOOD, "several": HEAD + DATA + chunk(b"tEXt", b"x" * 70_000) + DATA + END, "short": HEAD + END, "signature": b"GIF89a!!" + GOOD[8:], "checksum": bytes(corrupt),
        "header": HEAD + DATA + b"\0\0\0", "chunk": GOOD[:-30], "trailing": GOOD + b"\0", "ending": HEAD + DATA + chunk(b"IEND", b"x"), "no_end": HEAD + DATA, "no_data": HEAD + chunk(b"tEXt", b"y" * 2000) + END,
    }
    (tmp_path / "deep").mkdir()
    for name, data in made.items():
        (tmp_path / ("deep" if name == "good" else ".") / f"{name}.png").write_bytes(data)
    (tmp_path / "other.txt").write_text("no image")
    told = images.files(spark, f"file://{tmp_path}").select(F.regexp_extract("path", r"(\w+)\.png$", 1).alias("name"), images.png_problem(F.col("content")).alias("problem"))
    expected = {"good": None, "several": None, "short": "too short", "signature": "signature", "checksum": "checksum", "header": "truncated header", "chunk": "truncated chunk", "trailing": "trailing data", "ending": "ending", "no_end": "no ending", "no_data": "no data"}
    assert {r.name: r.problem for r in told.collect()} == expected
    bare = spark.createDataFrame([(None,), (bytearray(),)], "content binary")
    assert {r[0] for r in bare.select(images.png_problem(F.col("content"))).collect()} == {"too short"}


def test_referenced_images(spark):
    ld = '<script type="application/ld+json">{"@type":"Organization","logo":"https://www.a.com/logo.png","image":"https://cdn.com/x.png","url":"https://a.com/page","thumbnailUrl":"https://a.com/T.JPEG"}</script>'
    many = "".join(f'<script type="application/ld+json">{{"image":"https://b.com/{i:02}.png"}}</script>' for i in range(20))
    rows = [(1, "a.com", "https://a.com/", 200, ld + '<meta property="og:image" content="/card.webp">'), (2, "a.com", "https://a.com/x", 404, ld.replace("logo.png", "gone.png")), (3, "a.com", "https://a.com/y", 200, None), (4, "b.com", "https://b.com/", 200, many)]
    found = images.referenced(spark.createDataFrame(rows, "page_id long, site string, url string, status int, html string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.site, set()).add(r.url)
    assert got["a.com"] == {"https://www.a.com/logo.png", "https://a.com/T.JPEG", "https://a.com/card.webp"}
    assert got["b.com"] == {f"https://b.com/{i:02}.png" for i in range(15)}
    captured = spark.createDataFrame([("https://www.a.com/logo.png", 404), ("https://a.com/card.webp", 200)], "url string, status int")
    assert {r.url: r.status for r in images.probed(found.where("site = 'a.com'"), captured).collect()} == {"https://www.a.com/logo.png": 404, "https://a.com/card.webp": 200, "https://a.com/T.JPEG": 0}
