"""List files and CSV rows, read and written by their own rules."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a text file; ord grows along the file, with gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def _unquoted(v: Column) -> Column:
    return F.regexp_replace(F.trim(v), "^[\"']|[\"']$", "")


def url_list(lines: DataFrame) -> DataFrame:
    """(ord, url): the first comma field of each line, one quote off either end; blank lines, # lines and headers named
    url go; of URLs equal but for the size of letters the first stays."""
    found = lines.select("ord", F.trim(_unquoted(F.substring_index("line", ",", 1))).alias("url"))
    good = found.where((F.col("url") != "") & ~F.col("url").startswith("#") & (F.lower("url") != "url"))
    return good.groupBy(F.lower("url").alias("k")).agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord")).select("ord", "url")


def prospects(lines: DataFrame, mode: str = "smb") -> DataFrame:
    """(ord, url, name, email, mode) from plain comma fields; a header counts as one in the first line only."""
    cells = F.transform(F.split("line", ","), _unquoted)
    start = lines.agg(F.min("ord").alias("start"))
    rows = lines.crossJoin(F.broadcast(start)).select("ord", (F.col("ord") == F.col("start")).alias("head"), cells.alias("c"))  # one row
    at = lambda i, default: F.coalesce(F.nullif(F.get("c", F.lit(i)), F.lit("")), F.lit(default))
    named = rows.select("ord", "head", at(0, "").alias("url"), at(1, "Founder").alias("name"), at(2, "").alias("email"), at(3, mode).alias("mode"))
    return named.where((F.col("url") != "") & ~(F.col("head") & (F.lower("url") == "url"))).drop("head")


def csv_cell(v: Column, special: str = '[",\\n]') -> Column:
    """A cell, quoted if it holds something special; null is empty."""
    text = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(text.rlike(special), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_list(v: Column, separator: str = "|") -> Column:
    return F.array_join(v, separator)


def csv_rows(df: DataFrame, special: str = '[",\\n]') -> DataFrame:
    """Each row of df as one CSV line."""
    return df.select(F.concat_ws(",", *(csv_cell(F.col(c), special) for c in df.columns)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    head = df.sparkSession.createDataFrame([(",".join(df.columns),)], "line string")
    head.unionByName(csv_rows(df)).write.mode("overwrite").text(path)


def captured(spark: SparkSession, path: str, most_bytes: int = 2 << 20) -> DataFrame:
    """Captured responses (url, status, text, ...) without those whose body is longer than a fetch takes."""
    return spark.read.parquet(path).where(F.octet_length("text") <= most_bytes)


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of every .html file below folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    return found.select("path", F.decode("content", "utf-8").alias("html"))
