"""Fill-in-the-middle: a text is cut in three, and its middle goes to the end behind sentinels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is one code point; the other patterns cut between lines or words. Matches must cover the text.
CODE_POINTS = "(?s)."
LINES = "(?s)[^\n]*\n|[^\n]+"
WORDS = r"(?s)\s*\S+|\s+$"

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draws(key: Column) -> list[Column]:
    """Four numbers of 32 bits from the hash of a key."""
    digest = F.sha2(F.concat(F.lit("1:"), key), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No text with a sentinel is cut, and a sentinel can't arise where parts
    meet (none begins with what another ends with), so each part ends at the next sentinel's only place."""

    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return F.substring_index(rest, right, 1) if right else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = CODE_POINTS, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), output, prefix_chars and middle_chars (code points, null
    if plain). Columns of docs with these names are replaced, others stay.

    All draws come from the row's id, so reruns agree and rows of one id are cut alike; a null id counts as an empty one.
    Null texts count as empty; an empty text, one that holds a sentinel and one that the units don't cover stay plain.
    Rows are independent: no shuffle, memory for one text's units at a time. An empty table stays empty."""
    own = docs.drop("n", "form", "output", "prefix_chars", "middle_chars")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = _draws(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    cut = own.withColumn("_fim_units", F.regexp_extract_all(text, F.lit(units), F.lit(0)))
    n = F.size("_fim_units")
    cut = cut.withColumns({"n": n.cast("bigint"), "_fim_low": F.least(h1 % (n + 1), h2 % (n + 1)).cast("int"), "_fim_high": F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int")})

    def part(since: Column, until: Column) -> Column:
        return F.array_join(F.slice("_fim_units", since + 1, until - since), "")

    parts = F.struct(part(F.lit(0), F.col("_fim_low")).alias("prefix"), part(F.col("_fim_low"), F.col("_fim_high")).alias("middle"), part(F.col("_fim_high"), F.size("_fim_units")).alias("suffix"))
    cut = cut.withColumn("_fim_parts", parts).drop("_fim_units", "_fim_low", "_fim_high")
    p = F.col("_fim_parts")
    sentinel = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    whole = F.concat(p["prefix"], p["middle"], p["suffix"]) == text
    form = F.when((text == "") | sentinel | ~whole | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    form = F.col("form")
    psm = F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"])
    spm = F.concat(F.lit(SUFFIX), p["suffix"], F.lit(PREFIX), p["prefix"], F.lit(MIDDLE), p["middle"])
    cut = cut.withColumns(
        {
            "output": F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text),
            "prefix_chars": F.when(form != "plain", F.length(p["prefix"]).cast("bigint")),
            "middle_chars": F.when(form != "plain", F.length(p["middle"]).cast("bigint")),
        }
    )
    return cut.drop("_fim_parts")
