"""A bounded sample of labelled rows, for fitting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most bound labelled rows, one for each id (of repeated ids the text with the least hash), never of those held out (crc32 of the id as text, modulo
    modulus, equal to held_out). Which ones: the smallest in a hash order of the ids, so that reruns agree.
    Null ids and null labels don't count; of several labels of an id the largest does. The sample's ids are few
    by the bound, so they go to every task that reads docs, and no text is shuffled for them."""
    key = F.col(id_col)
    fold = F.crc32(key.cast("string").cast("binary")) % modulus
    told = labels.where(key.isNotNull() & F.col(label_col).isNotNull() & (fold != held_out)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    some = told.orderBy(F.xxhash64(key), key).limit(bound)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(some), id_col)
    return rows.groupBy(id_col).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.any_value("y").alias("y"))
