"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame operations alone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """1 to 2: one and the share of letters among the characters; 1 for an empty or null text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(1.0) + F.coalesce(F.try_divide(letters, F.length(text)), F.lit(0.0))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh as weights, repeating. share of all sizes is dealt out by
    weight; a target stops at most times its source's size, and what that leaves over is dealt again by
    weight. In closed form: sources are capped in the order of cap / weight, as long as that quotient is at
    most the level (what is left) / (the weight left); the others get their weight times the level.
    Sources number few against documents; the window over them holds a row for each source.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    table = F.lit([float(w) for w in weights]).cast("array<double>")
    weighed = sizes.withColumn("_w", F.get(table, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy(F.lit(0))
    by_quotient = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    upto = by_quotient.rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = F.try_divide(budget - (F.sum("_cap").over(upto) - F.col("_cap")), F.sum("_w").over(everything) - (F.sum("_w").over(upto) - F.col("_w")))
    capped = weighed.withColumn("_level", level).withColumn("_hit", F.col("_cap") / F.col("_w") <= F.col("_level"))
    rest = capped.withColumn("_final", F.min_by("_level", F.when(~F.col("_hit"), F.col("_cap") / F.col("_w"))).over(everything))
    return rest.select("source", "source_size", F.when(F.col("_hit"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_final"))).alias("target"))


def _sampled(slim: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """slim (_row, source, size, _key, ...) with source_size, target and taken."""
    sized = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stash(source_targets(sized, weights, share, most), "targets").withColumnRenamed("source", "_source")
    ranged = stash(slim.repartitionByRange("source", "_key", "_row").withColumn("_part", F.spark_partition_id()), "ranged")
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("source", "_part").agg(F.sum("size").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    parts = parts.select(F.col("source").alias("_psource"), F.col("_part").alias("_ppart"), "_before", "_sum")
    told = parts.join(targets, F.col("_psource").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    told = told.withColumn("_epochs", epochs).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    rows = ranged.join(told, (F.col("_part") == F.col("_ppart")) & F.col("source").eqNullSafe(F.col("_psource")))
    within = W.partitionBy("_part", "source").orderBy("_key", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("_before") + F.sum("size").over(within)
    # a document is taken once more if at least half of it lies within what is left of the budget
    once = F.when(end - F.col("size") / 2 <= F.col("_rest"), F.col("size")).otherwise(F.lit(0))
    return rows.withColumn("taken", (F.col("_epochs") * F.col("size") + once).cast("bigint"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int, *more: Column) -> DataFrame:
    text = F.col(text_col)
    weight = quality_weight(text) if quality is None else quality
    # uniform in (0, 1] from the document itself, so that reruns agree
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11).cast("double") + 1) / F.lit(float(1 << 53))
    return docs.select(
        *more,
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
        (-F.log(uniform) / weight).alias("_key"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, quality: Column | None = None, seed: int = 7) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of docs.

    Size counts words; a null text has 0. A source's target divided by its size gives complete epochs, in
    which every document is taken; the rest of the target goes to the documents with the smallest keys
    -ln(u) / weight, in that order, as far as the prefix sum of sizes goes (a document that straddles the end
    counts if at least half of it fits). u comes from a hash of seed, id and text; equal rows tie and are told
    apart by their place, so the result as a bag of rows is the same in every run. Keys are range-partitioned
    by source and key: a hot source spreads over many partitions, and prefix sums run in each partition above
    the sums of those before it. A null source is a source of its own, the last one. Empty tables give empty
    results; further columns of docs are ignored. quality: an expression for the weight, over 0; by default
    quality_weight().
    """
    slim = stash(_slim(docs, id_col, text_col, source_col, quality, seed), "sizes")
    return _sampled(slim, list(weights), share, most).select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, quality: Column | None = None, seed: int = 7) -> DataFrame:
    """The mixed table itself: the rows of docs, each as many times as the mix takes it. A row without words
    takes nothing from any budget and stays once."""
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    whole = stash(_slim(docs, id_col, text_col, source_col, quality, seed, packed), "mixed")
    taken = _sampled(whole.drop("_doc"), list(weights), share, most)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    counted = taken.select("_row", times.alias("_times")).where("_times > 0")
    repeated = whole.join(counted, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
