"""A corpus pipeline: rejects low quality, drops copies and near copies, mixes sources, and encodes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import exact_dedup, mixing, quality, sentencepiece_nbest, simhash
from auditloom.llm.common import stash
from auditloom.llm.queries import N_BEST, PIECES

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, score_col="_quality")
    return scored.where(scored["_quality"] >= LEAST_QUALITY).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more."""
    return simhash.drop_similar(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's best segmentation, how many are known of those asked for and how far the last of them falls behind, and the text that the best one's ids
    decode to."""
    model = sentencepiece_nbest.read_model(PIECES)
    # the other stages need the memory; decoding takes place in the same tasks
    encoded = sentencepiece_nbest.encode(docs, model, N_BEST, verify=True, cached=50_000, keep=False, back=True)
    best = F.col("nbest")[0]
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        best["ids"].alias("ids"),
        best["score"].alias("score"),
        F.size("nbest").alias("n_segmentations"),
        (best["score"] - F.element_at("nbest", -1)["score"]).alias("margin"),
        F.col("decoded").alias("text"),
        F.col("lossless").alias("round_trip"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: The stages train a classifier, hash and search lattices, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stash(docs, "stage")
    return docs
