"""Tables with keys: idempotent inserts, updates folded from a change log, claims, and batch outreach."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions import validation


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of new that an insert would take: no key is in existing yet or in an earlier row of new that is taken for
    the same key. Every column of keys is unique by itself; nulls never conflict."""
    rows = new
    for key in keys:
        known = existing.where(F.col(key).isNotNull()).select(key).distinct()
        rows = rows.join(known, key, "left_anti")
        first = F.row_number().over(W.partitionBy(key).orderBy(order))
        rows = rows.withColumn("_n", F.when(F.col(key).isNull(), 1).otherwise(first)).where("_n = 1").drop("_n")
    return rows


def fold_changes(changes: DataFrame, key: str, order: str, kept: list[str], overwritten: list[str]) -> DataFrame:
    """The row that a log of updates leaves for each key: kept columns have their last value that isn't null,
    overwritten ones the last value, null or not."""
    kept_now = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in kept]
    last = [F.max_by(c, order).alias(c) for c in overwritten]
    return changes.groupBy(key).agg(*kept_now, *last)


def claims(rows: DataFrame, asked: DataFrame, key: str, order: str, waiting: str = "needs_url") -> DataFrame:
    """Who gets each row that still waits: the first to ask."""
    first = asked.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(rows.where(F.col("status") == waiting).select(key), key, "left_semi")


def recent(rows: DataFrame, when: str, key: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(when), key).limit(most)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def outreach(prospects: DataFrame, suppressed: DataFrame, scores: DataFrame, most: int = 70) -> DataFrame:
    """What happens to each prospect: an invalid address, an unsubscribed one, an error where there is no score, a
    score that is too high, or mail. suppressed: (email), normalised; scores: (url, score)."""
    named = prospects.withColumn("norm_email", validation.email_normalized(F.col("email")))
    stopped = suppressed.select(F.col("email").alias("norm_email")).distinct().withColumn("stopped", F.lit(True))
    told = named.join(stopped, "norm_email", "left").join(scores, "url", "left")
    status = (
        F.when(F.col("norm_email").isNull(), "SKIP_INVALID_EMAIL").when(F.col("stopped"), "SKIP_UNSUBSCRIBED").when(F.col("score").isNull(), "ERROR").when(F.col("score") < most, "YES").otherwise("NO_SCORE_TOO_HIGH")
    )
    return told.select(*prospects.columns, "norm_email", "score", status.alias("outcome"))


def mailable(prospects: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Prospects with a valid address that isn't suppressed."""
    named = prospects.withColumn("norm_email", validation.email_normalized(F.col("email"))).where("norm_email is not null")
    return named.join(suppressed.select(F.col("email").alias("norm_email")), "norm_email", "left_anti")


def enrich(orders: DataFrame, leads: DataFrame) -> DataFrame:
    """Orders with the site and address of the lead that they name, where their own are missing."""
    found = leads.select(F.col("id").alias("lead_id"), F.col("email").alias("_email"), F.col("scanned_url").alias("_url"))
    joined = orders.join(found, "lead_id", "left")
    return joined.withColumn("email", F.coalesce("email", "_email")).withColumn("site_url", F.coalesce("site_url", "_url")).drop("_email", "_url")


def stages(jobs: DataFrame, failed: str = "failed") -> DataFrame:
    """Retry: failed jobs start again, without their error and draft."""
    again = F.col("status") == failed
    return jobs.withColumns({"status": F.when(again, "received").otherwise(F.col("status")), **{c: F.when(~again, F.col(c)) for c in ("error", "draft")}})
