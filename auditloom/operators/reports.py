"""Traffic, conversion and order reports, and free-tier projections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
PERIOD_DAYS = {"weekly": 7, "monthly": 30}
FILLER = "Review your structured data and crawler settings."


def in_period(events: DataFrame, when: str, end: Column, period: str) -> DataFrame:
    """Events of the last 7 or 30 days before end, with end."""
    return events.where((F.col(when) > end - F.expr(f"INTERVAL {PERIOD_DAYS[period]} DAYS")) & (F.col(when) <= end))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(100.0 * a, b), 2), F.lit(0.0))


def conversions(events: DataFrame, day: str = "day") -> DataFrame:
    """Per day: sessions (views), users, and the shares of sign-ups, clicks and purchases among sessions, and of errors
    among users, in percent."""
    of = {k: F.count_if(F.col("event_type") == k) for k in ("view", "signup", "click", "purchase", "error")}
    counted = events.groupBy(day).agg(F.countDistinct("user_id").alias("users"), *(v.alias(k) for k, v in of.items()))
    rates = {f"{k}_rate": _rate(F.col(k), F.col("users" if k == "error" else "view")) for k in ("signup", "click", "purchase", "error")}
    return counted.select(day, F.col("view").alias("sessions"), "users", *(v.alias(k) for k, v in rates.items()))


def top_by(events: DataFrame, what: str, most: int) -> DataFrame:
    return events.groupBy(what).agg(F.count("*").alias("n")).orderBy(F.desc("n"), what).limit(most)


def order_months(orders: DataFrame) -> DataFrame:
    """Per month and status: orders and revenue."""
    month = F.date_trunc("month", "o_orderdate").cast("date")
    return orders.groupBy(month.alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("double").alias("revenue"))


def free_tier(reports: DataFrame, shown: int = 3) -> DataFrame:
    """The first failures and recommendations, and how many stay locked."""
    out = reports
    for c in ("failures", "recommendations"):
        out = out.withColumn(f"locked_{c}", F.greatest(F.size(c) - shown, F.lit(0))).withColumn(c, F.slice(c, 1, shown))
    return out


def top_findings(failures: Column, recommendations: Column, n: int = 3) -> Column:
    return F.slice(F.concat(failures, recommendations, F.array_repeat(F.lit(FILLER), n)), 1, n)


def capped_list(items: Column, most: int = 12) -> Column:
    """The first items and, if there are more, a note of how many."""
    more = F.size(items) - most
    return F.when(more > 0, F.concat(F.slice(items, 1, most), F.array(F.concat(F.lit("…and "), more.cast("string"), F.lit(" more"))))).otherwise(items)


def savings(images: DataFrame) -> DataFrame:
    """Bytes before and after, and the percentage saved."""
    told = images.agg(F.sum("bytes_before").alias("bytes_before"), F.sum("bytes_after").alias("bytes_after"))
    return told.withColumn("saved_percent", F.coalesce(F.round(F.try_divide(100.0 * (F.col("bytes_before") - F.col("bytes_after")), F.col("bytes_before")), 2), F.lit(0.0)))


def rewrite(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, target, status): the first rule (ord, pattern, target, status) that fits; * is any rest, which :splat brings to
    the target; paths without a rule keep 200. A path meets only rules whose beginning before the first * it has, through a join on that
    beginning; rules and paths may both be many. A path that repeats gives its row as often; a null path fits no rule."""
    regex = F.concat(F.lit("^"), F.replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^$\\])", r"\\$1"), F.lit("*"), F.lit("(.*)")), F.lit("$"))
    ready = rules.where("pattern is not null").select("ord", "target", "status", regex.alias("regex"), F.substring_index("pattern", "*", 1).alias("begins"))
    longest = ready.agg(F.coalesce(F.max(F.length("begins")), F.lit(0)).alias("longest"))  # one row
    paths = requests.select("path").where("path is not null").distinct().crossJoin(F.broadcast(longest))
    begun = paths.withColumn("n", F.explode(F.sequence(F.lit(0), F.least("longest", F.length("path"))))).select("path", F.left("path", "n").alias("begins"))
    met = begun.join(ready, "begins").where(F.expr("path rlike regex"))
    first = met.groupBy("path").agg(F.min_by(F.struct("regex", "target", "status"), "ord").alias("r"))
    told = requests.select("path").join(first, "path", "left")
    splat = F.when(F.contains("r.regex", F.lit("(.*)")), F.expr("regexp_extract(path, r.regex, 1)")).otherwise("")
    return told.select("path", F.coalesce(F.replace("r.target", F.lit(":splat"), splat), "path").alias("target"), F.coalesce("r.status", F.lit(200)).alias("status"))
