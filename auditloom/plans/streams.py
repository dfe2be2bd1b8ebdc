"""Queries on busy keys, change logs and crawls of graphs that the tables hold."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.checkpoints import shared_folder
from auditloom.operators import graph
from auditloom.streaming import change_log, windows


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate_limit_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's number in its type's window of an hour: five keys hold all rows."""
    told = windows.anchored_counts(_read(spark, sf_dir, "events"), "event_type", "ts", "event_id", 3_600_000)
    return told.select(F.col("key").alias("event_type"), F.col("ident").alias("event_id"), F.col("count").alias("n"))


_LEADS = "id bigint, ord bigint, is_insert boolean, email string, report string, error string"


def lead_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads, then two batches of orders that update their leads' reports; the first is replayed, and a snapshot is made
    between. An order that is done leaves no error, another its status."""
    leads = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("bigint").alias("ord"), F.lit(True).alias("is_insert"), F.col("c_name").alias("email"), F.lit(None).cast("string").alias("report"), F.lit("new").alias("error"))
    orders = _read(spark, sf_dir, "orders")
    report = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    updates = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.lit(False).alias("is_insert"), F.lit(None).cast("string").alias("email"), report.alias("report"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("error"))
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("date")
    log = change_log.ChangeLog(spark, f"{shared_folder(spark)}/leads-{uuid.uuid4().hex}", spark.createDataFrame([], _LEADS).schema, "id", "ord", ["email", "report"], ["error"])
    batches = leads, updates.where(early), updates.where(~early)
    for number in (0, 1, 1):
        log.append(batches[number], number)
    log.compact()
    log.append(batches[1], 1)
    log.append(batches[2], 2)
    return log.rows()


def form_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as form events; those of errors don't say which form."""
    body = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("form_name")))
    return change_log.form_jobs(_read(spark, sf_dir, "events").select(body.alias("body"))).select("id", "status", "kit_type")


def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sites, users as pages: an event links its user to another, purchases of a large value name sitemap seeds."""
    events = _read(spark, sf_dir, "events")
    links = events.select(F.col("event_type").alias("site"), F.col("user_id").alias("src"), F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 1500).alias("dst"))
    homes = events.groupBy(F.col("event_type").alias("site")).agg(F.min("user_id").alias("url"))
    seeds = events.where("event_id % 100 = 1").select(F.col("event_type").alias("site"), F.col("user_id").alias("url"), F.col("event_id").alias("pos"))
    return graph.crawl(links, homes, seeds, most=30, found_most=3000)


SQL = {
    "rate_limit_busy": """WITH RECURSIVE starts AS (SELECT event_type, min(epoch_ms(ts)) AS s FROM events GROUP BY event_type
 UNION ALL SELECT event_type, nxt FROM (SELECT event_type, (SELECT min(epoch_ms(ts)) FROM events e WHERE e.event_type = starts.event_type AND epoch_ms(e.ts) > starts.s + 3600000) AS nxt FROM starts) WHERE nxt IS NOT NULL),
placed AS (SELECT e.event_type, e.event_id, epoch_ms(e.ts) AS ms, s FROM events e ASOF JOIN starts ON e.event_type = starts.event_type AND epoch_ms(e.ts) >= s)
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, s ORDER BY ms, event_id) AS n FROM placed""",
    "lead_reports": """WITH changes AS (SELECT o_custkey AS id, (o_orderdate >= DATE '1995-01-01')::INT AS batch, o_orderkey AS ord, CASE WHEN o_orderstatus <> 'P' THEN 'order ' || o_orderkey END AS report, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS error FROM orders),
last AS (SELECT id, arg_max(report, (batch, ord)) FILTER (report IS NOT NULL) AS report, max_by({'e': error}, (batch, ord)).e AS error FROM changes GROUP BY id)
SELECT c_custkey AS id, c_name AS email, report, CASE WHEN last.id IS NULL THEN 'new' ELSE error END AS error FROM customer LEFT JOIN last ON id = c_custkey""",
    "form_jobs": "SELECT 'e' || event_id AS id, 'received' AS status, CASE WHEN event_type <> 'error' THEN event_type ELSE 'amazon-visibility-kit' END AS kit_type FROM events",
    # a page at a time: found pages as a list, visited ones as places in it
    "site_crawl": """WITH RECURSIVE outs AS (SELECT event_type AS site, user_id AS src, list(event_id * 7 % 1500 ORDER BY event_id) AS dsts FROM events GROUP BY ALL),
home AS (SELECT event_type AS site, min(user_id) AS url FROM events GROUP BY event_type),
seeds AS (SELECT site, list(u ORDER BY pos, u) AS urls FROM (SELECT event_type AS site, user_id AS u, min(event_id) AS pos FROM events WHERE event_id % 100 = 1 GROUP BY ALL) JOIN home h USING (site) WHERE h.url <> u GROUP BY site),
walk(site, found, depths, visited, step) AS (
  SELECT home.site, [home.url] || coalesce(urls, []), [0] || list_transform(coalesce(urls, []), lambda u: NULL::INT), []::BIGINT[], 0 FROM home LEFT JOIN seeds USING (site)
  UNION ALL SELECT site, found || fresh, depths || list_transform(fresh, lambda u: CASE WHEN d < 1000000 THEN d + 1 END::INT), visited || [i], step + 1 FROM (
    SELECT w.site, found, depths, visited, step, i, coalesce(depths[i], 1000000) AS d, list_slice(list_filter(list_distinct_in_order, lambda u: NOT list_contains(found, u)), 1, 3000 - len(found)) AS fresh FROM (
      SELECT w.*, list_filter(coalesce(dsts, []), lambda x, k: list_position(dsts, x) = k) AS list_distinct_in_order FROM (
        SELECT *, list_min(list_transform(list_filter(range(1, len(found) + 1), lambda j: NOT list_contains(visited, j)), lambda j: coalesce(depths[j], 1000000)::BIGINT * 1000000 + j)) % 1000000 AS i FROM walk WHERE step < 30 AND len(visited) < len(found)) w
      LEFT JOIN outs ON outs.site = w.site AND outs.src = w.found[w.i]) w)),
done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY site ORDER BY step DESC) = 1),
pages AS (SELECT site, unnest(list_transform(visited, lambda i: found[i])) AS url, unnest(range(1, len(visited) + 1)) AS place, unnest(list_transform(visited, lambda i: depths[i])) AS depth, len(found) - len(visited) AS uncrawled FROM done),
into_unknown AS (SELECT DISTINCT c.site, c.place, p.place AS above, p.depth AS d FROM pages c JOIN (SELECT site, src, unnest(dsts) AS dst FROM outs) l ON l.site = c.site AND l.dst = c.url JOIN pages p ON p.site = c.site AND p.url = l.src WHERE c.depth IS NULL),
settling(site, place, d, step) AS (SELECT site, place, min(d) + 1, 1 FROM into_unknown WHERE d IS NOT NULL GROUP BY ALL
  UNION SELECT u.site, u.place, s.d + 1, step + 1 FROM settling s JOIN into_unknown u ON u.site = s.site AND u.above = s.place AND u.d IS NULL AND u.above < u.place)
SELECT p.site, url, p.place::INT AS place, coalesce(depth, m.d)::INT AS depth, uncrawled::BIGINT AS uncrawled FROM pages p LEFT JOIN (SELECT site, place, min(d) AS d FROM settling GROUP BY ALL) m USING (site, place)""",
}

QUERIES = {f.__name__: f for f in (rate_limit_busy, lead_reports, form_jobs, site_crawl)}
