"""Queries on events, orders, customers and lists: reports, stores, limits, outreach."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import scoring
from auditloom.operators import reports, store
from auditloom.plans.literals import frame, table
from auditloom.sources import lists
from auditloom.streaming import limits

URL_LINES = [(1, "url,name"), (2, "https://A.com/x,foo"), (3, ""), (4, "# note"), (5, '"https://b.com"'), (6, "HTTPS://a.com/X"), (7, "https://c.com"), (8, "url"), (9, "'https://d.com',1")]
PROSPECT_LINES = [(1, "url,name,email,mode"), (2, "https://a.com,Ann,Ann@A.com,author"), (3, "https://b.com,,b@b.co,"), (4, "https://c.com,Cy,not an address"), (5, "https://d.com,Di,d@d.org"), (6, ",x,y@z.co"), (7, '"https://e.com",Ed,e@e.net,smb')]
SUPPRESSED = [("ann@a.com",), ("x@x.com",)]
SCORES = [("https://a.com", 40), ("https://b.com", 69), ("https://d.com", 70), ("https://c.com", 10)]
CELLS = [(1, 'plain'), (2, 'a,b'), (3, 'say "x"'), (4, None), (5, "two\nlines"), (6, "")]
DIAGNOSTICS = [("d1", "t1", "s1"), ("d2", "t2", None)]
NEW_DIAGNOSTICS = [(1, "d3", "t3", "s3"), (2, "d1", "t4", "s4"), (3, "d5", "t2", "s5"), (4, "d6", "t6", "s3"), (5, "d7", "t7", None), (6, "d8", "t8", None), (7, "d3", "t9", "s9")]
CHANGES = [("a", 1, "r1", None, "u", "e1"), ("a", 2, None, "h2", None, None), ("a", 3, "r3", None, None, None), ("b", 1, None, None, None, "x"), ("b", 2, None, None, "v", "y")]
WAITING = [("d1", "needs_url"), ("d2", "ready"), ("d3", "needs_url")]
ASKS = [("d1", 2, "https://two.com"), ("d1", 1, "https://one.com"), ("d2", 1, "https://x.com"), ("d3", 5, "https://three.com"), ("d9", 1, "https://nine.com")]
ORDERS = [("o1", "l1", None, None), ("o2", "l1", "own@o.com", None), ("o3", "l9", None, "https://o.com"), ("o4", None, None, None)]
LEADS = [("l1", "lead@l.com", "https://lead.com"), ("l2", "two@l.com", None)]
JOBS = [("j1", "failed", "boom", "{}"), ("j2", "drafted", None, "{}")]
PATHS = [("/old/a/b",), ("/x",), ("/home",), ("/keep.html",)]
REWRITES = [(1, "/old/*", "/new/:splat", 301), (2, "/home", "/", 302), (3, "/old/a/*", "/never", 301)]
AD_BAND = [(1, "4.99", "70", "0.45", "12"), (2, "1", "100", "0.1", "10"), (3, "5", "100", "0", "1"), (4, "1.40", "50", "0.1", "2"), (5, "x", "70", "1", "1"), (6, "1.25", "100", "0.25", "2")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five events of a user in a window of a day."""
    told = limits.rate_limit(_read(spark, sf_dir, "events"), limits.LIMITS["report"], "user_id", "ts", "event_id", 86_400_000)
    return told.select(F.col("key").alias("user_id"), F.col("ident").alias("event_id"), F.col("count").alias("n"), "allowed")


def event_conversion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversions(_read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")))


def period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reports.in_period(_read(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"), "weekly")
    return told.groupBy("event_type").agg(F.count("*").alias("n"))


def recent_orders_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.recent(_read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 50)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status_counts(_read(spark, sf_dir, "orders"), "o_orderstatus")


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.order_months(_read(spark, sf_dir, "orders")).select(F.date_format("month", "yyyy-MM").alias("month"), "o_orderstatus", "n", "revenue")


def lead_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order: an anti-join of two large tables."""
    return _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def ad_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an advertised book: its price a piece, 70 % royalty, 45 cents a click, a click for a piece."""
    rows = _read(spark, sf_dir, "lineitem")
    found = scoring.ad_profit(F.col("l_extendedprice") / F.col("l_quantity") / 400, F.lit(70.0), F.lit(0.45), F.col("l_quantity") / 10)
    return rows.select(found["band"].alias("band"), found["score"].alias("score")).groupBy("band").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


def ad_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, "id int, price string, royalty string, cpc string, clicks string", AD_BAND)
    found = scoring.ad_profit(*(F.col(c) for c in ("price", "royalty", "cpc", "clicks")))
    return rows.select("id", scoring.money(found["profit"]).alias("profit"), found["score"].alias("score"), found["band"].alias("band"))


def url_dedupe_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.url_list(frame(spark, "ord bigint, line string", URL_LINES))


def _prospects(spark: SparkSession) -> DataFrame:
    return lists.prospects(frame(spark, "ord bigint, line string", PROSPECT_LINES))


def prospect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prospects(spark)


def prospect_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.mailable(_prospects(spark), frame(spark, "email string", SUPPRESSED)).select("url", "norm_email")


def prospect_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.outreach(_prospects(spark), frame(spark, "email string", SUPPRESSED), frame(spark, "url string, score int", SCORES)).select("url", "outcome")


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "id int, v string", CELLS).select("id", lists.csv_cell(F.col("v")).alias("cell"))


def upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = frame(spark, "id string, token string, session string", DIAGNOSTICS)
    new = frame(spark, "ord int, id string, token string, session string", NEW_DIAGNOSTICS)
    return store.insert_or_ignore(old, new, ["id", "token", "session"], "ord").select("id", "token", "session")


def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame(spark, "id string, ord int, result string, html string, site_url string, error string", CHANGES)
    return store.fold_changes(log, "id", "ord", ["result", "html", "site_url"], ["error"])


def claim_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claims(frame(spark, "id string, status string", WAITING), frame(spark, "id string, ord int, url string", ASKS), "id", "ord").select("id", "url")


def lead_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.enrich(frame(spark, "id string, lead_id string, email string, site_url string", ORDERS), frame(spark, "id string, email string, scanned_url string", LEADS)).select("id", "email", "site_url")


def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stages(frame(spark, "id string, status string, error string, draft string", JOBS))


def rewrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rewrite(frame(spark, "path string", PATHS), frame(spark, "ord int, pattern string, target string, status int", REWRITES))


_LINES = "trim(regexp_replace(trim({}), '^[\"'']|[\"'']$', '', 'g'))"
_PROSPECTS = f"""WITH {table("lines", "ord, line", PROSPECT_LINES)},
cells AS (SELECT ord, list_transform(string_split(line, ','), lambda c: {_LINES.format("c")}) AS c FROM lines),
prospects AS (SELECT ord, c[1] AS url, coalesce(nullif(c[2], ''), 'Founder') AS name, coalesce(c[3], '') AS email, coalesce(nullif(c[4], ''), 'smb') AS mode FROM cells WHERE c[1] <> '' AND NOT (ord = 1 AND lower(c[1]) = 'url')),
normal AS (SELECT *, CASE WHEN regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AND length(trim(email)) <= 254 THEN lower(trim(email)) END AS norm_email FROM prospects), {table("stopped", "email", SUPPRESSED)}, {table("scores", "url, score", SCORES)}"""
_AD = """round(CASE WHEN profit < 0 THEN 100 WHEN profit = 0 THEN 90 ELSE 100 - least(profit / 5, 1) * 100 END)::INT AS score,
 CASE WHEN (CASE WHEN profit < 0 THEN 100 WHEN profit = 0 THEN 90 ELSE 100 - least(profit / 5, 1) * 100 END) > 90 THEN 'CRITICAL' WHEN (CASE WHEN profit < 0 THEN 100 WHEN profit = 0 THEN 90 ELSE 100 - least(profit / 5, 1) * 100 END) > 60 THEN 'WARNING' ELSE 'HEALTHY' END AS band"""

SQL = {
    "rate_limit": """WITH RECURSIVE ordered AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT user_id, event_id, k, ms + 86400000 AS ends, 1::BIGINT AS n FROM ordered WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.ms > w.ends THEN o.ms + 86400000 ELSE w.ends END, CASE WHEN o.ms > w.ends THEN 1 ELSE w.n + 1 END FROM walk w JOIN ordered o ON o.user_id IS NOT DISTINCT FROM w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, n, n <= 5 AS allowed FROM walk""",
    "event_conversion_rates": """SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS sessions, count(DISTINCT user_id) AS users,
 coalesce(round(100.0::DOUBLE * count(*) FILTER (event_type = 'signup') / nullif(count(*) FILTER (event_type = 'view'), 0), 2), 0) AS signup_rate,
 coalesce(round(100.0::DOUBLE * count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 2), 0) AS click_rate,
 coalesce(round(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 2), 0) AS purchase_rate,
 coalesce(round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / nullif(count(DISTINCT user_id), 0), 2), 0) AS error_rate FROM events GROUP BY 1""",
    "period_filter": "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-13 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type",
    "recent_orders_topk": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "order_months": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(20,2))::DOUBLE AS revenue FROM orders GROUP BY 1, 2",
    "lead_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
    "ad_calculator": f"WITH p AS (SELECT l_extendedprice / l_quantity / 400 * (70.0::DOUBLE / 100) - 0.45::DOUBLE * (l_quantity / 10) AS profit FROM lineitem), s AS (SELECT {_AD} FROM p) SELECT band, count(*) AS n, sum(score)::BIGINT AS total FROM s GROUP BY band",
    "ad_bands": f"""WITH {table("t", "id, price, royalty, cpc, clicks", AD_BAND)}, p AS (SELECT id, coalesce(try_cast(price AS DOUBLE), 0) * (coalesce(try_cast(royalty AS DOUBLE), 0) / 100) - coalesce(try_cast(cpc AS DOUBLE), 0) * coalesce(try_cast(clicks AS DOUBLE), 0) AS profit FROM t)
SELECT id, CASE WHEN profit < 0 THEN '-' ELSE '' END || '$' || printf('%.2f', abs(profit)) AS profit, {_AD.replace("profit <", "p.profit <").replace("profit =", "p.profit =").replace("profit /", "p.profit /")} FROM p""",
    "url_dedupe_ci": f"WITH {table('lines', 'ord, line', URL_LINES)}, u AS (SELECT ord, {_LINES.format('split_part(line, chr(44), 1)')} AS url FROM lines) SELECT min(ord)::BIGINT AS ord, min_by(url, ord) AS url FROM u WHERE url <> '' AND url NOT LIKE '#%' AND lower(url) <> 'url' GROUP BY lower(url)",
    "prospect_rows": _PROSPECTS + " SELECT ord::BIGINT AS ord, url, name, email, mode FROM prospects",
    "prospect_antijoin": _PROSPECTS + " SELECT url, norm_email FROM normal WHERE norm_email IS NOT NULL AND norm_email NOT IN (SELECT email FROM stopped)",
    "prospect_qualify": _PROSPECTS + " SELECT n.url, CASE WHEN norm_email IS NULL THEN 'SKIP_INVALID_EMAIL' WHEN norm_email IN (SELECT email FROM stopped) THEN 'SKIP_UNSUBSCRIBED' WHEN score IS NULL THEN 'ERROR' WHEN score < 70 THEN 'YES' ELSE 'NO_SCORE_TOO_HIGH' END AS outcome FROM normal n LEFT JOIN scores USING (url)",
    "csv_cells": f"WITH {table('t', 'id, v', CELLS)} SELECT id, CASE WHEN regexp_matches(coalesce(v, ''), '[\",\\n]') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE coalesce(v, '') END AS cell FROM t",
    "upsert_ignore": f"""WITH {table("old", "id, token, session", DIAGNOSTICS)}, {table("fresh", "ord, id, token, session", NEW_DIAGNOSTICS)},
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM fresh WHERE id NOT IN (SELECT id FROM old)),
b AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ord) AS m FROM a WHERE k = 1 AND token NOT IN (SELECT token FROM old)),
c AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS j FROM b WHERE m = 1 AND (session IS NULL OR session NOT IN (SELECT session FROM old WHERE session IS NOT NULL)))
SELECT id, token, session FROM c WHERE j = 1 OR session IS NULL""",
    "coalesce_update": f"WITH {table('t', 'id, ord, result, html, site_url, error', CHANGES)} SELECT id, max_by(result, ord) FILTER (result IS NOT NULL) AS result, max_by(html, ord) FILTER (html IS NOT NULL) AS html, max_by(site_url, ord) FILTER (site_url IS NOT NULL) AS site_url, (list(error ORDER BY ord DESC))[1] AS error FROM t GROUP BY id",
    "claim_once": f"WITH {table('w', 'id, status', WAITING)}, {table('a', 'id, ord, url', ASKS)} SELECT a.id, min_by(a.url, a.ord) AS url FROM a JOIN w USING (id) WHERE status = 'needs_url' GROUP BY a.id",
    "lead_enrich": f"WITH {table('o', 'id, lead_id, email, site_url', ORDERS)}, {table('l', 'id, email, scanned_url', LEADS)} SELECT o.id, coalesce(o.email, l.email) AS email, coalesce(o.site_url, l.scanned_url) AS site_url FROM o LEFT JOIN l ON l.id = o.lead_id",
    "job_retry": f"WITH {table('j', 'id, status, error, draft', JOBS)} SELECT id, CASE status WHEN 'failed' THEN 'received' ELSE status END AS status, CASE WHEN status <> 'failed' THEN error END AS error, CASE WHEN status <> 'failed' THEN draft END AS draft FROM j",
    "rewrite_rules": f"WITH {table('p', 'path', PATHS)}, {table('r', 'ord, pattern, target, status', REWRITES)}, m AS (SELECT path, ord, replace(target, ':splat', CASE WHEN pattern LIKE '%*' THEN substr(path, length(pattern)) ELSE '' END) AS target, status FROM p JOIN r ON (pattern LIKE '%*' AND starts_with(path, left(pattern, length(pattern) - 1))) OR pattern = path) SELECT path, coalesce(min_by(m.target, ord), path) AS target, coalesce(min_by(m.status, ord), 200) AS status FROM p LEFT JOIN m USING (path) GROUP BY path",
}

QUERIES = {
    f.__name__: f
    for f in (
        rate_limit, event_conversion_rates, period_filter, recent_orders_topk, status_counts, order_months, lead_orders, ad_calculator, ad_bands, url_dedupe_ci, prospect_rows, prospect_antijoin,
        prospect_qualify, csv_cells, upsert_ignore, coalesce_update, claim_once, lead_enrich, job_retry, rewrite_rules,
    )
}
