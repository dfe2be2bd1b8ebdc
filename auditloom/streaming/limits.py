"""Per-key rate limits and idempotent consumption, in batch and as streams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls, validation
from auditloom.streaming import windows

# Requests in a window of 60 seconds
LIMITS = {"scan": 10, "report": 5, "start": 20}
WINDOW_MS = 60_000


def client_key(proxy: Column, real: Column, socket: Column) -> Column:
    """The address that a limit counts for: of the two headers the first that is an address, else the socket's."""

    def address(v: Column) -> Column:
        t = F.trim(v)
        parts = F.split(t, r"\.")
        v4 = t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
        return F.when(v4 | t.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), t)

    return F.coalesce(address(proxy), address(real), socket, F.lit("unknown"))


def rate_limit(events: DataFrame, most: int, key: str, when: str, ident: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """(key, ident, count, allowed). A key's window opens with its first request and ends window_ms later; the first request
    strictly after that opens the next. All requests of a window count; those beyond most are refused.

    Keys of any size: see windows.anchored_counts, which says what nulls, repeated rows and missing times give."""
    told = windows.anchored_counts(events, key, when, ident, window_ms)
    return told.select("key", "ident", "count", (F.col("count") <= most).alias("allowed"))


def once(events: DataFrame, ident: str, when: str, late: str = "1 hour") -> DataFrame:
    """Events of a stream without those whose identity has come before."""
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark([ident])


def reminders(orders: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Orders that have waited for their site's address for over `minutes` and weren't reminded."""
    late = now - F.expr(f"INTERVAL {minutes} MINUTES") > F.col("created_at")
    return orders.where((F.col("status") == "needs_url") & late & ~F.col("reminded"))


def fresh(signed_ms: Column, now_ms: Column, tolerance_s: int = 300) -> Column:
    return F.abs(now_ms - signed_ms) <= tolerance_s * 1000


def checkout_orders(sessions: DataFrame, body: str = "body") -> DataFrame:
    """Orders from checkout events in JSON: the address from the first text field whose key speaks of an url, website or
    site. One row per session id, the first."""
    schema = "id string, payment_status string, client_reference_id string, customer_email string, customer_details struct<email:string,name:string>, custom_fields array<struct<key:string,type:string,text:struct<value:string>>>"
    s = F.from_json(F.col(body), schema)
    parsed = sessions.select(s.alias("s"))
    field = F.get(F.filter("s.custom_fields", lambda f: (f["type"] == "text") & f["key"].rlike("(?i)url|website|site")), 0)
    return parsed.where(validation.session_id(F.col("s.id"))).select(
        F.col("s.id").alias("session_id"),
        F.coalesce("s.customer_details.email", "s.customer_email").alias("email"),
        F.col("s.customer_details.name").alias("name"),
        urls.normalize_site_url(field["text"]["value"]).alias("site_url"),
        F.col("s.client_reference_id").alias("lead_id"),
        F.coalesce(F.col("s.payment_status").isin(*validation.PAID), F.lit(False)).alias("paid"),
    )
