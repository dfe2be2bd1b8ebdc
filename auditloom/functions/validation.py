"""Predicates and cleaners of single values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.html import collapse

# Fixed values
AUDIENCES = ("all-ages", "young-adult", "new-adult", "adult")
AUDIENCE_ALIASES = {"mg": "all-ages", "middle-grade": "all-ages", "children": "all-ages", "kids": "all-ages", "ya": "young-adult", "teen": "young-adult", "na": "new-adult", "all-ages": "all-ages", "young-adult": "young-adult", "new-adult": "new-adult", "adult": "adult"}
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "instance-data")
BLOCKED_ENDS = (".localhost", ".local", ".internal")
BLOCK_WORDS = r"(?i)\b((un)?block(s|ed|ing)?|ignor(e|es|ed|ing)|shut(s|ting)? out|lock(s|ed|ing)? out)\b"
CRAWLER_WORDS = r"(?i)\b(crawl\w*|bots?|AI|discover\w*)\b"
SESSION_ID = "^cs_(live|test)_[A-Za-z0-9]{10,200}$"
PAID = ("paid", "no_payment_required")


def email_plain(v: Column) -> Column:
    """No white space, at most 254 characters, one @ that isn't first, and a dot in the domain that isn't first and has
    at least two characters after it."""
    domain = F.substring_index(v, "@", -1)
    end = F.substring_index(domain, ".", -1)
    ok = ~v.rlike(r"\s") & (F.length(v) <= 254) & (F.regexp_count(v, F.lit("@")) == 1) & ~v.startswith("@") & F.contains(domain, F.lit(".")) & (F.length(domain) - F.length(end) > 1) & (F.length(end) >= 2)
    return F.coalesce(ok, F.lit(False))


def email_normalized(v: Column) -> Column:
    """Trimmed and in small letters if it looks like an address of at most 254 characters, else null."""
    t = F.lower(F.trim(v))
    return F.when(t.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(t) <= 254), t)


def email_field(v: Column) -> Column:
    """A form field's check: empty is fine; else no space, an @ that isn't first, and a dot after it that is neither
    next to it nor last."""
    at = F.instr(v, "@")
    dot = F.length(v) - F.length(F.substring_index(v, ".", -1))
    ok = ~F.contains(v, F.lit(" ")) & (at > 1) & (dot > at + 1) & (dot < F.length(v))
    return F.coalesce((v == "") | ok, F.lit(False))


def private_ipv4(ip: Column) -> Column:
    """Malformed addresses count as private."""
    n = F.transform(F.split(ip, r"\."), lambda x: F.when(x.rlike("^[0-9]{1,3}$"), x.try_cast("int")))
    a, b, c = (F.get(n, i) for i in range(3))
    bad = (F.size(n) != 4) | F.exists(n, lambda x: x.isNull() | (x > 255))
    ranges = (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 224)
    )
    return F.coalesce(bad | ranges, F.lit(True))


def private_ip(ip: Column) -> Column:
    v6 = F.lower(F.trim(ip))
    special = v6.isin("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0") | v6.rlike("^(f[cd]|fe[89ab]|ff|2001:0?db8)")
    mapped = private_ipv4(F.substring(v6, 8, 100))
    return F.when(F.contains(ip, F.lit(":")), F.when(v6.startswith("::ffff:"), mapped).otherwise(special)).otherwise(private_ipv4(ip))


def any_private(addresses: Column) -> Column:
    return F.exists(addresses, private_ip)


def blocked_host(host: Column, scheme: Column) -> Column:
    h = F.lower(host)
    inside = h.isin(*BLOCKED_HOSTS)
    for end in BLOCKED_ENDS:
        inside = inside | h.endswith(end)
    return inside | ~scheme.isin("http", "https")


def postal_address(v: Column) -> Column:
    return F.coalesce((F.length(F.trim(v)) >= 12) & v.rlike(r"\d") & F.contains(v, F.lit(",")), F.lit(False))


def session_id(v: Column) -> Column:
    return F.coalesce(v.rlike(SESSION_ID), F.lit(False))


def clean_tags(tags: Column, most: int, kebab: bool = False, longest: int = 40) -> Column:
    def clean(t: Column) -> Column:
        t = F.replace(F.regexp_replace(F.lower(collapse(t)), "[^a-z0-9 _&'-]", ""), F.lit("_"), F.lit(" "))
        if kebab:
            t = F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-+", "-")
        return F.regexp_replace(t, r"^[-\s]+|[-\s]+$", "")

    made = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), clean), lambda t: (t != "") & (F.length(t) <= longest))
    return F.slice(F.array_distinct(made), 1, most)


def clean_audience(values: Column) -> Column:
    aliases = F.create_map(*(F.lit(x) for kv in AUDIENCE_ALIASES.items() for x in kv))
    mapped = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.element_at(aliases, F.regexp_replace(F.lower(collapse(v)), r"[\s_]+", "-")))
    return F.filter(F.array(*(F.lit(a) for a in AUDIENCES)), lambda a: F.array_contains(mapped, a))


def clean_spice(v: Column) -> Column:
    """0 to 5, a whole number or its text; else null."""
    n = F.trim(v).try_cast("double")
    return F.when((n == F.floor(n)) & n.between(0, 5), n.cast("int"))


def clean_bio(v: Column, words: int = 50, chars: int = 400) -> Column:
    """The first words of a text, cut to a length; null if it has none."""
    said = F.slice(F.filter(F.split(collapse(v), " "), lambda w: w != ""), 1, words)
    return F.when(F.size(said) > 0, F.substring(F.array_join(said, " "), 1, chars))


def html_escape(v: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        v = F.replace(v, F.lit(char), F.lit(entity))
    return v


def log_safe(v: Column) -> Column:
    return F.substring(F.regexp_replace(v, r"[\x00-\x1f\x7f]", " "), 1, 200)


def llms_problems(text: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~text.rlike(r"(?m)^#\s+\S"), "a line with a top heading is missing"),
            F.when(~text.rlike(r"(?m)^>\s+\S"), "a quoted summary is missing"),
            F.when(~text.rlike(r"\[[^\]]+\]\(https?://[^)]+\)"), "a link to a page is missing"),
        )
    )


def claims_blocking(text: Column) -> Column:
    """Whether one sentence speaks both of blocking and of crawlers."""
    return F.exists(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: s.rlike(BLOCK_WORDS) & s.rlike(CRAWLER_WORDS))


def guarded(narrative: Column, fallback: Column, any_blocked: Column) -> Column:
    return F.when(claims_blocking(narrative) & ~any_blocked, fallback).otherwise(narrative)


def comma_list(v: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def outer_json(v: Column) -> Column:
    """What lies from the first { to the last }, if it parses, else null."""
    found = F.regexp_extract(v, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def markdown_link(label: Column, url: Column, about: Column) -> Column:
    bare = F.regexp_replace(label, r"[\[\]]", "")
    return F.concat(F.lit("- ["), bare, F.lit("]("), url, F.lit(")"), F.when(F.coalesce(about, F.lit("")) != "", F.concat(F.lit(": "), about)).otherwise(""))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """[KEY] becomes the value of KEY."""
    for key, value in values.items():
        template = F.replace(template, F.lit(f"[{key}]"), value)
    return template


def faq_mismatch(entries: Column, page_text: Column) -> Column:
    """Questions (entries: array<struct<question, answer>>) that the page doesn't show, or the first 60 characters of
    whose answer it doesn't; white space, case and curly quotes don't count."""

    def plain(t: Column) -> Column:
        return F.lower(collapse(F.translate(t, "‘’“”", "''\"\"")))

    shown = plain(page_text)
    missing = F.filter(entries, lambda e: ~F.contains(shown, plain(e["question"])) | ~F.contains(shown, F.substring(plain(e["answer"]), 1, 60)))
    return F.transform(missing, lambda e: e["question"])


def content_hash(v: Column, digits: int = 10) -> Column:
    return F.substring(F.sha2(v, 256), 1, digits)
