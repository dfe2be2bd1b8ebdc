"""URL expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: endings of files that aren't pages
NOT_PAGES = r"(?i)\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|txt|zip|gz|mp3|mp4|m4a|wav|mov|webm|epub|mobi|docx?|xlsx?|pptx?|woff2?|ttf|eot)$"
NO_LINK = r"(?i)^\s*(mailto|tel|javascript|data):"
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    """The host's name: without user info and port, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 2), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    got = F.regexp_extract(url, PARTS, 3)
    return F.when(got == "", "/").otherwise(got)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def strip_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL from a reference: absolute, //host, /path, ?query or a path beside the base's. Dot segments
    are left as they are; a reference with another scheme stays itself."""
    origin = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, PARTS, 2))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    h = F.trim(href)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .when(h.startswith("#") | (h == ""), base)
        .otherwise(F.concat(origin, folder, h))
    )


def normalize_link(href: Column, base: Column, site_host: Column) -> Column:
    """The page of the same site that a link leads to, or null: no mail, script or data links, only http(s), the
    same host but for www., no files; without query and fragment, and without one closing slash but at the root."""
    full = resolve(href, base)
    p = path(full)
    page = F.concat(scheme(full), F.lit("://"), F.lower(F.regexp_extract(full, PARTS, 2)), F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", "")))
    good = (F.trim(href) != "") & ~href.rlike(NO_LINK) & scheme(full).isin("http", "https") & (strip_www(host(full)) == site_host) & ~p.rlike(NOT_PAGES)
    return F.when(good, page)


def canonical_correct(href: Column, page: Column) -> Column:
    """Whether a canonical link names its own page: http(s), the same host but for www., and the same path but for
    index.html and closing slashes."""

    def bare(p: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(p, r"(?i)/index\.html$", "/"), "/+$", "")
        return F.when(cut == "", "/").otherwise(cut)

    full = resolve(href, page)
    same = scheme(full).isin("http", "https") & (strip_www(host(full)) == strip_www(host(page))) & (bare(path(full)) == bare(path(page)))
    return F.when((href.isNull()) | (href == "") | page.isNull() | (page == ""), False).otherwise(F.coalesce(same, F.lit(False)))


def normalize_site_url(value: Column) -> Column:
    """Trimmed, https:// where the scheme is missing; null unless the host has a dot."""
    v = F.trim(value)
    full = F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v))
    good = (v != "") & ~v.rlike(r"\s") & F.contains(host(full), F.lit("."))
    return F.when(good, F.concat(scheme(full), F.lit("://"), F.lower(F.regexp_extract(full, PARTS, 2)), path(full), query(full)))


def with_scheme(value: Column, only_http: bool) -> Column:
    """https:// in front of what has no scheme; with only_http also in front of other schemes than http(s)."""
    has = value.rlike("(?i)^https?://") if only_http else F.contains(value, F.lit("://"))
    return F.when(has, value).otherwise(F.concat(F.lit("https://"), value))


def is_host_or_below(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith("." + domain)


def page_kind(p: Column) -> Column:
    """books, about, services or other, by the path."""
    return (
        F.when(p.rlike("(?i)/(books?|novels?|series|titles?)"), "books").when(p.rlike("(?i)/(about|bio|author|meet)"), "about").when(p.rlike("(?i)/(services?|offerings?|practice)"), "services").otherwise("other")
    )
