"""Facts of a raw HTML string as column expressions, so that they run inside code generation.

Patterns avoid lookaround and back-references, which lets the DuckDB twins of the queries share them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT = r"(?is)<!--.*?-->"
RAW_ELEMENTS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>"
TAG = r"(?s)<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([^\"'\s>]+)"
HREF = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"
LD_JSON = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*>"
HREF_VALUE = r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']"
CONTENT_VALUE = r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']"
#: What a browser's script engine counts as white space.
SPACES = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
#: Entities that are decoded in text; others stay as they are.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
SEMANTIC_TAGS = ("main", "article", "section", "nav", "header", "footer", "aside")


def meta_tag(attribute: str, name: str) -> str:
    """The pattern of a meta tag whose attribute has the given name."""
    return rf"(?is)<meta\b[^>]*\b{attribute}\s*=\s*[\"']\s*{name}\s*[\"'][^>]*>"


def decode(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def uncommented(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def without_raw(html: Column) -> Column:
    """Without comments and script, style, noscript and template elements."""
    return F.regexp_replace(uncommented(html), RAW_ELEMENTS, "")


def visible_text(markup: Column) -> Column:
    """The text of the body of what without_raw() left. Tags vanish without leaving a space, so words of adjacent
    elements grow together, as they do in a page's text content."""
    body = F.regexp_replace(markup, r"(?is)^.*?<body\b[^>]*>", "")
    return collapse(decode(F.regexp_replace(body, TAG, "")))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def count_tag(markup: Column, tag: str) -> Column:
    return F.regexp_count(markup, F.lit(rf"(?is)<{tag}[\s/>]"))


def title(markup: Column) -> Column:
    return collapse(decode(F.regexp_extract(markup, TITLE, 1)))


def meta_content(markup: Column, attribute: str, name: str) -> Column:
    """The content of the first such tag, trimmed; empty if there is none."""
    return collapse(decode(F.regexp_extract(F.regexp_extract(markup, meta_tag(attribute, name), 0), CONTENT_VALUE, 1)))


def canonical(markup: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(markup, CANONICAL_TAG, 0), HREF_VALUE, 1)


def hrefs(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(HREF), F.lit(1))


def ld_json_bodies(html: Column) -> Column:
    return F.regexp_extract_all(uncommented(html), F.lit(LD_JSON), F.lit(1))
