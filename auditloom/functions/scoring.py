"""Points, grades, bands and the ad calculator."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
WEIGHTS = {"schema": 25, "headings": 15, "entity_links": 10, "open_graph": 10, "canonical": 15, "content": 10, "bot_access": 10, "sitemap": 5}
GRADES = ((85, "A (Strong Foundations)"), (70, "B (Good, Some Gaps)"), (50, "C (Major Gaps)"))
LAST_GRADE = "D (Limited Signals)"
SEVERITY_WEIGHTS = {"error": 3, "warning": 2, "notice": 1}
THIN_WORDS, HALF_WORDS, LONG_WORDS = 300, 150, 5000


def grade(score: Column) -> Column:
    out = F.lit(LAST_GRADE)
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_class(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 55, "ok").otherwise("bad")


def heading_points(h1: Column, h2: Column) -> Column:
    return F.when(h1 == 1, F.when(h2 > 0, WEIGHTS["headings"]).otherwise(10)).when(h1 > 1, 5).otherwise(0)


def open_graph_points(present: Column) -> Column:
    return F.when(present == 3, WEIGHTS["open_graph"]).when(present > 0, 5).otherwise(0)


def content_points(words: Column) -> Column:
    return F.when(words >= THIN_WORDS, WEIGHTS["content"]).when(words >= HALF_WORDS, 5).otherwise(0)


def bot_points(allowed: Column, known: Column, bots: int = 4) -> Column:
    return F.when(known, F.round(WEIGHTS["bot_access"] * allowed / F.lit(float(bots)))).otherwise(0).cast("int")


def schema_points(book: Column, person: Column, org: Column, offer: Column, faq: Column) -> Column:
    full = (book & person) | (org & (offer | faq))
    return F.when(full, WEIGHTS["schema"]).when(book | person | org | offer | faq, 12).otherwise(0)


def business_schema_points(person: Column, org: Column, offer: Column, faq: Column) -> Column:
    return F.when(org & (offer | faq), WEIGHTS["schema"]).when(org | offer | person, 12).otherwise(0)


def business_link_points(profiles: Column, reachable: Column) -> Column:
    """profiles: how many kinds of profile are linked; reachable: whether there is a phone or mail link."""
    return F.when((profiles >= 2) | ((profiles >= 1) & reachable), WEIGHTS["entity_links"]).when((profiles >= 1) | reachable, 5).otherwise(0)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def quadrant(impact: Column, effort: Column) -> Column:
    return F.when(impact >= 3, F.when(effort <= 2, "Quick win").otherwise("Major project")).otherwise(F.when(effort <= 2, "Fill-in").otherwise("Deprioritize"))


def priority(impact: Column, severity: Column, effort: Column) -> Column:
    weight = F.create_map(*(F.lit(x) for kv in SEVERITY_WEIGHTS.items() for x in kv))
    return F.round(impact * F.element_at(weight, severity) * 10 / effort).cast("int")


def ad_profit(price: Column, royalty_percent: Column, cpc: Column, clicks: Column) -> dict[str, Column]:
    """royalty, cpa, profit, squeeze score and band of an advertised book; what isn't a number counts as 0."""
    p, r, c, k = (F.coalesce(x.try_cast("double"), F.lit(0.0)) for x in (price, royalty_percent, cpc, clicks))
    royalty, cpa = p * (r / 100), c * k
    profit = royalty - cpa
    score = F.when(profit < 0, 100.0).when(profit == 0, 90.0).otherwise(100 - F.least(profit / 5, F.lit(1.0)) * 100)
    band = F.when(score > 90, "CRITICAL").when(score > 60, "WARNING").otherwise("HEALTHY")
    return {"royalty": royalty, "cpa": cpa, "profit": profit, "score": F.round(score).cast("int"), "band": band}


def money(v: Column) -> Column:
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_string("%.2f", F.abs(v)))
