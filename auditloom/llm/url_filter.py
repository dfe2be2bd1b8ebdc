"""URL filtering: fixed host rules first, then association rules that FP-growth mines from labelled URLs."""

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import html
from auditloom.llm import quality
from auditloom.llm.common import stash

BAD = "label:bad"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what follows the first :// up to /, ?, # or the end, A-Z lower-cased; the path
    goes on to ?, # or the end. Both are empty for a null url or one without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, g), F.lit("")) for g in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (pattern `host/path`, verdict) that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for pattern, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = pattern.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule = F.when(fits, pattern).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_items(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, each label of the host, its registrable end, path segments with digits masked,
    file ending, names of query parameters, and whether there is a fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    end = F.array_join(F.slice(labels, -2, 2), ".")
    segments = F.filter(F.split(F.regexp_replace(path, r"\d+", "0"), "/"), lambda x: x != "")
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    return F.array_compact(
        F.array_distinct(
            F.concat(
                F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
                F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
                F.array(F.when(F.size(labels) > 1, F.concat(F.lit("site:"), end))),
                F.transform(segments, lambda x: F.concat(F.lit("path:"), x)),
                F.array(F.when(ending != "", F.concat(F.lit("ending:"), ending))),
                names,
                F.array(F.when(F.instr(url, "#") > 0, F.lit("fragment:"))),
            )
        )
    )


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float = 1.0, min_rows: int = 1) -> DataFrame:
    """(rule_id, items, confidence, lift, support, rarest) from rows (items, bad). Kept are rules items -> bad with the support,
    confidence and lift asked for that hold in at least min_rows rows, and of those the ones that are not a narrower
    case of another with at least the same confidence. Items of all rows tell nothing and are left out.

    Their number is bounded by the support: at most 1/min_support * (items in a URL) itemsets of each size."""
    n = labelled.count()
    common = F.broadcast(labelled.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") == n).agg(F.collect_set("item").alias("_common")))  # in every URL, so at most as many as one URL has
    some = labelled.crossJoin(common).withColumn("items", F.array_except("items", "_common"))
    baskets = some.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / max(n, 1)), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") > 1) & (F.col("lift") >= min_lift))
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("item"), "freq")
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", "lift", "support")
    parts = found.select("items", F.explode("items").alias("item")).join(single, "item").groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("rarest"))
    found = stash(found.join(parts, "items"), "rules")
    # a broader rule lacks at least one of the items and is as sure; it is found by its rarest item
    broad = found.select(F.col("items").alias("wide"), F.col("rarest").alias("item"), F.col("confidence").alias("sure"))
    narrower = found.select("items", "confidence", F.explode("items").alias("item")).join(broad, "item")
    narrower = narrower.where((F.size("wide") < F.size("items")) & (F.size(F.array_except("wide", "items")) == 0) & (F.col("sure") >= F.col("confidence"))).select("items").distinct()
    kept = found.join(narrower, "items", "left_anti")
    return stash(kept.select(F.sha2(F.array_join("items", " "), 256).alias("rule_id"), "items", "confidence", "lift", "support", "rarest"), "kept-rules")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(_row, rule_id, confidence): the surest rule that fits a page. The index lists each rule under its
    rarest item; a page looks up its items there and verifies the others of each rule found."""
    index = rules.select(F.col("rarest").alias("item"), "rule_id", F.col("items").alias("needs"), "confidence")
    hits = pages.select("_row", "items", F.explode("items").alias("item")).join(index, "item")
    hits = hits.where(F.size(F.array_except("needs", "items")) == 0)
    best = F.max_by(F.struct("rule_id", "confidence"), F.struct("confidence", "rule_id")).alias("best")
    return hits.groupBy("_row").agg(best).select("_row", "best.*")


def text_labels(pages: DataFrame, model: quality.Model, least: float = 0.3, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, bad): whether the quality model, which never sees an address, rejects the page's own visible text. Pages without text tell
    nothing (null)."""
    text = html.visible_text(html.without_raw(F.coalesce(F.col(html_col), F.lit(""))))
    scored = quality.score_quality(pages.select(F.col(id_col).alias("id"), text.alias("text")), model)
    return scored.select("id", F.when(F.col("text") != "", F.col("score") < least).alias("bad"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    min_lift: float = 1.2,
    min_rows: int = 5,
    bound: int = 100_000,
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, mined_rule, confidence.

    A listed rule decides where one fits. Elsewhere a page is blocked if a mined rule fits, else allowed.
    labels has (id, bad): null bad and ids without a page don't count; several labels of an id: bad if one
    says so. Rules are mined from about `bound` labelled pages (those whose hash of address and id falls in the share that gives so
    many, however the files are split), and must
    hold in min_support of them and in min_rows pages, be right in min_confidence of the cases, and be so min_lift times as often as
    labelled pages are bad at all. Null or malformed urls have an empty host and path
    and no items, so they are allowed. Repeated rows each get a row; columns besides id and url are ignored.
    """
    host, path = split_url(F.col(url_col))
    tagged = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    items = F.when(F.col("host") != "", url_items(F.col("_url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    tagged = stash(tagged.select("_row", "_id", F.xxhash64("_url", "_id").alias("_hash"), "host", "path", items.alias("items")), "urls")
    told = labels.where("bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = stash(tagged.where(F.size("items") > 0).join(told, F.col("_id") == F.col("id")).select("_hash", "items", "bad"), "labelled")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    found = tagged.select("_row", "_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    n = labelled.count()
    if n == 0:  # FP-growth takes no empty table
        found = found.withColumns({"rule_id": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        some = labelled.where(F.pmod("_hash", F.lit(1 << 30)) < bound / n * (1 << 30))
        found = found.join(match_rules(tagged, mine_rules(some, min_support, min_confidence, min_lift, min_rows)), "_row", "left")
    mined = F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")
    return found.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), F.col("rule_id").alias("mined_rule"), "confidence")
