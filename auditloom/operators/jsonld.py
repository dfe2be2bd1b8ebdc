"""JSON-LD: the objects of a page's blocks, found by a native walk over VARIANT values, and what is derived from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import html

IMAGE_FIELDS = ("logo", "image", "primaryImageOfPage", "thumbnailUrl")
#: A parser's own limit on nesting.
DEEPEST = 1000

_MAP, _ARRAY = "map<string,variant>", "array<variant>"


def _as(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def _is(value: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({value}) = '{kind}', false)"


def _truthy(value: str) -> str:
    """What a script takes for true: all but null, false, 0 and the empty string."""
    text = f"to_json({value})"
    return f"coalesce({value} is not null and not is_variant_null({value}) and {text} not in ('false', '0', '\"\"') and coalesce(try_cast({text} as double) <> 0, true), false)"


def _string(value: str) -> str:
    """A string's value; null for anything else."""
    return f"if({_is(value, 'STRING')}, {_as(value, 'string')}, null)"


def _list(value: str) -> str:
    """An array's elements, or the value as the only one; none where there is no value."""
    return f"coalesce({_as(value, _ARRAY)}, if({value} is null or is_variant_null({value}), cast(array() as {_ARRAY}), array({value})))"


def _strings(value: str) -> str:
    return f"filter(transform({_list(value)}, e -> {_string('e')}), e -> e is not null)"


def parsed(bodies: Column) -> Column:
    """array<variant> of the blocks that are one JSON value. A block with a key twice in one object, or nested deeper than the parser
    goes, isn't taken. The parser lets text after a value pass; so a block is tried within brackets and within braces, which
    together leave no room for any."""

    def whole(b: Column) -> Column:
        one = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), b, F.lit("]"))), "$", _ARRAY)) == 1
        return F.coalesce(one & F.try_parse_json(F.concat(F.lit('{"v":'), b, F.lit("}"))).isNotNull(), F.lit(False))

    return F.transform(F.filter(bodies, whole), F.try_parse_json)


def objects(blocks: Column, bodies: Column) -> Column:
    """array<map<string, variant>>: all objects of the parsed blocks, level by level. A step opens one level; there are no more
    levels than opening brackets in the bodies."""
    brackets = F.aggregate(bodies, F.lit(0), lambda n, b: n + F.regexp_count(b, F.lit(r"[{\[]")))
    steps = F.when(F.size(blocks) > 0, F.sequence(F.lit(1), F.least(F.greatest(brackets, F.lit(1)), F.lit(DEEPEST)))).otherwise(F.array().cast("array<int>"))
    start = F.struct(blocks.cast(_ARRAY).alias("level"), F.array().cast(f"array<{_MAP}>").alias("found"))

    def open_level(now: Column, step: Column) -> Column:
        maps = F.filter(F.transform(now["level"], lambda v: F.try_variant_get(v, "$", _MAP)), lambda m: m.isNotNull())
        lists = F.filter(F.transform(now["level"], lambda v: F.try_variant_get(v, "$", _ARRAY)), lambda m: m.isNotNull())
        below = F.concat(F.flatten(F.transform(maps, F.map_values)), F.flatten(lists))
        below = F.filter(below, lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False)))
        return F.struct(below.cast(_ARRAY).alias("level"), F.concat(now["found"], maps).cast(f"array<{_MAP}>").alias("found"))

    return F.aggregate(steps, start, open_level, lambda now: now["found"])


_TYPE = "m['@type']"


def _node() -> str:
    """An object m as a struct of what the rules ask."""

    def has(name: str) -> str:
        return _truthy(f"m['{name}']")

    def of(value: str, name: str) -> str:
        return f"{_as(value, _MAP)}['{name}']"

    works, answer = _list("m['workExample']"), "m['acceptedAnswer']"
    images = ", ".join(f"transform({_list(image)}, i -> coalesce({_string('i')}, {_string(of('i', 'url'))}))" for image in (f"m['{name}']" for name in IMAGE_FIELDS))
    fields = {
        "types": _strings(_TYPE),
        "same_as": _strings("m['sameAs']"),
        "images": f"filter(flatten(array({images})), i -> i rlike '(?i)^https?://')",
        "job_title": has("jobTitle"), "described": has("description"), "isbn": f"{has('isbn')} or exists({works}, w -> {_truthy(of('w', 'isbn'))})", "author": has("author"), "image": has("image"),
        "name": _string("m['name']"), "url": _string("m['url']"), "question": _string("m['name']"), "answer": _string(of(answer, "text")),
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def nodes(found: str) -> Column:
    """The objects of the column found that have a type, as structs: types (text), same_as, images, job_title, described, isbn, author,
    image, name, url, question, answer."""
    return F.expr(f"transform(filter({found}, m -> {_truthy(_TYPE)}), m -> {_node()})")


def types(found: str) -> Column:
    """The distinct types that objects of the column found name, as they are written."""
    return F.expr(f"array_distinct(flatten(transform({found}, m -> {_strings(_TYPE)})))")


def any_has(found: str, *names: str) -> Column:
    """Whether any object of the column found has one of the properties, with a value that isn't empty."""
    return F.expr(f"exists({found}, m -> {' or '.join(_truthy(f'm[{n!r}]') for n in names)})")


def with_objects(pages: DataFrame, text: Column, name: str = "_objects", invalid: str | None = None) -> DataFrame:
    """pages with the objects of the HTML in text, and the number of blocks that don't parse."""
    bodies, blocks = F.col("_bodies"), F.col("_blocks")
    told = pages.withColumn("_bodies", html.ld_json_bodies(text)).withColumn("_blocks", parsed(bodies)).withColumn(name, objects(blocks, bodies))
    if invalid:
        told = told.withColumn(invalid, F.size("_bodies") - F.size("_blocks"))
    return told.drop("_bodies", "_blocks")


def with_nodes(pages: DataFrame) -> DataFrame:
    """pages (html) with ld: struct<nodes, invalid>."""
    told = with_objects(pages, F.coalesce(F.col("html"), F.lit("")), invalid="_invalid")
    return told.withColumn("ld", F.struct(nodes("_objects").alias("nodes"), F.col("_invalid").alias("invalid"))).drop("_objects", "_invalid")


def of_type(nodes: Column, *types: str) -> Column:
    return F.filter(nodes, lambda n: F.arrays_overlap(n["types"], F.array(*map(F.lit, types))))


def same_as(nodes: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(nodes, lambda n: n["same_as"])))


def persons_thin(nodes: Column) -> Column:
    people = of_type(nodes, "Person")
    return (F.size(people) > 0) & F.forall(people, lambda p: (F.coalesce(p["url"], F.lit("")) == "") | ~p["job_title"] | ~p["described"])


def books_incomplete(nodes: Column) -> Column:
    return F.exists(of_type(nodes, "Book"), lambda b: ~b["author"] | ~b["isbn"] | ~b["image"])


def faq_entries(nodes: Column) -> Column:
    asked = F.filter(of_type(nodes, "Question"), lambda n: F.coalesce(n["question"], F.lit("")) != "")
    return F.transform(asked, lambda n: F.struct(n["question"].alias("question"), F.coalesce(n["answer"], F.lit("")).alias("answer")))


def image_urls(nodes: Column) -> Column:
    """In the order of their text."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(nodes, lambda n: n["images"]))))
