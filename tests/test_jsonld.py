"""The native walk over JSON-LD against json.loads, and the points of the scan."""

import json
import random

from pyspark.sql import functions as F

from auditloom.operators import facts, jsonld


def objects(value):
    """All objects of a parsed block."""
    if isinstance(value, dict):
        yield value
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from objects(v)


def types_of(o):
    t = o.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def made(r, depth=0):
    """Random JSON."""
    kind = r.random()
    if depth > 5 or kind < 0.35:
        return r.choice([None, True, False, 0, 0.0, 1.5, -2, "", "x", "Book", '{"@type":"No"}', "é\n\"q\"", "https://schema.org/Person"])
    if kind < 0.6:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return {k: made(r, depth + 1) for k in r.sample(["@type", "a", "sameAs", "makesOffer", "hasMenu", "areaServed", "name", "url", "image", "isbn", "workExample", "acceptedAnswer", "text"], r.randrange(6))}


def script(*bodies):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies)


def test_walk_by_json_loads(spark):
    r = random.Random(4)
    values = [[made(r) for _ in range(r.randrange(4))] for _ in range(150)]
    pages = spark.createDataFrame([(i, script(*map(json.dumps, v))) for i, v in enumerate(values)], "page_id int, html string")
    told = jsonld.with_objects(pages, F.col("html"), invalid="bad").select("page_id", "bad", F.size("_objects").alias("n"), jsonld.types("_objects").alias("types"), jsonld.any_has("_objects", "makesOffer", "hasMenu").alias("offers"))
    nodes = {x.page_id: x.ld.nodes for x in jsonld.with_nodes(pages).collect()}
    for row in told.collect():
        found = [o for v in values[row.page_id] for o in objects(v)]
        assert (row.n, row.bad) == (len(found), 0)
        assert sorted(row.types) == sorted({t for o in found for t in types_of(o)})
        assert row.offers == any(o.get(k) or isinstance(o.get(k), (list, dict)) for o in found for k in ("makesOffer", "hasMenu"))
        typed = [o for o in found if o.get("@type") or isinstance(o.get("@type"), (list, dict))]
        expected = sorted((sorted(types_of(o)), str(o.get("name") if isinstance(o.get("name"), str) else None), bool(o.get("image")) or isinstance(o.get("image"), (list, dict))) for o in typed)
        assert sorted((sorted(n.types), str(n.name), n.image) for n in nodes[row.page_id]) == expected


def test_blocks_that_do_not_parse(spark):
    deep = "[" * 400 + '{"@type":"Deep"}' + "]" * 400
    bodies = ["{bad", "", " ", deep, '{"@type":"A"} x', '{"@type":["B",5,null,{"@type":"C"}]}', '"@type":"No"', "null"]
    row = jsonld.with_objects(spark.createDataFrame([(1, script(*bodies)), (2, None)], "page_id int, html string"), F.coalesce("html", F.lit("")), invalid="bad").where("page_id = 1").select("bad", jsonld.types("_objects").alias("types")).first()
    assert sorted(row.types) == ["B", "C", "Deep"] and row.bad == 5


def points(spark, *bodies):
    pages = spark.createDataFrame([(1, "https://a.com/", script(*bodies))], "page_id long, url string, html string")
    return facts.scan(facts.page_facts(pages), F.lit(0), F.lit(False), F.lit(False)).first().schema_points


def test_schema_points(spark):
    """Types count with and without their vocabulary's address; some properties make an offer of any object."""
    for prefix in ("", "https://schema.org/", "http://schema.org/", "HTTPS://Schema.ORG/"):
        assert points(spark, f'{{"@type":"{prefix}Book"}}', f'{{"@type":["{prefix}Person"]}}') == 25
    assert points(spark, '{"@type":"Organization","makesOffer":{}}') == 25
    assert points(spark, '{"@type":"Organization","areaServed":"x"}') == 12
    assert points(spark, '{"hasMenu":"https://a.com/menu"}') == 12
    assert points(spark, '{"hasMenu":""}', '{"hasOfferCatalog":null}', '{"makesOffer":0}', '{"makesOffer":false}') == 0
    assert points(spark, '{"name":"{\\"@type\\":\\"Book\\"}"}', '{"@type":"Book"') == 0
    assert points(spark, '{"@type":"https://example.org/Book"}') == 0


def test_facts_keep_types_as_they_are(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", script('{"@type":"https://schema.org/Book"}'))], "page_id long, url string, html string")
    assert facts.page_facts(pages).first().schema_types == ["https://schema.org/Book"]
