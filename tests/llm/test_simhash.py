"""SimHash against a direct computation with the xxhash library and all pairs."""

import re

import pytest
import xxhash
from pyspark.sql import functions as F

from auditloom.llm import queries, simhash
from auditloom.llm.common import connected_components


def fingerprint(text, width=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    comps = components(prints)
    got = {r.doc_id: r for r in queries.op4_simhash_near_dedup(spark, sf_dir).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == comps


@pytest.mark.parametrize("hot", [1, 512])
def test_similar_pairs(spark, hot):
    base = [0, 0x123456789ABCDEF0, -1]
    values = {b ^ m for b in base for m in [0, 1, 3, 7, 1 << 40, (1 << 40) | 1, (1 << 62), (1 << 33) | (1 << 34)]}
    want = {(min(a, b), max(a, b)) for a in values for b in values if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = simhash.similar_fingerprints(spark.createDataFrame([(v,) for v in values], "fp bigint"), hot).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (None, "one"), (6, "É é x"), (7, "word " * 30_000)]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {int(got[i].fingerprint, 16) for i in (1, 2, 3)} == {0} and {got[i].component_id for i in (1, 2, 3)} == {1}
    assert {got[i].component_id for i in (4, 5, None)} == {4}
    assert int(got[6].fingerprint, 16) == fingerprint(rows[6][1]) and int(got[7].fingerprint, 16) == fingerprint(rows[7][1])


def test_drop(spark):
    rows = [(2, "a b c d", "x", 1), (1, "a b c d", "y", 2), (None, "a b c d", "z", 3), (9, "quite another text here", "w", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fp string, component int")
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 9]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (100, 90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixed_case_letters_only_ascii(spark):
    got = spark.range(1).select(F.translate(F.lit("ÉAz"), simhash.UPPER, simhash.LOWER).alias("v")).first().v
    assert got == "Éaz"
