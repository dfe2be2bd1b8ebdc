"""What the operators' written tables leave on the disk."""

import os
import random

from auditloom.llm import common, simhash
from pyspark.sql import functions as F


def folders(spark):
    top = f"{common.shared_dir(spark).removeprefix('file://')}/auditloom/{spark.sparkContext.applicationId}"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.SHUFFLES_GO)
    table = common.stash(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common.SHUFFLES_GO) == setting
    assert table.agg(F.sum("count")).first()[0] == 1000


def test_near_copies_keep_only_tables_that_the_result_reads(spark):
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = [(n, " ".join([*base[:60], f"w{n}", *base[60:]])) for n in range(40)] + [(n, " ".join(str(rng.randrange(10**6)) for _ in range(80))) for n in range(40, 60)]
    before = folders(spark)
    out = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {name.split("-")[0] for name in folders(spark) - before} == {"shingles", "linked"}
    assert sorted(r.doc_id for r in out.collect()) == [0, *range(40, 60)]


def test_stars_need_no_round(spark, monkeypatch):
    made, write = [], common.Stash
    monkeypatch.setattr(common, "Stash", lambda df, label: made.append(label) or write(df, label))
    got = common.connected_components(spark.createDataFrame([(5, 1), (1, 7), (9, 8), (8, 8), (7, 1), (None, 3)], "a long, b long"))
    assert made == ["links"] and sorted(map(tuple, got.collect())) == [(1, 1), (5, 1), (7, 1), (8, 8), (9, 8)]


def test_components_of_chains_cliques_and_stars(spark):
    rng = random.Random(4)
    edges = [(n, n + 1) for n in range(100, 140)] + [(a, b) for a in range(200, 215) for b in range(200, a)] + [(400, n) for n in range(300, 400)]
    edges += [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(260)]
    root = {}

    def top(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {n: top(n) for a, b in edges if a != b for n in (a, b)}
    assert dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
