"""SimHash near-duplicates, found by multi-index hashing: of narrow fingerprints within two bits, or of texts whose word
shingles have a Jaccard similarity of 0.8 or more, proposed by wide fingerprints and decided on the sets."""

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from auditloom.llm.common import Stash, bits_of, connected_components, freed_memory, lasting, matched, small_batches, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


@pandas_udf(T.LongType())
def fold_bits(hashes: pd.Series) -> pd.Series:
    """The fingerprint of each array of hashes: the bits that are set in over half of them."""

    def fold(h) -> int:
        n = 0 if h is None else len(h)
        counts = np.zeros(64, np.int64)
        for lo in range(0, n, 1 << 14):
            part = np.ascontiguousarray(h[lo : lo + (1 << 14)], np.int64)
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])

    return pd.Series([fold(h) for h in hashes], dtype="int64")


def with_shingles(df: DataFrame, text: Column, width: int) -> DataFrame:
    """df and the column _shingles: hashes of the text's shingles (width words joined by a space), repeats included; a text of fewer
    words is one shingle; a text of none, or null, has none. Spark's xxhash64 is XXH64, seed 42."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE), lambda x: x != "")
    some, w, n = df.withColumn("_words", words), F.col("_words"), F.size("_words")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(width)))))
    found = F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return some.withColumn("_shingles", found).drop("_words")


def with_fingerprint(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """docs and the column _fp; a text without words has fingerprint zero."""
    return with_shingles(docs, F.col(f"`{text_col}`"), width).withColumn("_fp", fold_bits("_shingles")).drop("_shingles")


def similar_fingerprints(fps: DataFrame, hot_bucket: int = 512) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in 1 or 2 bits.

    Multi-index hashing: of two fingerprints at distance 2, one 32-bit half differs in at most one bit. Each
    half has a table; a fingerprint probes it with its own half and, if the half has an odd number of set
    bits, with the 32 halves at distance one (two halves at distance one differ in parity, so one of them
    does that). Every hit is verified on all 64 bits.

    The fingerprints of a bucket of over hot_bucket leave the tables and enumerate their full ball of 2,080
    fingerprints instead, so the work for each fingerprint stays bounded and no pair is lost.
    """
    half = F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))).alias("seg", "key")
    table = fps.select("fp", half)
    hot = stash(table.groupBy("seg", "key").count().where(F.col("count") > hot_bucket).select("seg", "key"), "hot")
    near = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    probes = table.select("seg", F.col("fp").alias("p"), "key", F.explode(F.when(F.bit_count("key") % 2 == 1, F.concat(F.array("key"), near)).otherwise(F.array("key"))).alias("probe"))
    any_hot = not hot.isEmpty()
    cold = table.join(hot, ["seg", "key"], "left_anti") if any_hot else table
    hits = probes.select("seg", "p", F.col("probe").alias("key")).join(cold, ["seg", "key"]).where("p <> fp")
    close = hits.where(F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= 2)
    pairs = close.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b"))
    if any_hot:
        masks = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        crowded = table.join(hot, ["seg", "key"], "left_semi").select(F.col("fp").alias("p")).distinct()
        ball = crowded.select("p", F.explode(F.lit(signed).cast("array<bigint>")).alias("m")).select("p", F.col("p").bitwiseXOR(F.col("m")).alias("fp"))
        found = ball.join(fps.select("fp"), "fp")
        pairs = pairs.unionByName(found.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")))
    return pairs.distinct()


def _linked(tagged: DataFrame, hot_bucket: int) -> DataFrame:
    """(fp, component): component is a fingerprint too, the smallest that links reach."""
    fps = stash(tagged.select(F.col("_fp").alias("fp")).distinct(), "fingerprints")
    comps = connected_components(similar_fingerprints(fps, hot_bucket))
    return fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot_bucket: int = 512) -> DataFrame:
    """One row per row of docs: its id, fingerprint (16 hex digits) and component_id, the smallest id that
    links reach. Texts without words, and null texts, share the fingerprint zero and link like any other.
    A component whose ids are all null has a null component_id; null ids are passed over else. Repeated rows
    stay; an empty table gives an empty result; other columns of docs are not read."""
    tagged = stash(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", width).select("_id", "_fp"), "simhash")
    linked = stash(_linked(tagged, hot_bucket), "linked")
    least = tagged.groupBy("_fp").agg(F.min("_id").alias("least"))
    by_fp = linked.join(least, linked.fp == least._fp).select("fp", "component", "least")
    named = by_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    final = by_fp.join(named, "component").select(F.col("fp").alias("_fp"), "component_id")
    return tagged.join(final, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, hot_bucket: int = 512) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (nulls last; of equal ids the first
    read). Columns are those of docs, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    tagged = stash(with_fingerprint(packed, "_text", width).select("_doc", "_id", "_row", "_fp"), "simhash")
    linked = _linked(tagged, hot_bucket)
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    first = tagged.groupBy("_fp").agg(F.min(order).alias("first"))
    stays = linked.join(first, linked.fp == first._fp).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.r").alias("_row"))
    return tagged.join(stays, "_row", "left_semi").select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


#: Segments of the wide fingerprint by their bits. A text probes a segment's table with its own bits and with the PROBES - 1 likeliest
#: others among those that differ in the WEAK bits nearest to a tie. By simulation two texts of 200 shingles and similarity 0.8 meet in one
#: segment of 24 bits with probability 0.21, of 28 with 0.12, of 32 with 0.06, so in one of all with 0.995 or more (above 0.8 more often).
SEGMENTS = {24: 24, 25: 28, 26: 32, 27: 38, 28: 44, 29: 52, 30: 60, 31: 72, 32: 88}
PROBES, WEAK = 16, 6
#: Bits that a segment has beyond the logarithm of the rows: texts that aren't alike meet by chance as often in a large table as in a small one.
SPARE = 8
#: Two segments a lane, each in 32 bits. The first LANES are compared as a whole.
LANES, MOST_LANES = 9, max(SEGMENTS.values()) // 2
#: Numbers of the parity sketch, see odd_sketch().
ODD = 8
#: Of the sets of bits that hold segments' values, and how many values go into one.
KEY_BITS, KEYS = 29, 1 << 26
#: Similarity 0.8 is a cosine of 0.89 or an angle of 0.15 of a half turn: 87 of 576 bits differ on average, 9 is the standard deviation.
MOST_BITS = 120
_RANDOM = np.random.default_rng(20)
_FLIP, _TIMES, _AGAIN = (_RANDOM.integers(0, 1 << 64, MOST_LANES, np.uint64) | np.uint64(1) for _ in range(3))
_MASKS = (np.arange(1 << WEAK)[:, None] >> np.arange(WEAK)) & 1
#: Spreads the values of different segments over the last bits of their keys.
_STEP = 0x9E3779B1


def segment_bits(rows: int) -> int:
    """How wide the segments are for a table of so many rows."""
    return min(max(rows.bit_length() + SPARE, min(SEGMENTS)), max(SEGMENTS))


def _counts(members: np.ndarray, lanes: int) -> np.ndarray:
    """How many of the set's hashes have each bit."""
    total = np.zeros(lanes * 64, np.int64)
    for lo in range(0, len(members), 1 << 11):
        h = (members[lo : lo + (1 << 11), None] ^ _FLIP[:lanes]) * _TIMES[:lanes]
        h = (h ^ (h >> np.uint64(32))) * _AGAIN[:lanes]
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return total


def odd_sketch(members: np.ndarray) -> np.ndarray:
    """Which of ODD * 64 places an odd number of the set's hashes falls on. An element that only one of two sets has changes one place, so the
    sketches never differ in more places than the sets have elements apart."""
    places = np.bincount((members >> np.uint64(20)).astype(np.int64) % (ODD * 64), minlength=ODD * 64)
    return np.packbits((places & 1).astype(np.uint8), bitorder="little").view("<i8")


def wide_prints(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the segments of each set, two a lane; the places of each segment's WEAK bits nearest to a tie, then how near they are)."""
    segments = SEGMENTS[bits]
    counts = np.stack([_counts(u, segments // 2) for u in sets])
    sizes = np.array([len(u) for u in sets])
    sure = 2 * counts - sizes[:, None]
    lanes = np.packbits((sure > 0).astype(np.uint8), axis=1, bitorder="little").view("<i8")
    away = np.abs(sure).reshape(len(sets), segments, 32)[:, :, :bits]
    weak = np.argsort(away, axis=2, kind="stable")[:, :, :WEAK]
    near = np.take_along_axis(away, weak, axis=2) * (256 / np.sqrt(np.maximum(sizes, 1)))[:, None, None]
    return lanes, np.concatenate([weak, np.minimum(near, 255)], axis=2).astype(np.uint8)


def _keys(values: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """A number for a segment and its value; as own_keys() has it."""
    return (segments << 32) + ((values + segments * _STEP) & 0xFFFFFFFF)


def own_keys(lanes: Column, bits: int) -> Column:
    """The keys of a text's own segments."""
    each = [F.shiftrightunsigned(lanes[i // 2], 32 * (i % 2)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(SEGMENTS[bits])]
    return F.array(*((v + F.lit(i * _STEP)).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(i << 32) for i, v in enumerate(each)))


def probe_keys(lanes: np.ndarray, weak: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """The keys that texts probe beside their own, of segments first to last - 1, by the sum of how near the changed bits are to a tie."""
    own = np.ascontiguousarray(lanes).view("<u4")[:, first:last].astype(np.int64) & ((1 << bits) - 1)
    places, near = weak[:, first:last, :WEAK].astype(np.int64), weak[:, first:last, WEAK:].astype(np.int64)
    chosen = np.argsort(near @ _MASKS.T[:, 1:], axis=2, kind="stable")[:, :, : PROBES - 1] + 1
    flips = (_MASKS[chosen] << places[:, :, None, :]).sum(axis=3)
    return _keys(own[:, :, None] ^ flips, np.arange(first, last)[None, :, None]).reshape(len(lanes), -1)


def _wide(bits: int) -> Callable[[str], Column]:
    """A hash of the set; what it is compared by: LANES of its fingerprint, its parity sketch and its size; the fingerprint's other lanes and its weak
    bits. An empty set has a hash only."""

    def prints(hashes: pd.Series) -> pd.DataFrame:
        nodes, fps, more, weak = [], [], [], []
        for lo in range(0, len(hashes), 50):
            sets = [np.unique(np.asarray(h, np.int64)).view(np.uint64) for h in hashes.iloc[lo : lo + 50]]
            lanes, near = wide_prints(sets, bits)
            nodes += [int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True) for u in sets]
            fps += [np.concatenate([x[:LANES], odd_sketch(u), [len(u)]]) if len(u) else x[:0] for u, x in zip(sets, lanes, strict=True)]
            more += [x[LANES:] if len(u) else x[:0] for u, x in zip(sets, lanes, strict=True)]
            weak += [x.tobytes() if len(u) else b"" for u, x in zip(sets, near, strict=True)]
        return pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "fp": fps, "more": more, "weak": weak})

    @pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("more", T.ArrayType(T.LongType())), T.StructField("weak", T.BinaryType())]))
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with freed_memory():
            yield from map(prints, batches)

    return wide


def _apart(a: str, b: str, lo: int, n: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(lo, lo + n)), F.lit(0))


def _close(a: str, b: str, least: float) -> Column:
    """Whether two wide fingerprints differ in at most MOST_BITS bits, and sizes and parity sketches allow a similarity of `least`: of sets of m and
    n elements, at most (m + n) (1 - least) / (1 + least) are in one only. The second test loses no pair."""
    both = F.col(a)[LANES + ODD] + F.col(b)[LANES + ODD]
    lone = F.greatest(_apart(a, b, LANES, ODD), F.abs(F.col(a)[LANES + ODD] - F.col(b)[LANES + ODD]))
    return (lone * (1 + least) <= both * (1 - least) + 1e-6) & (_apart(a, b, 0, LANES) <= MOST_BITS)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _among(rows: DataFrame, name: str) -> Callable[[str], Column]:
    """A test of a column for being among rows' numbers, by a bounded set of bits: true for all that are and for a few others."""
    bits = rows.sparkSession.sparkContext.broadcast(bits_of(rows.select(F.xxhash64(name).alias("hash")), "hash", KEY_BITS, each=32))

    @pandas_udf("boolean")
    def has(hashes: pd.Series) -> pd.Series:
        return pd.Series(bits.value.has(hashes.to_numpy(np.int64)))

    return lambda column: has(F.xxhash64(column))


class _Texts:
    """What decides whether nodes (distinct sets of shingles) are similar."""

    def __init__(self, tagged: DataFrame, text: Column, width: int, least: float, rows: int):
        self.width, self.least, self.rows, self.bits = width, least, rows, segment_bits(rows)
        least_row = tagged.groupBy(F.col("_node").alias("node")).agg(F.min("_row").alias("_row"), F.count("*").alias("rows"))
        self.reps = stash(least_row, "reps")
        # where a node has one row, that is it; the others are told by a join
        printed = tagged.select(F.col("_node").alias("node"), "_row", "_fp", "_more", "_weak")
        several = _among(self.reps.where("rows > 1"), "node")
        first = printed.where(several("node")).join(self.reps.select("node", "_row"), ["node", "_row"], "left_semi")
        self.prints = printed.where(~several("node")).unionByName(first).select("node", "_fp", "_more", "_weak")
        self.texts = tagged.select("_row", text.alias("_text"))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), whose fingerprints are close, whose sets have at least the Jaccard similarity asked for."""
        kept = Stash(pairs.distinct(), "close")
        close = kept.df
        nodes = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
        asked = Stash(self.reps.select("node", "_row").join(nodes, "node"), "asked")
        told = self.texts.where(_among(asked.df, "_row")("_row")).join(asked.df, "_row")  # no other text is shuffled
        sets = Stash(with_shingles(told, F.col("_text"), self.width).select("node", F.array_distinct("_shingles").alias("members")), "sets")
        a, b = (sets.df.select(F.col("node").alias(x), F.col("members").alias(f"_{x}")) for x in "ab")
        m, n = F.size("_a"), F.size("_b")
        likely = close.join(a, "a").join(b, "b").where(F.least(m, n) >= self.least * F.greatest(m, n))
        common = likely.withColumn("_common", F.size(F.array_intersect("_a", "_b")))
        found = stash(common.where(F.col("_common") / (m + n - F.col("_common")) >= self.least).select("a", "b"), "similar")
        for done in (kept, asked, sets):
            done.drop()
        return found


def _placed(members: DataFrame) -> DataFrame:
    """members, each with the component at that the node is in so far, and main, the bucket's largest; buckets with one component only go."""
    parts = members.groupBy("key", "at").agg(F.count("*").alias("n_at"))
    main = parts.groupBy("key").agg(F.max_by("at", F.struct("n_at", "at")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("key", "main")
    return members.join(main, "key")


def _at(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes, one row each, with at, the component that links give the node."""
    return nodes.join(connected_components(links), "node", "left").withColumn("at", F.coalesce("component", "node")).drop("component")


def _nearest(texts: _Texts, fps: DataFrame, rows: DataFrame, apart: bool) -> DataFrame:
    """Similar pairs (a, b) of each node with one that it shares a bucket with: the most central one, of all its buckets; with apart, of the buckets'
    largest components that it isn't in. rows: (key, node, weight, at); fps: (node, _fp). At most one pair for a node, whatever the buckets."""
    parts = rows.groupBy("key", "at").agg(F.count("*").alias("n_at"), F.max(F.struct("weight", "node")).alias("best"))
    top = F.max_by(F.struct(F.col("at").alias("main"), "best"), F.struct("n_at", "at")) if apart else F.max(F.struct("best", F.col("at").alias("main")))
    central = parts.groupBy("key").agg(top.alias("top")).select("key", "top.main", "top.best")
    met = rows.join(central, "key").where(F.col("at") != F.col("main") if apart else F.col("node") != F.col("best.node"))
    chosen = met.groupBy("node").agg(F.max("best").getField("node").alias("pivot"))
    pivots = fps.select(F.col("node").alias("pivot"), F.col("_fp").alias("_pivot_fp"))
    near = chosen.join(fps.select("node", "_fp"), "node").join(pivots, "pivot").where(_close("_fp", "_pivot_fp", texts.least))
    return texts.similar(near.select(*_pair("node", "pivot")))


def _gathered(texts: _Texts, own: DataFrame, crowded: int) -> DataFrame:
    """Similar pairs (a, b) that join most of a large group of near copies before anything is looked up for them: nodes that share a value
    with over `crowded` others are compared with the most central one, then with that of the largest component, see _nearest()."""
    big = stash(own.groupBy("key").agg(F.count("*").alias("owners")).where(F.col("owners") > crowded), "big")
    if big.isEmpty():
        return own.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    held = matched(own, big, ["key"], "owners").groupBy("node").agg(F.sum("owners").alias("weight"), F.collect_list("key").alias("keys"))
    held = stash(held.join(texts.prints.select("node", "_fp"), "node"), "held")
    links = _nearest(texts, held, held.select("node", "weight", F.col("node").alias("at"), F.explode("keys").alias("key")), False)
    return links.unionByName(_nearest(texts, held, _at(held, links).select("node", "weight", "at", F.explode("keys").alias("key")), True))


def _similar_groups(texts: _Texts, crowded: int) -> DataFrame:
    """(node, component) of nodes with links.

    Large groups are joined first, see _gathered(). A bucket holds the nodes that have or probe one value of a segment; one
    whose nodes are all in one component is dropped. In the others, of over `crowded` nodes, nodes outside the largest component are compared with its
    most central one, one pair a node. After that, every node that has the value is compared with every one that probes it,
    but for those that are in one component already; in a bucket of over `crowded` nodes all with all. So no pair that shares a
    bucket is left out."""
    # a set of bits tells which values some text has, so only probes that hit leave their task (and a few others, which `sizes` drops)
    bits, segments, least = texts.bits, SEGMENTS[texts.bits], texts.least
    lanes = F.concat(F.slice("_fp", 1, LANES), F.col("_more"))
    asked = texts.prints.where(F.size("_fp") > 0)
    links = _gathered(texts, asked.select("node", F.explode(own_keys(lanes, bits)).alias("key")), crowded)
    asked = _at(asked, links)
    own = asked.select("node", "at", F.explode(own_keys(lanes, bits)).alias("key"))
    span = [F.min("at").alias("low"), F.max("at").alias("high")]
    owned = Stash(own.groupBy("key").agg(F.count("*").alias("owners"), *span), "owned")
    context = own.sparkSession.sparkContext

    def hitting(there: Broadcast, first: int, last: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with freed_memory():
                for part in (b.slice(lo, 250) for b in batches for lo in range(0, b.num_rows, 250)):
                    nodes, ats = part.column(0).to_numpy(), part.column(1).to_numpy()
                    whole = part.column(2).flatten().to_numpy().reshape(len(nodes), segments // 2)
                    weak = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(nodes), segments, 2 * WEAK)
                    probes = probe_keys(whole, weak, bits, first, last)
                    row, at = np.nonzero(there.value.has(probes))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[row]), pa.array(ats[row]), pa.array(probes[row, at])], ["node", "at", "key"])

        return run

    asking = asked.select("node", "at", lanes.alias("lanes"), "_weak")
    step, found = max(1, KEYS // max(texts.rows, 1)), []
    for first in range(0, segments, step):  # some segments at a time, so that a set of bits never fills up
        last = min(first + step, segments)
        there = context.broadcast(bits_of(owned.df.where(F.shiftright("key", 32).between(first, last - 1)).select("key"), "key", KEY_BITS, each=32))
        found.append(Stash(asking.mapInArrow(hitting(there, first, last), "node bigint, at bigint, key bigint"), "hits"))
        there.unpersist()
    hits = reduce(DataFrame.unionByName, (x.df for x in found))
    n = F.col("owners") + F.coalesce("probes", F.lit(0))
    probed = hits.groupBy("key").agg(F.count("*").alias("probes"), F.min("at").alias("least"), F.max("at").alias("most"))
    mixed = F.least("low", "least") < F.greatest("high", "most")  # nulls are passed over
    sizes = Stash(owned.df.join(probed, "key", "left").where(mixed).select("key", n.alias("n")), "sizes")
    dealt = own.withColumn("own", F.lit(True)).unionByName(hits.withColumn("own", F.lit(False))).drop("at")
    # a node gets its fingerprint once, with a list of its buckets; in the buckets it rides along, so that their join gives close pairs only
    listed = matched(dealt, sizes.df, ["key"], "n").groupBy("node").agg(F.collect_list(F.struct("key", "own", "n")).alias("held"), F.sum("n").alias("weight"))
    kept = Stash(listed.join(asked.select("node", "at", "_fp"), "node"), "members")
    for done in (owned, *found, sizes):
        done.drop()
    bucket = F.explode("held").alias("h")
    crowd = kept.df.select("node", "weight", "at", bucket).where(F.col("h.n") > crowded).select("node", "weight", "at", "h.key")
    links = stash(links.unionByName(_nearest(texts, kept.df, crowd, True)), "links")
    # which buckets have more than one component is told without fingerprints; those that have are listed by node again
    seen = _placed(_at(kept.df.select("node", "held"), links).select("node", "at", bucket).select("node", "at", "h.*"))
    left = seen.groupBy("node", "at").agg(F.collect_list(F.struct("key", "own", "n", "main")).alias("held"))
    mixed = Stash(left.join(kept.df.select("node", "_fp"), "node"), "mixed")
    kept.drop()
    placed = mixed.df.select("node", "at", "_fp", bucket).select("node", "at", "_fp", "h.*")
    many = F.col("n") > crowded
    salts = F.least(F.ceil(F.col("n") / 512), F.lit(64)).cast("int")  # a bucket of the usual size is one
    rest = placed.where("at <> main").select("key", "node", "own", "at", "_fp", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    every = placed.select("key", F.col("node").alias("other"), F.col("own").alias("owned"), F.col("at").alias("there"), F.col("_fp").alias("_other_fp"), many.alias("many"), F.pmod(F.hash("node"), salts).alias("salt"))
    pairs = rest.join(every, ["key", "salt"]).where(F.expr("at <> there and (own or owned or many)") & _close("_fp", "_other_fp", least))
    last = texts.similar(pairs.select(*_pair("node", "other")))
    mixed.drop()
    return connected_components(links.unionByName(last))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, crowded: int = 16) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (nulls last; of equal ids the first read).

    Texts are linked whose sets of shingles (width words, letters' size aside in ASCII, any white space between) have a
    Jaccard similarity of at least `least`; a text of fewer words is one shingle; texts without words, and null texts,
    are alike. Multi-index hashing of a wide SimHash proposes the pairs, distances over 576 bits, parity sketches and then the sets (64-bit
    hashes) decide; texts of equal sets are one node. Some three pairs in a thousand at a similarity of 0.8 are not proposed, above it
    fewer. Segments widen with the rows, from 24 bits to 32 and from 24 segments to 88, so that texts that aren't alike seldom share a bucket;
    beyond some 16 million rows they do more and more often (each is compared, none is lost). docs is counted first. An empty table stays empty. Columns are those of docs,
    whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_row"))
    text = F.col(f"_doc.`{text_col}`")
    rows = docs.count()
    printed = with_shingles(packed, text, width).withColumn("_s", _wide(segment_bits(rows))("_shingles"))
    with small_batches(docs.sparkSession, 200):
        tagged = stash(printed.select("_doc", "_id", "_row", F.col("_s.node").alias("_node"), F.col("_s.fp").alias("_fp"), F.col("_s.more").alias("_more"), F.col("_s.weak").alias("_weak")), "shingles")
    linked = lasting(lambda: _similar_groups(_Texts(tagged, text, width, least, rows), crowded), "linked")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    first = tagged.groupBy(F.col("_node").alias("node")).agg(F.min(order).alias("first"))
    stays = first.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("first").alias("first")).select(F.col("first.r").alias("_row"))
    return tagged.join(stays, "_row", "left_semi").select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
