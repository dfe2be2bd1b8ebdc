"""Removal of long repeated byte strings by distributed prefix doubling.

Ranks are given to positions of the texts: equal strings have equal ranks, and ranks stand in the order in which Spark
sorts pairs (rank of the shorter string, name of what the longer one adds; a name is a 64-bit hash of its 16-byte grams and their
places; the first strings are ranked by their names). Each round takes longer strings, positions leave when they are unique or settled, and
the rounds end at `length` bytes.

Which positions: a string of `length` bytes that starts in two places is found through the places that its own content
singles out ("anchors": positions whose GRAM bytes have the least hash in a window of WINDOW positions). The first window of
the string picks the same anchor in both, so strings at the same offset from anchors are compared and no others, and only at the anchor that
their own first window picks. For length 400 the strings compared have 136 bytes from the anchor (a set of bits tells the repeated ones), then
272 (the offset doubles), and then, as the next doubling would pass the threshold, 385, 397 and 400 bytes that also reach back from the
anchor: all 128 starts before an anchor share the 272 bytes, 16 neighbouring ones 385, 4 of them 397.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import Stash, bits_of, freed_memory, matched, stash
from auditloom.llm.passages import KEY_BITS, mixed, of_run, run_sums, shared_words, slide

GRAM = 16
WINDOW = 128
PIECE = 1 << 17
#: Neighbouring starts that are judged as a whole; undecided groups split to the next size.
NODES = (WINDOW, 16, 4, 1)
#: Stands for all words of a text that has copies.
ALL = (1 << 31) - 1


def _grams(joined: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; none is zero."""
    first, second = (np.ndarray((max(len(joined) - GRAM + 1, 0),), "<u8", joined, k, (1,)) for k in (0, 8))
    h = first * np.uint64(0x9E3779B97F4A7C15) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h |= np.uint64(1)  # zero marks windows over an end
    return h


def _anchored(texts: list[bytes], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All anchors, about PIECE bytes of texts at a time: (texts' numbers, positions in the text, the same in what was read together, its grams).
    Anchors are all positions whose gram has the least hash in some window of WINDOW positions, ties too. Long texts are read in overlapping pieces: each
    tells the anchors in PIECE positions of its own, and has the WINDOW - 1 bytes before them and `reach` bytes from each on. Windows over an end don't count."""
    window = WINDOW + GRAM - 1
    pieces = [(n, lo, max(lo - WINDOW + 1, 0)) for n, text in enumerate(texts) if len(text) >= window for lo in range(0, len(text) - GRAM + 1, PIECE)]
    begin = 0
    while begin < len(pieces):
        end, size, some = begin, 0, []
        while end < len(pieces) and size < PIECE:
            n, lo, first = pieces[end]
            some.append(texts[n][first : lo + PIECE + max(reach, window)])
            size += len(some[-1])
            end += 1
        ends = np.cumsum([len(x) for x in some])
        h = _grams(b"".join(some))
        low = slide(h, WINDOW, np.minimum)
        for e in ends[:-1].tolist():
            low[max(e - window + 1, 0) : e] = 0
        edge = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(slide(np.concatenate([edge, low, edge]), WINDOW, np.maximum) == h)
        piece = np.searchsorted(ends, at, side="right")
        n, lo, first = np.array(pieces[begin:end]).T[:, piece]
        there = at - np.append(0, ends)[piece] + first
        own = (there >= lo) & (there < lo + PIECE)
        yield n[own], there[own], at[own], h
        begin = end


def anchors(texts: list[bytes]) -> list[np.ndarray]:
    """For each text all positions whose gram has the least hash in some window of WINDOW positions."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in texts]
    for n, there, _, _ in _anchored(texts, 0):
        for k in np.unique(n).tolist():
            found[k].append(there[n == k])
    return [np.concatenate(some) for some in found]


def _alone(row: np.ndarray, at: np.ndarray, lo) -> np.ndarray:
    """The names of what lies around strings at a text's edge, which no other node has."""
    return mixed(mixed(row.astype(np.uint64)) ^ (at.astype(np.uint64) << np.uint64(8)) ^ np.asarray(lo, np.uint64))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0xC2B2AE3D27D4EB4F) + second)


def _texts(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(v.as_buffer()) for v in column)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, so that the joins that bring them to their positions move less, their size and hash."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        whole = [v.as_buffer().to_pybytes() for v in batch.column(2)]
        more = [pa.array([pack(t) for t in whole], pa.binary()), pa.array([len(t) for t in whole], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in whole])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["row", "_id", "packed", "n_bytes", "sha"])


def _tell(length: int):
    """Per anchor: the names of the first half of the core, of what its second half adds, and of what lies around it in the strings that
    begin in the WINDOW positions up to the anchor."""
    half = (length - WINDOW) // 2
    names = ["row", "at", "near", "next", "wings"]

    def told(rows: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts])
        for n, there, at, h in _anchored(texts, length):
            fits = there - np.minimum(there, WINDOW - 1) + length <= sizes[n]
            n, there, at = n[fits], there[fits], at[fits]
            sums = run_sums(h)
            near, core = (at + k - GRAM + 1 for k in (half, 2 * half))
            whole = (there >= WINDOW - 1) & (there + length <= sizes[n])
            wings = _alone(rows[n], there, 0)
            a = at[whole]
            wings[whole] = _pair(of_run(sums, a - WINDOW + 1, a), of_run(sums, core[whole], a + length - GRAM + 1))
            columns = [pa.array(rows[n]), pa.array(there.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (of_run(sums, at, near), of_run(sums, near, core), wings))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed_memory():
            for batch in batches:
                rows, lo, size, some = batch.column(0).to_numpy(), 0, 0, []
                for n, text in enumerate(_texts(batch.column(1)), 1):
                    some.append(text)
                    size += len(text)
                    if size >= PIECE or n == len(rows):
                        yield from told(rows[lo:n], some)
                        lo, size, some = n, 0, []

    return run, "row bigint, at int, near bigint, next bigint, wings bigint"


def _contexts(length: int):
    """The bytes around each listed anchor that its strings can reach: WINDOW - 1 before it, length after it."""
    schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("mid", pa.int32()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for row, text, listed in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for a in listed:
                    lo = max(0, a - WINDOW + 1)
                    for name, v in zip(schema.names, (row, a, a - lo, text[lo : a + length]), strict=True):
                        out[name].append(v)
                if len(out["row"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out = {f.name: [] for f in schema}
            yield pa.RecordBatch.from_pydict(out, schema)

    return run, "row bigint, at int, mid int, around binary"


def _nodes(length: int, size: int):
    """Rows (row, at, mid, around, los, ranks): each lo begins a node of the size before, with its rank. Each part of it gets the names of
    what its core adds to that node's core (and of its lo), and of what lies around its core. A part is left out if it has no string that lies in
    the text and whose first window has its least gram at the anchor: another anchor tells such strings, in all their places."""
    before = NODES[NODES.index(size) - 1]
    shorter = length - before + (before < WINDOW)
    back, parts = np.arange(WINDOW), np.arange(before // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                row, at, mid = (part.column(i).to_numpy().astype(np.int64) for i in range(3))
                around = part.column(3).to_pylist()
                ends = np.cumsum([len(x) for x in around])
                begins = np.append(0, ends[:-1])
                h = _grams(b"".join(around))
                sums, low, mids = run_sums(h), slide(h, WINDOW, np.minimum), begins + mid
                starts = mids[:, None] - back
                fits = (starts >= begins[:, None]) & (starts + length <= ends[:, None])
                fits[fits] = low[starts[fits]] == np.broadcast_to(h[mids][:, None], fits.shape)[fits]
                wanted = fits.reshape(len(row), -1, size).any(axis=2)
                of = np.repeat(np.arange(len(row)), part.column(4).value_lengths().to_numpy())
                first, rank = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (4, 5))
                some, k = np.nonzero(wanted[of[:, None], first[:, None] // size + parts])
                n, rank, lo, held = of[some], rank[some], first[some] + k * size, mids[of[some]] - first[some]
                near = mids[n] - lo
                far = near - size + 1
                core = far + length - GRAM + 1
                name = _pair(_pair(of_run(sums, near, held), of_run(sums, held + shorter - GRAM + 1, core)), lo.astype(np.uint64))
                wings = _alone(row[n], at[n], lo)
                whole = (far >= begins[n]) & (near + length <= ends[n])
                wings[whole] = _pair(of_run(sums, far[whole], near[whole]), of_run(sums, core[whole], near[whole] + length - GRAM + 1))
                arrays = [row[n], at[n].astype(np.int32), lo.astype(np.int32), rank, name.view(np.int64), wings.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["row", "at", "lo", "rank", "name", "wings"])

    return run, "row bigint, at int, lo int, rank bigint, name bigint, wings bigint"


def _judge(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (row, at, lo, rank, name, wings): the ranges (row, first, last) of those nodes that are whole (what lies around their core repeats too), and
    those that have to be split, with the rank of their core: of each kind of nodes (equal cores and equal surroundings) one, if the
    core has several kinds. So all kinds meet in the parts, and the others of a whole kind need no parts."""
    core, kind = ["rank", "name"], ["wings", "name", "rank"]
    kinds = Stash(rows.groupBy(*kind).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("row", "at", "lo"))), "kinds")  # three columns of one row
    start = F.col("at") - F.col("lo")
    whole = stash(matched(rows, kinds.df.where("n > 1").select(*kind, "n"), kind, "n", hashed=True).select("row", (start - size + 1).alias("first"), start.alias("last")), "whole")
    split = None
    if size > 1:
        several = kinds.df.groupBy(*core).agg(F.count("*").alias("kinds")).where("kinds > 1")
        ranks = Stash(several.sort(*core).withColumn("new", F.monotonically_increasing_id()), "ranks")
        split = stash(matched(kinds.df, ranks.df, core, "kinds", hashed=True).select("row", "at", "lo", F.col("new").alias("rank")), "split")
        ranks.drop()
    kinds.drop()
    return whole, split


def repeated_starts(texts: DataFrame, length: int) -> DataFrame:
    """(row, first, last): ranges of positions at which a string of length bytes starts that also starts elsewhere;
    texts has (row, packed). All such positions are covered; ranges may overlap.

    A node is a group of neighbouring starts before an anchor. If the span that covers all of its strings repeats, all of
    its starts do; if the core that they share doesn't, none does; else the node is split. length must be at least
    2 * WINDOW + GRAM and even; else ValueError.
    """
    if WINDOW + GRAM > length - WINDOW or length % 2:
        raise ValueError(f"length must be even and at least {2 * WINDOW + GRAM}")
    run, schema = _tell(length)
    told = Stash(texts.select("row", "packed").mapInArrow(run, schema), "anchors")
    repeated = Stash(told.df.groupBy("near").count().where("count > 1").select("near"), "near")
    there = texts.sparkSession.sparkContext.broadcast(bits_of(repeated.df, "near", KEY_BITS, each=32))
    repeated.drop()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed_memory():
            for batch in batches:
                yield batch.filter(pa.array(there.value.has(batch.column(2).to_numpy())))

    pairs = told.df.mapInArrow(known, schema).select("row", "at", F.lit(0).alias("lo"), F.col("near").alias("rank"), F.col("next").alias("name"), "wings")
    held = Stash(pairs, "pairs")
    there.unpersist()
    told.drop()
    contexts, found = None, []
    for size, smaller in zip(NODES, (*NODES[1:], None), strict=True):
        whole, split = _judge(held.df, size)
        held.drop()
        found.append(whole)
        if smaller is None:
            break
        if contexts is None:
            listed = split.groupBy("row").agg(F.collect_list("at").alias("listed"))  # one document's own
            run, schema = _contexts(length)
            contexts = stash(texts.select("row", "packed").join(listed, "row").select("row", "packed", "listed").mapInArrow(run, schema), "contexts")
        parts = split.groupBy("row", "at").agg(F.collect_list(F.struct("lo", "rank")).alias("parts"))
        run, schema = _nodes(length, smaller)
        opened = contexts.join(parts, ["row", "at"]).select("row", "at", "mid", "around", F.col("parts.lo"), F.col("parts.rank"))
        held = Stash(opened.mapInArrow(run, schema), "nodes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(length: int, passage: int, schema: pa.Schema):
    """Per text (row's id, packed, n_bytes, sha, starts as first * 2^32 + last, shared words): removed bytes, runs, what is left, and shared words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, counts, froms, tos, shas, kept = [], [], [], [], [], []
            for text, sha, starts in zip(_texts(batch.column(1)), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if not starts.is_valid:
                    removed.append(0)
                    counts.append(0)
                    shas.append(sha)
                    kept.append(text.decode(errors="replace"))
                    continue
                pairs = np.sort(starts.values.to_numpy())
                lo, hi = pairs >> 32, np.maximum.accumulate((pairs & 0xFFFFFFFF) + length)
                new = np.append(True, lo[1:] > hi[:-1])
                lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                left = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                removed.append(len(text) - len(left))
                counts.append(len(lo))
                froms.append(lo)
                tos.append(hi)
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode(errors="replace"))
            ends = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (froms, tos)]
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays(ends, ["start", "end"]))
            shared = batch.column(5).to_pylist()
            for n, text in enumerate(_texts(batch.column(1))) if ALL in shared else ():
                if shared[n] == ALL:
                    shared[n] = words if (words := len(text.split())) >= passage else 0
            columns = [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), spans, pa.array(shas, pa.string()), pa.array(kept, pa.string()), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int = 50) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, spans (start, end in bytes), kept_sha256 of the rest, the rest as
    kept_text (bytes of a character that was cut through are replaced by U+FFFD there), and n_shared_words: how many words of the whole text lie in
    passages of `passage` words that another row has too, whatever their bytes and the white space between; these are told, not removed.

    Removed is each byte covered by a string of length bytes that starts in at least one other place, of the
    same or another document. Null texts are empty; texts shorter than length lose nothing; repeated rows are
    places of their own, so copies of at least length bytes vanish whole (one of them stands for all in the search).
    Ids may be null or repeat. Other columns are ignored; an empty table gives an empty result. length must be even
    and at least 272.
    """
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = whole.schema["_id"]
    kind = T.StructType([T.StructField("row", T.LongType()), known, T.StructField("packed", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.StringType())])
    texts = stash(whole.mapInArrow(_pack, kind), "texts")
    worded = texts.where(F.col("n_bytes") >= min(length, 2 * passage - 1))  # of fewer bytes a text has no passage
    groups = stash(worded.groupBy("sha").agg(F.min("row").alias("first_row"), F.count("*").alias("n")), "groups")
    others = Stash(worded.select("row", "packed", "n_bytes").join(groups.select(F.col("first_row").alias("row")), "row"), "others")
    starts = repeated_starts(others.df.where(F.col("n_bytes") >= length), length)
    copies = stash(matched(worded.select("row", "sha", "n_bytes"), groups.where("n > 1").select("sha", "n"), ["sha"], "n").select("row", "n_bytes"), "copies")
    starts = starts.unionByName(copies.where(F.col("n_bytes") >= length).select("row", F.lit(0).alias("first"), (F.col("n_bytes") - length).alias("last")))
    shared = shared_words(others.df, passage).unionByName(copies.select("row", F.lit(ALL).cast("bigint").alias("n_shared")))
    others.drop()
    shared = shared.groupBy("row").agg(F.max("n_shared").alias("n_shared"))
    told = starts.groupBy("row").agg(F.collect_list(F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("last")).alias("starts"))
    fields = [known, *(T.StructField(c, t) for c, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()), ("n_shared_words", T.LongType())))]
    joined = texts.join(told, "row", "left").join(shared, "row", "left").select("_id", "packed", "n_bytes", "sha", "starts", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return joined.mapInArrow(_cut(length, passage, [f.name for f in fields]), T.StructType(fields)).withColumnRenamed("_id", id_col)
