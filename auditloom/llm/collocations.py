"""Phrases whose words go together more than by chance, counted with word suffix arrays."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditloom.llm.common import Stash, bits_of

#: Between words, between pieces, and what both hold.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.full(256, 2, np.uint8)
_KIND[list(GAPS)], _KIND[list(BREAKS)] = 0, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a text that are taken apart at a time, and words of a shard.
SLICE, SHARD = 1 << 22, 1 << 20


def slices(text: bytes) -> Iterator[bytes]:
    """The text in slices that end behind a gap or break, where one is near; so no word is cut but one longer than a slice,
    which comes whole."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text):
            behind = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, min(SLICE, len(text) - end), end)] < 2)
            if len(behind):
                end += int(behind[0]) + 1
                break
            end = min(end + SLICE, len(text))
        yield text[at:end]
        at = end
    yield text[at:]


class Shard:
    """The words of one language, until they are counted: their bytes and before which a piece begins."""

    def __init__(self, most: int):
        self.most, self.words, self.begins, self.size = most, [], [], 0

    def add(self, text: bytes) -> None:
        """A text, or the next slice of it where one has been added without end()."""
        buf = np.frombuffer(text, np.uint8)
        kind = _KIND[buf]
        word = np.zeros(len(buf) + 2, bool)
        word[1:-1] = kind == 2
        starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        broken = np.cumsum(kind == 1, dtype=np.int32)
        if len(starts):
            offsets = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(ends - starts, out=offsets[1:])
            self.words.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[buf[word[1:-1]]])]))
            piece = broken[starts]
            begins = np.empty(len(starts), bool)
            begins[0], begins[1:] = self.apart or piece[0] > 0, piece[1:] > piece[:-1]
            self.begins.append(begins)
            self.size += len(starts)
            self.apart = bool(broken[-1] > piece[-1])
        elif len(buf):
            self.apart = self.apart or bool(broken[-1])

    apart = True

    def end(self) -> None:
        self.apart = True

    def take(self, last: bool) -> "Suffixes | None":
        """The suffixes of all words so far. Unless last, those of the words at the end that may go on are left for the next call."""
        if not self.size:
            return None
        words = pa.concat_arrays(self.words).dictionary_encode()
        ids, begins = words.indices.to_numpy().astype(np.int64), np.concatenate(self.begins)
        kept = 0 if last else min(self.most - 1, len(ids))
        tail = words.dictionary.take(pa.array(ids[len(ids) - kept :]))
        self.words, self.begins, self.size = ([tail], [begins[len(ids) - kept :]], kept) if kept else ([], [], 0)
        return Suffixes(ids, begins, words.dictionary, self.most, len(ids) - kept)


class Suffixes:
    """Suffix array of word ids, where a suffix ends with its piece, sorted by its first `most` words, of the first `limit` positions."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, dictionary: pa.Array, most: int, limit: int):
        self.ids, self.dictionary, self.most, self.limit = ids, dictionary, most, limit
        ends = np.append(np.flatnonzero(begins)[int(begins[0]) :], len(ids))
        self.depth = np.minimum(ends[np.searchsorted(ends, np.arange(len(ids)), side="right")] - np.arange(len(ids)), most)  # words until the piece ends

    def sorted_to(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, ranks): prefix doubling, each round by pairs of the rank so far and that of what follows (0 where the
        piece ends), the last round's halves overlapping where the length is no power of two."""
        n = len(self.ids)
        rank, known = self.ids, 1
        order = np.argsort(rank) if length == 1 else None
        while known < length:
            step = min(known, length - known)
            follows = np.zeros(n, np.int64)
            on = np.flatnonzero(self.depth > step)
            follows[on] = rank[on + step] + 1
            pair = rank * (follows.max() + 1) + follows
            order = np.argsort(pair)
            new = np.empty(n, np.int64)
            found = pair[order]
            new[order] = np.cumsum(np.append(0, found[1:] != found[:-1]))
            rank, known = new, known + step
        return order, rank

    def intervals(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to this one (m, a position of each distinct phrase of m words, how often it occurs): the LCP intervals
        of at least m, which are the runs of neighbours that agree in m words. Only phrases that begin before limit count."""
        order, _ = self.sorted_to(length)
        order = order[order < self.limit]
        if not len(order):
            return
        agree = np.zeros(len(order), np.int64)  # the LCP with the neighbour before
        same = np.ones(len(order) - 1, bool)
        for j in range(length):
            a, b = order[1:], order[:-1]
            same &= (self.depth[a] > j) & (self.depth[b] > j)
            at = np.flatnonzero(same)
            same[at] = self.ids[a[at] + j] == self.ids[b[at] + j]
            agree[1:] += same
        for m in range(1, length + 1):
            starts = np.flatnonzero(agree < m)
            counts = np.diff(np.append(starts, len(order)))
            deep = self.depth[order[starts]] >= m
            yield m, order[starts][deep], counts[deep]

    def pair_hashes(self, seed: str) -> np.ndarray:
        """64 bits of the two words at each position, alike in all shards; meaningless where the piece ends."""
        word = np.array([xxhash.xxh64_intdigest(w, 7) for w in (v.as_buffer().to_pybytes() for v in self.dictionary)], np.uint64)[self.ids]
        mixed = (word * np.uint64(0x9E3779B97F4A7C15)) ^ (np.append(word[1:], np.uint64(0)) + np.uint64(xxhash.xxh64_intdigest(seed.encode(), 8)))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        words = [self.dictionary.take(pa.array(self.ids[at + j])).cast(pa.string()) for j in range(length)]
        return words[0] if length == 1 else pc.binary_join_element_wise(*words, " ")


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, Suffixes]]:
    """The partition's words in shards by language."""
    shards: dict[str, Shard] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            shard = shards.setdefault(lang.as_py(), Shard(most))
            for part in slices(text.as_buffer().to_pybytes()):
                shard.add(part)
                if sum(s.size for s in shards.values()) >= SHARD:
                    for name, full in shards.items():
                        if found := full.take(last=False):
                            yield name, found
            shard.end()
    for name, rest in shards.items():
        if found := rest.take(last=True):
            yield name, found


def _parts(*columns: pa.Array, rows: int = 1 << 16) -> Iterator[tuple[pa.Array, ...]]:
    for lo in range(0, len(columns[0]), rows):
        yield tuple(c.slice(lo, rows) for c in columns)


def phrase_counts(docs: DataFrame, most: int = 3, at_least: int = 10, text_col: str = "text", lang_col: str = "lang", most_bits: int = 28) -> DataFrame:
    """(lang, phrase, words, n): every phrase of up to `most` words that occurs at_least times, and for each language a row of
    zero words (phrase null) with the number of its words.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and these into words at spaces and tabs; phrases
    lie within pieces. Null texts count as empty, a null language as `und`; an empty table gives no rows.

    Each task sorts shards of a million words into suffix arrays; phrases are their LCP intervals. The first pass counts
    hashes of word pairs only, and a bounded set of bits tells which may be frequent. The second counts the phrases as such,
    longer ones only if all their pairs may be frequent; what the bits let through wrongly goes by its true count."""
    given = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _shards(batches, most):
            hashes = found.pair_hashes(lang)
            for m, at, counts in found.intervals(2):
                if m == 2:
                    for part in _parts(pa.array(hashes[at].view(np.int64)), pa.array(counts)):
                        yield pa.RecordBatch.from_arrays(list(part), ["hash", "n"])

    hashed = given.mapInArrow(pairs, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    frequent = Stash(hashed.where(F.col("n") >= at_least).select("hash"), "pairs")
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(frequent.df, "hash", most_bits))
    frequent.drop()

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "words", "n"]
        for lang, found in _shards(batches, most):
            may = shared.value.has(found.pair_hashes(lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([found.limit])], names)
            for m, at, counts in found.intervals(most):
                for j in range(m - 1):
                    ok = may[at + j]
                    at, counts = at[ok], counts[ok]
                for places, n in _parts(pa.array(at), pa.array(counts)):
                    rows = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * rows), found.phrases(places.to_numpy(), m), pa.array(np.full(rows, m, np.int32)), n], names)

    counted = given.mapInArrow(phrases, "lang string, phrase string, words int, n bigint").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= at_least) | (F.col("words") == 0))


def top_phrases(docs: DataFrame, most: int = 3, at_least: int = 10, covered_percent: int = 50, best: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    A phrase of at least two words is cut in two where that scores least, floor(1,000,000 a a / (l r)) with a, l and r the counts of
    the phrase and its two sides (of equal cuts the first); n counts all words of the language. A phrase that lies in a longer
    one of at least covered_percent of its count is left out. Products are decimals of 38 digits, enough for counts of 15.
    Ties go to the larger a, then to the lesser phrase in byte order. Repeated rows count as often as they come."""
    counts = Stash(phrase_counts(docs, most, at_least, text_col, lang_col), "phrases").df
    sides = counts.where("words > 0").select("lang", F.col("phrase").alias("side"), F.col("n").alias("f"))
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), "words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("right"))
    cuts = cuts.join(sides.withColumnsRenamed({"side": "left", "f": "l"}), ["lang", "left"]).join(sides.withColumnsRenamed({"side": "right", "f": "r"}), ["lang", "right"])
    big = "decimal(15,0)"
    score = F.expr(f"(cast(a as {big}) * cast(a as {big}) * 1000000bd) div (cast(l as {big}) * cast(r as {big}))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase within a candidate
    inner = candidates.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    longer = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    covered = F.col("longer").cast(big) * 100 >= F.col("a").cast(big) * covered_percent
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of many parts of each language, then of these
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= best)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
