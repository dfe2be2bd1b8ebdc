"""Words in passages that another document has too, told exactly (by 64-bit hashes of the words) without comparing all places.

Two texts that share `least` words in a row choose the same places in them: of the WINDOW first places of the passage those whose GRAM
words have the least hash ("anchors"). All `least` words that may begin up to there have the words from the anchor on in common (the core), so
only starts at anchors whose core is in two texts are compared. A set of bits tells which cores are; what it lets through besides is dropped by
the comparison.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Stash, bits_of, freed_memory, matched

GRAM, WINDOW = 4, 32
PIECE = 1 << 18
#: Of the set of bits that holds the repeated cores.
KEY_BITS = 29
_RANDOM = np.random.default_rng(8)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of width values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            both = (np.full(n, x & ((1 << 64) - 1), np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(x, dtype=np.uint64)]) for x in both)


_POWERS = _Powers()


def run_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, each times a power of its place; of_run() makes a run's hash of them."""
    _POWERS.grow(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _POWERS.up[: len(values)], dtype=np.uint64)])


def of_run(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[first]) * _POWERS.down[first])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of all texts, how many words come before each text and at last in all). Words are what lies between white space in ASCII."""
    joined = b"".join(t + b"\n" for t in texts)
    raw, at, starts, hashes = np.frombuffer(joined, np.uint8), 0, [], []
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while not len(gaps := np.flatnonzero(_SPACE[raw[at:end]])):  # a word longer than a piece
            end = min(end + PIECE, len(raw))
        part = raw[at : (end := at + int(gaps[-1]) + 1)]
        turns = np.diff((~_SPACE[part]).astype(np.int8), prepend=0)
        first, last = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        hashes.append(of_run(run_sums(_BYTES[part]), first, last))
        starts.append(first + at)
        at = end
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.searchsorted(np.concatenate([np.zeros(0, np.int64), *starts]), begins)


class _Places:
    """The anchors of some texts, as numbers of words over all of them."""

    def __init__(self, texts: list[bytes], least: int):
        words, self.bounds = word_hashes(texts)
        self.least, self.sums = least, run_sums(words)
        self.anchors = np.zeros(0, np.int64)
        if len(words) < least:
            return
        at = np.arange(len(words) - GRAM + 1)
        self.hashes = of_run(self.sums, at, at + GRAM) | np.uint64(1)  # zero marks starts after which a text ends too soon
        self.low = slide(self.hashes, WINDOW, np.minimum)
        for first, end in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            self.low[max(first, end - least + 1) : end] = 0
        edge = np.zeros(WINDOW - 1, np.uint64)
        self.anchors = np.flatnonzero(slide(np.concatenate([edge, self.low, edge]), WINDOW, np.maximum) == self.hashes)

    def cores(self) -> np.ndarray:
        return of_run(self.sums, self.anchors, self.anchors + self.least - WINDOW + 1).view(np.int64)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Those whose first WINDOW places have one of the chosen anchors."""
        some = self.anchors[chosen]
        at = some[:, None] - np.arange(WINDOW)
        fits = (at >= 0) & (at < len(self.low)) if len(some) else np.zeros(at.shape, bool)
        fits[fits] = (self.low[at[fits]] == np.broadcast_to(self.hashes[some][:, None], at.shape)[fits]) if fits.any() else False
        return np.unique(at[fits])

    def names(self, starts: np.ndarray) -> np.ndarray:
        return of_run(self.sums, starts, starts + self.least).view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, _Places]]:
    """Rows' numbers and their places, about PIECE bytes of texts at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows, some, size, lo = batch.column(0).to_numpy(), [], 0, 0
        for n, packed in enumerate(batch.column(1), 1):
            some.append(unpack(packed.as_buffer()))
            size += len(some[-1])
            if size >= PIECE or n == len(rows):
                yield rows[lo:n], _Places(some, least)
                some, size, lo = [], 0, n


def shared_words(texts: DataFrame, least: int) -> DataFrame:
    """(row, n_shared): how many words of a text lie in passages of `least` words that a text of another row has too; rows without such
    words are left out. texts, a written table, has (row, packed)."""
    if least < WINDOW + GRAM - 1:
        raise ValueError(f"least must be at least {WINDOW + GRAM - 1}")

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed_memory():
            for rows, places in _groups(batches, least):
                yield pa.RecordBatch.from_arrays([pa.array(rows[places.text_of(places.anchors)]), pa.array(places.cores())], ["row", "core"])

    span = [F.min("row").alias("low"), F.max("row").alias("high")]
    repeated = Stash(texts.select("row", "packed").mapInArrow(cores, "row bigint, core bigint").groupBy("core").agg(*span).where("low < high").select("core"), "cores")
    there = texts.sparkSession.sparkContext.broadcast(bits_of(repeated.df, "core", KEY_BITS, each=32))
    repeated.drop()

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with freed_memory():
            for rows, places in _groups(batches, least):
                at = places.starts(there.value.has(places.cores()))
                text = places.text_of(at)
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array((at - places.bounds[text]).astype(np.int32)), pa.array(places.names(at))], ["row", "at", "name"])

    starts = Stash(texts.select("row", "packed").mapInArrow(begun, "row bigint, at int, name bigint"), "begun")
    there.unpersist()
    several = Stash(starts.df.groupBy("name").agg(*span, F.count("*").alias("n")).where("low < high").select("name", "n"), "several")
    found = matched(starts.df, several.df, ["name"], "n", hashed=True).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("ats"))  # one document's own
    gaps = F.zip_with(F.slice("ats", 2, F.size("ats")), F.slice("ats", 1, F.size("ats") - 1), lambda b, a: F.least(b - a, F.lit(least)))
    out = Stash(found.select("row", (F.aggregate(gaps, F.lit(least), lambda s, x: s + x)).cast("bigint").alias("n_shared")), "shared")
    for done in (starts, several):
        done.drop()
    return out.df
