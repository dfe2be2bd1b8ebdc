"""Rate windows that open with a key's first request, for keys of any size.

Where a window begins depends on where the one before it did, so a key's windows are a chain: from a request at s to the first
one after s + length. Requests are sorted in ranges over all tasks and cut into blocks. A key that lies within a block is
counted there. For the others each block is boiled down to what it does to a chain that enters it: from which request on, which
window is open at its end. Neighbouring blocks are composed, pairs of pairs and so on (up), the key's first request then tells
each block which window is open at its beginning (down), and every block counts its own requests."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.checkpoints import checkpointed

#: Requests of a block.
BLOCK = 1 << 17

#: The window that is open when no request has come yet.
NEVER = -(1 << 62)


def jumps(ms: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For a window that opens at each request of a sorted block: the request that opens the next one (the number of requests if
    none does), and the request that opens the block's last one. Jumps double until all have arrived."""
    following = np.searchsorted(ms, ms + length, side="right")
    last = np.where(following < len(ms), following, np.arange(len(ms)))
    while True:
        further = last[last]
        if (further == last).all():
            return following, last
        last = further


def counted(ms: np.ndarray, length: int, ends: int = NEVER, before: int = 0) -> np.ndarray:
    """Each request's number in its window, for a sorted block that a window open until `ends` enters, with `before` requests so far."""
    following = np.searchsorted(ms, ms + length, side="right").tolist()
    at = int(np.searchsorted(ms, ends, side="right"))
    starts = []
    while at < len(ms):
        starts.append(at)
        at = following[at]
    counts = np.arange(1, len(ms) + 1)
    opened = np.repeat(np.array([-before, *starts]), np.diff([0, *starts, len(ms)]))
    return counts - opened


def _counted_keys(ms: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The same for whole keys one after the other, which begin at `starts`: set so far apart that no window reaches the next."""
    apart = int(ms.max() - ms.min()) + length + 1
    number = np.zeros(len(ms), np.int64)
    number[starts[1:]] = 1
    return counted(np.cumsum(number) * apart + (ms - ms.min()), length)


def _cut(rows: DataFrame, length: int, block: int) -> DataFrame:
    """rows (key, ident, ms), sorted by ranges: those of keys that lie whole in a block with their count, the others with the number of
    their block, which grows along the key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_key, last_key = True, None  # whether rows of last_key have gone out, or may lie in the partition before

        def out(table: pa.Table, starts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not len(table):
                return
            whole = starts is not None
            count = pa.array(_counted_keys(table["ms"].to_numpy(), starts, length)) if whole else pa.nulls(len(table), pa.int64())
            blocks = pa.nulls(len(table), pa.int64()) if whole else pa.array(np.full(len(table), number))
            number += not whole
            yield from table.append_column("block", blocks).append_column("count", count).combine_chunks().to_batches(max_chunksize=1 << 15)

        def empty(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Sends out what is whole or full; the table that comes last stays."""
            nonlocal open_key, last_key
            keys = table["key"].combine_chunks()
            codes = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            goes_on = open_key and (last_key is None or last_key[0] == keys[0].as_py())
            if len(starts) == 1:
                if final or len(table) >= block:
                    yield from out(table, None)
                    open_key, last_key, table = True, (keys[0].as_py(),), table.slice(0, 0)
                else:
                    open_key = goes_on
            else:
                lo, hi = int(starts[1]) if goes_on else 0, int(starts[-1])
                yield from out(table.slice(0, lo), None)
                yield from out(table.slice(lo, hi - lo), starts[(starts >= lo) & (starts < hi)] - lo)
                open_key, table = False, table.slice(hi)
                if final:
                    yield from out(table, None)
            yield table

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if len(held) >= block:
                *done, held = empty(held, final=False)
                yield from done
        if held is not None and len(held):
            *done, _ = empty(held, final=True)
            yield from done

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(scan, f"key {kinds['key']}, ident {kinds['ident']}, ms bigint, block bigint, count bigint")


_MOVES = "chain bigint, at bigint, ms bigint, ends bigint, opened bigint"


def _moves(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """What a block does to a chain that enters it: for each request that can be the first to open a window here, until when the
    last window is open and which request of the key opened it. Windows that enter were opened before the block's first request."""
    pdf = pdf.sort_values("ms", kind="stable")
    ms = pdf["ms"].to_numpy()
    _, last = jumps(ms, length)
    n = min(int(np.searchsorted(ms, ms[0] + length, side="right")) + 1, len(ms))
    _, some = np.unique(ms[:n], return_index=True)
    return pd.DataFrame({"chain": pdf["chain"].iloc[0], "at": pdf["at"].iloc[0], "ms": ms[some], "ends": ms[last[some]] + length, "opened": pdf["offset"].iloc[0] + last[some]})


def _follow(ends: np.ndarray, opened: np.ndarray, moves: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where windows are open after a block, given until when they are before it."""
    if not len(moves):  # beyond the key's last block
        return ends, opened
    first = np.searchsorted(moves["ms"].to_numpy(), ends, side="right")
    inside = first < len(moves)
    at = np.minimum(first, len(moves) - 1)
    return np.where(inside, moves["ends"].to_numpy()[at], ends), np.where(inside, moves["opened"].to_numpy()[at], opened)


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two neighbours as one; one without a neighbour stays."""
    pdf = pdf.sort_values(["at", "ms"])
    odd = pdf["at"] % 2 == 1
    left, right = pdf[~odd].copy(), pdf[odd]
    if len(right):
        left["ends"], left["opened"] = _follow(left["ends"].to_numpy(), left["opened"].to_numpy(), right)
    left["at"] //= 2
    return left


def _handed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The window that is open before a pair is so before its left half; the left half's moves tell the right one's. A row without
    ms is the window before the pair."""
    given = pdf[pdf["ms"].isna()]
    moves = pdf[pdf["ms"].notna()].sort_values("ms")
    ends, opened = _follow(given["ends"].to_numpy(), given["opened"].to_numpy(), moves)
    left = given.assign(at=given["at"] * 2)
    return pd.concat([left, left.assign(at=left["at"] + 1, ends=ends, opened=opened)])


def anchored_counts(events: DataFrame, key: str, when: str, ident: str, window_ms: int, block: int = BLOCK) -> DataFrame:
    """(key, ident, count): each request's number in its window. A key's window opens with its first request and ends window_ms
    later; the first request strictly after that opens the next. Requests count in the order of time, then ident.

    Null keys are one key; repeated rows count each; requests without a time are left out; an empty table stays empty. No task holds
    more than a few blocks, whatever a key's share; the rounds grow with the logarithm of the largest key's blocks."""
    rows = events.select(F.col(key).alias("key"), F.col(ident).alias("ident"), F.unix_millis(F.col(when).cast("timestamp")).alias("ms")).where("ms is not null")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "key", "ms", "ident").sortWithinPartitions("key", "ms", "ident")
    cut = checkpointed(_cut(ranged, window_ms, block))
    done = cut.where("count is not null").select("key", "ident", "count")
    rest = cut.where("count is null")
    # few rows: the blocks of keys that lie in several, numbered along each key
    along = W.partitionBy("key").orderBy("block")
    blocks = rest.groupBy("key", "block").agg(F.count("*").alias("n"))
    named = blocks.withColumns({"chain": F.min("block").over(W.partitionBy("key")), "at": (F.row_number().over(along) - 1).cast("bigint"), "offset": F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    placed = rest.join(named.select("block", "chain", "at", "offset"), "block")
    levels = [checkpointed(placed.select("chain", "at", "offset", "ms").groupBy("chain", "at").applyInPandas(lambda pdf: _moves(pdf, window_ms), _MOVES))]
    top = levels[0].agg(F.max("at")).first()[0] or 0
    while top >> (len(levels) - 1):
        levels.append(checkpointed(levels[-1].withColumn("pair", F.shiftright("at", 1)).groupBy("chain", "pair").applyInPandas(lambda pdf: _composed(pdf[["chain", "at", "ms", "ends", "opened"]]), _MOVES)))
    window = levels[-1].select("chain", F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("ms"), F.lit(NEVER).alias("ends"), F.lit(0).cast("bigint").alias("opened")).distinct()
    for moves in reversed(levels[:-1]):
        left = moves.where("at % 2 = 0").select("chain", F.shiftright("at", 1).alias("at"), "ms", "ends", "opened")
        window = checkpointed(window.unionByName(left).groupBy("chain", "at").applyInPandas(_handed, _MOVES))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    told = window.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in ("key", "ident")], F.lit(None).cast("bigint").alias("ms"), "chain", "at", F.lit(0).cast("bigint").alias("offset"), "ends", "opened")
    asked = placed.select("key", "ident", "ms", "chain", "at", "offset", F.lit(None).cast("bigint").alias("ends"), F.lit(None).cast("bigint").alias("opened"))

    def count(table: pa.Table) -> pa.Table:
        known = pc.is_valid(table["ms"])
        entering, own = table.filter(pc.invert(known)), table.filter(known)
        own = own.sort_by([("ms", "ascending"), ("ident", "ascending")])
        if not len(own):
            return pa.table({"key": own["key"], "ident": own["ident"], "count": pa.array([], pa.int64())})
        ends, opened = entering["ends"][0].as_py(), entering["opened"][0].as_py()
        counts = counted(own["ms"].to_numpy(), window_ms, ends, own["offset"][0].as_py() - opened)
        return pa.table({"key": own["key"], "ident": own["ident"], "count": pa.array(counts)})

    late = asked.unionByName(told).groupBy("chain", "at").applyInArrow(count, f"key {kinds['key']}, ident {kinds['ident']}, count bigint")
    return done.unionByName(late)
