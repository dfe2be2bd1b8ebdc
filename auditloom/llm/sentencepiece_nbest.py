"""SentencePiece N-best encoding and exact decoding with a given vocabulary."""

import hashlib
import math
import re
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPACE = "▁"
CACHED_CHUNKS, KEPT, PART = 200_000, 64, 2_000_000
#: Chunks that are searched many at once, at most.
BATCH = 4000
UNREACHED, NONE, NO_KEY = -(1 << 62), 1 << 62, np.uint64(2**64 - 1)
#: Chunks up to these lengths are searched many at once, those of one range together.
TOGETHER = (8, 12, 24)
#: Scores are counted in millionths, as whole numbers, so that sums are exact and ties are real ties.
UNIT = 1_000_000


class Vocabulary:
    """Pieces with scores. The model file has merge ranks rather than probabilities, so a piece's score is its log
    probability by Zipf's law from its rank (its place among the ordinary pieces). A character without a piece
    falls back to its bytes, each scored below the rarest piece."""

    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        special = [p.is_byte(i) or p.is_control(i) or p.is_unknown(i) for i in range(n)]
        ordinary = [i for i in range(n) if not special[i]]
        total = math.log(sum(1 / (r + 1) for r in range(len(ordinary))))
        self.scores = {i: round(UNIT * (-math.log(r + 1) - total)) for r, i in enumerate(ordinary)}
        self.ids = {p.id_to_piece(i): i for i in ordinary}
        self.byte_ids = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.byte_score = min(self.scores.values()) - 2 * UNIT
        self.bytes_of: list[bytes] = [b""] * n
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece may have the space mark at its start only")
        # each piece with its score, which is below zero, and each beginning of one with zero
        self.table: dict[str, int] = {piece[:k]: 0 for piece in self.ids for k in range(1, len(piece))}
        self.table |= {piece: self.scores[i] for piece, i in self.ids.items()}
        self.ends: dict[str, int] = {piece[k:]: 0 for piece in self.ids for k in range(1, len(piece))}
        self.ends |= {piece: self.scores[i] for piece, i in self.ids.items()}
        self.chunk = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Chunks that are searched one by one, as no piece goes on over their ends: before a run of space marks,
        around line feeds, and, where the vocabulary has it so, between letters and other characters. Letters
        that a piece joins to others count as others."""
        letter, odd = re.compile(r"[^\W\d_]"), set()
        for piece in self.ids:
            word = piece.lstrip(SPACE)
            for a, b in zip(word, word[1:], strict=False):
                if (letter.match(a) is None) != (letter.match(b) is None):
                    odd.update(c for c in (a, b) if letter.match(c))
        letters = r"[^\W\d_" + "".join(re.escape(c) for c in sorted(odd)) + "]+"
        line = "" if any("\n" in piece for piece in self.ids) else "\n"
        others = f"(?:(?!{letters})[^{SPACE}{line}])+"
        return re.compile(f"{SPACE}*{letters}|{SPACE}*{others}|{SPACE}+" + (f"|{line}" if line else ""))

    def mark(self, text: str) -> str:
        """The text as the pieces see it: a space mark in front and for every space. A space mark of the text's
        own is none: it becomes a private character here, and bytes in the end."""
        return SPACE + text.replace("\ue000", "\ue000").replace(SPACE, "\ue000\ue001").replace(" ", SPACE)

    def forward(self, chunk: str) -> list[int]:
        """The Viterbi score of every beginning of the chunk."""
        look, n = self.table.get, len(chunk)
        best = [0] + [UNREACHED] * n
        i = 0
        while i < n:
            here, char = best[i], chunk[i]
            if char == "\ue000":  # a marked character and the one that tells which
                best[i + 2] = here + self._fallback(SPACE if chunk[i + 1] == "\ue001" else "\ue000")[1]
                i += 2
                continue
            j = i + 1
            if not look(char) and (score := here + self._fallback(" " if char == SPACE else char)[1]) > best[j]:
                best[j] = score
            while j <= n:
                got = look(chunk[i:j])
                if got is None:
                    break
                if got and here + got > best[j]:
                    best[j] = here + got
                j += 1
            i += 1
        return best

    def arcs_into(self, chunk: str, end: int) -> list[tuple[int, int]]:
        """The arcs that end there, as (start, score), the longest first. They are looked up when the backward search
        comes by, so a long chunk needs no more memory than its scores."""
        if end > 1 and chunk[end - 2] == "\ue000":
            return [(end - 2, self._fallback(SPACE if chunk[end - 1] == "\ue001" else "\ue000")[1])]
        look, arcs, start, char = self.ends.get, [], end - 1, chunk[end - 1]
        if not look(char):
            arcs.append((start, self._fallback(" " if char == SPACE else char)[1]))
        while start >= 0:
            score = look(chunk[start:end])
            if score is None:
                break
            if score:
                arcs.append((start, score))
            start -= 1
        arcs.reverse()
        return arcs

    def piece_ids(self, chunk: str, places: list[int]) -> array:
        """The ids of the pieces between neighbouring places."""
        found = array("i")
        for lo, hi in zip(places, places[1:], strict=False):
            piece = chunk[lo:hi]
            i = self.ids.get(piece)
            if i is not None:
                found.append(i)
            elif piece[0] == "\ue000":
                found.extend(self._fallback(SPACE if piece[1] == "\ue001" else "\ue000")[0])
            else:
                found.extend(self._fallback(" " if piece == SPACE else piece)[0])
        return found

    def _fallback(self, char: str) -> tuple[tuple[int, ...], int]:
        raw = tuple(self.byte_ids[b] for b in char.encode())
        return raw, self.byte_score * len(raw)


def search(vocabulary: Vocabulary, chunk: str, n: int) -> Iterator[tuple[int, array]]:
    """The n best segmentations of a chunk, best first, as (score, ids); equal scores stand in a fixed order.

    The forward Viterbi score of a prefix is an exact heuristic for the backward A* search, which adds it to the score
    of the suffix chosen so far. So paths leave the queue in the order of their scores, of equal ones the latest
    entry first. Entries of the queue stand for disjoint sets of paths, each with one of the score that it is
    queued by, so all but the best n can go."""
    best = vocabulary.forward(chunk)
    queue: list[tuple] = [(-best[-1], 0, len(chunk), 0, ())]
    made, room = 0, n
    while queue and room:
        _, _, at, score, after = queue.pop(0)
        after = (at, after)
        if at == 0:
            room -= 1
            places = []
            while after:
                at, after = after
                places.append(at)
            yield score, vocabulary.piece_ids(chunk, places)
            continue
        for start, more in vocabulary.arcs_into(chunk, at):
            cost = -(best[start] + more + score)
            if len(queue) < room or cost <= queue[-1][0]:
                made -= 1
                insort(queue, (cost, made, start, score + more, after))
                del queue[room:]


def first(vocabulary: Vocabulary, chunk: str) -> tuple[int, array, int]:
    """(score, ids, loss of the next best) of the first that search finds; the loss is NONE where there is no other.

    On its way back along the best path the search queues each arc that leaves the path, by its exact score, so the
    best of these is the second."""
    best, arcs_into = vocabulary.forward(chunk), vocabulary.arcs_into
    at = len(chunk)
    total, second, after, places = best[at], UNREACHED, 0, [at]
    while at:
        top, where, step = UNREACHED, 0, 0
        for start, more in arcs_into(chunk, at):
            value = best[start] + more
            if value >= top:
                value, top, where, step = top, value, start, more
            if value > UNREACHED and value + after > second:
                second = value + after
        at, after = where, after + step
        places.append(at)
    places.reverse()
    return total, vocabulary.piece_ids(chunk, places), total - second if second != UNREACHED else NONE


class Trie:
    """The pieces letter by letter, as arrays that many chunks walk at once. Node 0 is the beginning; the step from a node by a
    character is found in an open-addressing table."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        starts = sorted({piece[:k] for piece in vocabulary.ids for k in range(len(piece) + 1)})
        node = {start: i for i, start in enumerate(starts)}
        self.scores = np.array([vocabulary.table.get(start, 0) for start in starts], np.int64)
        self.ids = np.array([vocabulary.ids.get(start, -1) for start in starts], np.int32)
        self.longest = max(map(len, starts))
        steps = np.array([node[x[:-1]] << 21 | ord(x[-1]) for x in starts[1:]], np.uint64)
        bits = int(len(steps) * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, NO_KEY, np.uint64), np.zeros(1 << bits, np.int32)
        slots, todo = self._slots(steps), np.arange(len(steps))
        while len(todo):
            free = todo[self.keys[slots[todo]] == NO_KEY]
            _, one = np.unique(slots[free], return_index=True)
            placed = free[one]
            self.keys[slots[placed]], self.targets[slots[placed]] = steps[placed], placed + 1
            todo = np.setdiff1d(todo, placed)
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes one character on, or -1."""
        keys = nodes.astype(np.uint64) << np.uint64(21) | chars.astype(np.uint64)
        slots, out, todo = self._slots(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(todo):
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.targets[slots[todo[hit]]]
            todo = todo[~hit & (there != NO_KEY)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return out

    def first(self, chunks: list[str]) -> list[tuple[int, bytes, int] | None]:
        """What the function first says of each chunk, all at once; None where the best path has a character without a piece.

        Forward, position by position, the Viterbi scores of all chunks; the score of the piece of d characters from
        a position stays in arcs. Then all chunks walk back together along their best paths."""
        n, width = np.array([len(c) for c in chunks]), max(map(len, chunks))
        # by position first, so that what one step touches lies together
        chars = np.ascontiguousarray(np.array(chunks, f"<U{width}").view(np.uint32).reshape(len(chunks), width).T)
        deep = min(width, self.longest)
        arcs, pieces = (np.zeros((width, deep + 1, len(chunks)), t) for t in (np.int64, np.int32))
        best = np.full((width + 1, len(chunks)), UNREACHED)
        best[0] = 0
        bytes_of = np.searchsorted([0x80, 0x800, 0x10000], chars, "right") + 1
        bytes_of[chars == ord(SPACE)] = 1
        for i in range(width):
            rows = np.flatnonzero(n > i)
            nodes = np.zeros(len(rows), np.int32)
            for d in range(1, min(deep, width - i) + 1):
                if d > 1:
                    on = n[rows] >= i + d
                    rows, nodes = rows[on], nodes[on]
                if not len(rows):
                    break
                nodes = self.step(nodes, chars[i + d - 1][rows])
                known = nodes >= 0
                scores, ids = np.where(known, self.scores[nodes], 0), np.where(known, self.ids[nodes], -1)
                if d == 1:
                    scores = np.where(scores == 0, self.vocabulary.byte_score * bytes_of[i][rows], scores)
                arcs[i, d][rows], pieces[i, d][rows] = scores, ids
                there = np.where(scores != 0, best[i][rows] + scores, UNREACHED)
                best[i + d][rows] = np.maximum(best[i + d][rows], there)
                rows, nodes = rows[known], nodes[known]
        at, after = n.copy(), np.zeros(len(chunks), np.int64)
        second, told = np.full(len(chunks), UNREACHED), np.ones(len(chunks), bool)
        path, count = np.zeros((len(chunks), width), np.int32), np.zeros(len(chunks), np.int64)
        rows, lengths = np.arange(len(chunks)), np.arange(1, deep + 1)
        while len(rows):
            start = at[rows, None] - lengths
            arc = np.where(start >= 0, arcs[start, lengths, rows[:, None]], 0)
            value = np.where(arc != 0, best[start, rows[:, None]] + arc, UNREACHED)
            take, each = value.argmax(axis=1), np.arange(len(rows))  # of equal ones the shortest piece
            value[each, take] = UNREACHED
            other = value.max(axis=1)
            second[rows] = np.maximum(second[rows], np.where(other == UNREACHED, UNREACHED, other + after[rows]))
            piece = pieces[start[each, take], take + 1, rows]
            told[rows] &= piece >= 0
            count[rows] += 1
            path[rows, width - count[rows]] = piece
            after[rows] += arc[each, take]
            at[rows] = start[each, take]
            rows = rows[at[rows] > 0]
        total = best[n, np.arange(len(chunks))]
        loss = np.where(second == UNREACHED, NONE, total - second)
        rows = zip(told.tolist(), total.tolist(), path, count.tolist(), loss.tolist(), strict=True)
        return [(score, ids[width - k :].tobytes(), less) if sure else None for sure, score, ids, k, less in rows]


class Encoder:
    """Encodes texts. Results of chunks of up to KEPT characters, so of bounded size, are kept in two generations of at most
    `cached` each (and what one batch adds): the best segmentation, and what the next one loses against it. The others are searched for
    when they can matter, which is seldom. Ids are held as bytes, four for each."""

    def __init__(self, vocabulary: Vocabulary, n: int, cached: int | None = None):
        self.cached = cached or CACHED_CHUNKS
        self.vocabulary, self.n, self.cache, self.older, self.others = vocabulary, n, {}, {}, {}

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.vocabulary)

    def cut(self, text: str) -> list[str]:
        return self.vocabulary.chunk.findall(self.vocabulary.mark(text))

    def prepare(self, chunks: Iterable[str]) -> None:
        """Searches for what the cache lacks, many chunks at once; the rest is left to the single search. The cache takes in
        what these chunks have, so that none is lost before it is used."""
        if len(self.cache) >= self.cached:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        todo: dict[int, list[str]] = {most: [] for most in TOGETHER}
        for chunk in set(chunks).difference(cache):
            if (got := older.get(chunk)) is not None:
                cache[chunk] = got
            elif len(chunk) <= TOGETHER[-1] and "\ue000" not in chunk:
                todo[next(most for most in TOGETHER if len(chunk) <= most)].append(chunk)
        for some in todo.values():
            for lo in range(0, len(some), BATCH):
                part = some[lo : lo + BATCH]
                cache.update((chunk, got) for chunk, got in zip(part, self.trie.first(part), strict=True) if got)

    def _keep(self, chunk: str, got: tuple[int, bytes, int]) -> None:
        if len(self.cache) >= self.cached:
            self.cache, self.older = {}, self.cache
        self.cache[chunk] = got

    def _chunk(self, chunk: str) -> tuple[int, bytes, int]:
        got = self.older.get(chunk)
        if got is None:
            top, ids, loss = first(self.vocabulary, chunk)
            got = (top, ids.tobytes(), loss)
        if len(chunk) <= KEPT:
            self._keep(chunk, got)
        return got

    def _alternatives(self, chunk: str, top: int) -> list[tuple[int, bytes]]:
        """(loss, ids) of all but the best."""
        got = self.others.get(chunk)
        if got is None:
            found = list(search(self.vocabulary, chunk, self.n))
            got = [(top - score, ids.tobytes()) for score, ids in found[1:]]
            if len(chunk) <= KEPT:
                if len(self.others) >= max(1, self.cached // 8):
                    self.others.clear()
                self.others[chunk] = got
        return got

    def encode(self, text: str, chunks: list[str] | None = None) -> list[tuple[int, bytes]]:
        """The n best segmentations of the text, best first. The text is a series of chunks, so a segmentation loses
        against the best one what its chunks lose. Only alternatives among the n - 1 least losses can take part, so
        only those of the n - 1 chunks that lose least are asked for; subsets of them, with at most one for a chunk,
        give the n best."""
        if not text:
            return [(0, b"")]
        chunks = chunks or self.cut(text)
        found = list(map(self.cache.get, chunks))
        if None in found:
            found = [got or self.cache.get(chunk) or self._chunk(chunk) for got, chunk in zip(found, chunks, strict=True)]
        tops, parts, seconds = zip(*found, strict=True)
        losses: list[tuple[int, int, int, bytes]] = []
        waiting = list(seconds)
        for _ in range(self.n - 1):
            if (least := min(waiting)) == NONE:
                break
            at = waiting.index(least)  # of equal ones the first
            waiting[at] = NONE
            losses += [(loss, at, k, other) for k, (loss, other) in enumerate(self._alternatives(chunks[at], tops[at]))]
        losses.sort(key=lambda x: x[:3])
        del losses[self.n - 1 :]
        score, ids = sum(tops), b"".join(parts)
        choices = []
        for size in range(len(losses) + 1):
            for some in combinations(losses, size):
                if len({x[1] for x in some}) == size:
                    choices.append((sum(x[0] for x in some), size, [x[1:3] for x in some], some))
        choices.sort(key=lambda c: c[:3])
        out = [(score, ids)]
        for loss, _, _, some in choices[1 : self.n]:
            changed, done = [], 0
            for at, other in sorted((x[1], x[3]) for x in some):
                begin = sum(map(len, parts[:at]))
                changed += [ids[done:begin], other]
                done = begin + len(parts[at])
            out.append((score - loss, b"".join([*changed, ids[done:]])))
        return out


_encoders: dict[tuple[bytes, int, int | None], Encoder] = {}


def encoder_for(model: bytes, n: int, cached: int | None = None) -> Encoder:
    """The worker process's encoder, which one task leaves to the next; one vocabulary is kept at a time."""
    key = (hashlib.sha256(model).digest(), n, cached)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(model), n, cached)
    return _encoders[key]


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of a sequence of ids; ids out of range and broken byte sequences are replaced by U+FFFD."""
    table = vocabulary.bytes_of
    if ids and (min(ids) < 0 or max(ids) >= len(table)):
        raw = b"".join([table[i] if 0 <= i < len(table) else b"\xef\xbf\xbd" for i in ids])
    else:
        raw = b"".join(map(table.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


def read_model(path: str) -> bytes:
    """The model file, read on the driver and sent with the tasks: half a megabyte, whatever the data."""
    with open(path, "rb") as f:
        return f.read()


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PART bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
        yield lo, hi
        lo = hi


def encode(docs: DataFrame, model: bytes, n: int = 3, text_col: str = "text", verify: bool = False, cached: int = CACHED_CHUNKS, keep: bool = True, back: bool = False) -> DataFrame:
    """docs and nbest: array<struct<score: double, ids: array<int>>>, best first; with verify also lossless: whether the
    best segmentation decodes to the text; with back also decoded: the text that the best segmentation's ids decode to. cached bounds the memory that a worker
    keeps; without keep it keeps none between tasks.

    Fewer than n segmentations come back where a text has fewer. An empty text has one, without pieces; a null
    text has a null nbest and lossless. Every text decodes to itself. Repeated rows are encoded alike; an empty table
    stays empty; columns of docs with the names of the added ones are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = ["nbest", *["lossless"] * verify, *["decoded"] * back]
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    place = source.columns.index(text_col)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, n, cached)
        for whole in batches:
            for lo, hi in _parts(whole.column(place)):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(place).to_pylist()
                cuts = [encoder.cut(text) if text else [] for text in texts]
                encoder.prepare(chain.from_iterable(cuts))
                flat, ends, scores, rows, known, same, texts_back = bytearray(), array("i", [0]), [], array("i", [0]), [], [], []
                for text, chunks in zip(texts, cuts, strict=True):
                    found = encoder.encode(text, chunks) if text is not None else []
                    for score, ids in found:
                        flat += ids
                        ends.append(len(flat) // 4)
                        scores.append(score / UNIT)
                    rows.append(len(scores))
                    known.append(text is not None)
                    if verify or back:
                        decoded = decode_ids(encoder.vocabulary, array("i", found[0][1]).tolist()) if found else None
                        same.append(decoded == text if found else None)
                        texts_back.append(decoded if back else None)
                ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
                each = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), ids], ["score", "ids"])
                offsets = pa.array(np.frombuffer(rows, np.int32), mask=np.append(~np.array(known, bool), False))
                nbest = pa.ListArray.from_arrays(offsets, each).cast(kind)
                more = [nbest, *[pa.array(same, pa.bool_())] * verify, *[pa.array(texts_back, pa.string())] * back]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added])
        if not keep:
            _encoders.clear()

    segmentations = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    kinds = {"nbest": segmentations, "lossless": T.BooleanType(), "decoded": T.StringType()}
    return source.mapInArrow(run, T.StructType([*source.schema.fields, *(T.StructField(name, kinds[name]) for name in added)]))


def decoder(spark: SparkSession, model: bytes):
    """A function of a column of ids that gives the text; null for null."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        vocabulary = next((e.vocabulary for (key, *_), e in _encoders.items() if key == hashlib.sha256(shared.value).digest()), None) or encoder_for(shared.value, 1).vocabulary
        return pd.Series([None if x is None else decode_ids(vocabulary, x.tolist()) for x in ids], dtype=object)

    return decode
