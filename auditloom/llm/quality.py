"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from auditloom.llm.common import stash
from auditloom.llm.labelled import labelled_sample

#: Features of a text: trigrams of character classes, hashed byte 4-grams, and how varied the 4-grams are.
CLASSES, HASHED, STEPS = 4096, 2048, 8
WIDTH = CLASSES + HASHED + STEPS
PIECE = 1 << 20
PAD = b"\n\n\n\n"


def _class_table() -> np.ndarray:
    table = np.full(256, 15, np.uint16)
    groups = ["abcdefghijklmnopqrstuvwxyz", None, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\r", ".,;:", "\"'", "()[]{}<>", "!?", "%&", "$#*", "|", "-_/\\", "@=+"]
    for number, chars in enumerate(groups):
        table[list(range(128, 256)) if chars is None else [ord(c) for c in chars]] = number
    return table


CLASS_OF = _class_table()


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the class trigrams and hashed 4-grams of each text, which is padded at its end. A long text is
    counted in pieces, so the memory doesn't grow with it."""
    grams = CLASSES + HASHED
    out = np.zeros((len(texts), grams), np.int64)

    def count(group: list[tuple[int, bytes]]) -> None:
        buf = np.frombuffer(b"".join(b for _, b in group) + PAD, np.uint8)
        lens = np.array([len(b) for _, b in group])
        n = int(lens.sum())
        kind = CLASS_OF[buf]
        at = np.repeat(np.arange(len(group)) * grams, lens)
        trigram = kind[:n] * 256 + kind[1 : n + 1] * 16 + kind[2 : n + 2]
        fours = np.ndarray((n,), "<u4", buf, 0, (1,))
        hashed = (fours * np.uint32(2654435761)) >> np.uint32(32 - 11)
        found = np.bincount(at + trigram, minlength=len(group) * grams) + np.bincount(at + CLASSES + hashed, minlength=len(group) * grams)
        for (i, _), row in zip(group, found.reshape(len(group), grams), strict=True):
            out[i] += row

    group, size = [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text) + 1, PIECE):
            piece = text[lo : lo + PIECE] + (PAD if lo + PIECE > len(text) else b"")
            if group and (size + len(piece) > PIECE or len(group) == 64):
                count(group)
                group, size = [], 0
            group.append((i, piece))
            size += len(piece)
    if group:
        count(group)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """Log counts and the step of variety: distinct 4-grams against what chance would give at that length."""
    counts = gram_counts(texts)
    lengths = np.array([max(len(t), 1) for t in texts])
    expected = HASHED * (1 - np.exp(-lengths / HASHED))
    step = np.clip(STEPS * (counts[:, CLASSES:] > 0).sum(1) / expected, 0, STEPS - 1).astype(int)
    x = np.zeros((len(texts), WIDTH), np.float32)
    x[:, : CLASSES + HASHED] = np.log1p(counts)
    x[np.arange(len(texts)), CLASSES + HASHED + step] = 5
    return x


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if not v.is_valid else v.as_buffer().to_pybytes() for v in column]


def _chunks(batch: pa.RecordBatch, name: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part, _bytes(part.column(part.schema.get_field_index(name)))


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, docs = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for _, texts in _chunks(batch, "text"):
            found += (features(texts) > 0).sum(0)
            docs += len(texts)
    yield pa.RecordBatch.from_pydict({"feature": np.arange(WIDTH + 1, dtype=np.int32), "n": np.append(found, docs)})


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """In how many of all documents each feature occurs; the last number counts the documents."""
    parts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count_documents, "feature int, n bigint")
    total = np.zeros(WIDTH + 1, np.int64)
    for row in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # WIDTH + 1 rows at any size
        total[row.feature] = row.n
    return total


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _chunks(batch, "text"):
            at, values = [], []
            for x in features(texts):
                own = np.flatnonzero(x)
                at.append(own.astype("<u2").tobytes())
                values.append(x[own].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["y", "at", "values"])


class Model:
    """What every task needs: idf weights, the latent axes, and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.idf, self.axes, self.vectors, self.labels, self.neighbours = idf, axes, vectors, labels, neighbours
        self.base = float(labels.mean()) if len(labels) else 0.5

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled vectors: exact cosines with all of
        them, a block of documents at a time. Empty texts get the share of label 1 among the labelled rows."""
        out = np.full(len(texts), self.base)
        some = [i for i, t in enumerate(texts) if t]
        if not some or not len(self.labels):
            return out
        cosines = self.project(features([texts[i] for i in some])) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosines, near, 1), 1e-6, 1).astype(np.float64) ** 8
        out[some] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_out: int = 0, bound: int = 4000, rank: int = 32, neighbours: int = 25, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Document frequencies come from all documents. The latent axes are the leading right singular vectors of
    the labelled sample's tf-idf matrix, found by subspace iteration; bound caps the labelled rows, and with them
    the driver's and every task's memory (bound x rank numbers are broadcast)."""
    df = document_frequencies(docs, text_col)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)
    sample = labelled_sample(docs, labels, label_col, modulus, held_out, bound, id_col, text_col)
    rows = stash(sample.select("text", "y").mapInArrow(_sparse, "y int, at binary, values binary"), "sample").collect()
    rows.sort(key=lambda r: (bytes(r["at"]), bytes(r["values"]), r["y"]))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, row in enumerate(rows):
        x[i, np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["values"], "<f4")
    y = np.array([r["y"] for r in rows], np.float64)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    axes = np.random.default_rng(0).standard_normal((WIDTH, rank + 8)).astype(np.float32)
    for _ in range(6 if len(rows) else 0):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    axes = axes[:, :rank]
    z = x @ axes
    return Model(idf, axes, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), y, neighbours)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, double from 0 to 1: how likely label 1 is. Null texts count as empty and score like
    them; repeated rows score alike; an empty table stays empty; an own column named score_col is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        whole = [t.encode() if t is not None else b"" for t in texts]
        parts = [shared.value.score(whole[lo : lo + 256]) for lo in range(0, len(whole), 256)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))
