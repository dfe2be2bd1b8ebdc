"""Language of a text by a convolutional network over its bytes."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: What no language is told for.
UNKNOWN = "und"

#: Bytes of a window, numbers of a byte's vector, widths of the filters and filters of each width.
WINDOW, VECTOR, WIDTHS, FILTERS = 128, 8, (2, 3, 4, 5), 12
_WIDEST = max(WIDTHS)
#: Windows that go through the network at a time.
BLOCK = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Net:
    """Byte vectors, filters of several widths over them, the largest answer of each filter in the window, and a softmax.

    The filters of all widths are one matrix of the widest, narrower ones with zeros (kept by a mask)."""

    def __init__(self, classes: int, seed: int = 0):
        r = np.random.default_rng(seed)
        mask = np.zeros((_WIDEST, VECTOR, len(WIDTHS), FILTERS), np.float32)
        for i, width in enumerate(WIDTHS):
            mask[:width, :, i] = 1
        self.mask = mask.reshape(_WIDEST * VECTOR, -1)
        spread = 1 / np.sqrt(np.repeat(WIDTHS, FILTERS) * VECTOR)
        n = self.mask.shape[1]
        self.params = {
            "vectors": r.standard_normal((256, VECTOR)).astype(np.float32) * 0.5,
            "filters": (r.standard_normal(self.mask.shape) * spread * 2).astype(np.float32) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": (r.standard_normal((n, classes)) / np.sqrt(n)).astype(np.float32),
            "out_bias": np.zeros(classes, np.float32),
        }

    def _spans(self, windows: np.ndarray) -> np.ndarray:
        """The vectors of the bytes at and behind each position, side by side: (windows x positions, widest x VECTOR)."""
        padded = np.zeros((len(windows), WINDOW + _WIDEST - 1), np.uint8)
        padded[:, :WINDOW] = windows
        vectors = np.ascontiguousarray(self.params["vectors"][padded].reshape(len(windows), -1))
        step = vectors.itemsize * VECTOR
        view = np.lib.stride_tricks.as_strided(vectors, (len(windows), WINDOW, _WIDEST * VECTOR), (vectors.strides[0], step, vectors.itemsize))
        return view.reshape(-1, _WIDEST * VECTOR)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        p = self.params
        answers = (self._spans(windows) @ p["filters"]).reshape(len(windows), WINDOW, -1).max(1)
        z = np.maximum(answers + p["bias"], 0) @ p["out"] + p["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        p, n = self.params, len(windows)
        spans = self._spans(windows)
        answers = (spans @ p["filters"]).reshape(n, WINDOW, -1)
        at = answers.argmax(1)
        top = np.take_along_axis(answers, at[:, None], 1)[:, 0] + p["bias"]
        hidden = np.maximum(top, 0)
        z = hidden @ p["out"] + p["out_bias"]
        z -= z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        loss = -log_p[np.arange(n), y].mean()
        dz = np.exp(log_p)
        dz[np.arange(n), y] -= 1
        dz /= n
        dtop = (dz @ p["out"].T) * (top > 0)
        # only the position of the largest answer matters to a filter
        chosen = spans[np.arange(n)[:, None] * WINDOW + at]  # (windows, filters, widest x VECTOR)
        dfilters = np.einsum("nf,nfs->sf", dtop, chosen) * self.mask
        dspans = dtop[:, :, None] * p["filters"].T[None]
        padded = np.zeros((n, WINDOW + _WIDEST - 1), np.uint8)
        padded[:, :WINDOW] = windows
        bytes_at = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(_WIDEST)]
        dvectors = np.zeros((256, VECTOR), np.float32)
        flat, grads = bytes_at.reshape(-1), dspans.reshape(-1, VECTOR)
        for j in range(VECTOR):
            dvectors[:, j] = np.bincount(flat, grads[:, j], 256)
        return float(loss), {"vectors": dvectors, "filters": dfilters, "bias": dtop.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum(0)}

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 64, seed: int = 0) -> None:
        """Adam over shuffled batches, the rate falling to nothing."""
        r = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        steps, t = epochs * -(-len(y) // batch), 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                some = order[lo : lo + batch]
                _, grads = self.gradients(windows[some], y[some])
                t += 1
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.params[k] -= (rate * (1 - t / (steps + 1)) * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text in windows of fixed length, the last one filled with zeros; A-Z count as a-z. An empty text has one window."""
    n = max(-(-len(text) // WINDOW), 1)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = _LOWER[np.frombuffer(text, np.uint8)]
    return out.reshape(n, WINDOW)


class Model:
    """The learned languages and the network; no language where there was nothing to learn from."""

    def __init__(self, langs: list[str], net: Net | None):
        self.langs, self.net = langs, net

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each language over all windows of each text. Windows of many texts go through together, a long
        text's own in blocks, so memory doesn't grow with it."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held, owners, size = [], [], 0

        def flush() -> None:
            owner = np.repeat([i for i, _ in owners], [n for _, n in owners])
            np.add.at(sums, owner, self.net.probabilities(np.concatenate(held)))
            np.add.at(counts, owner, 1)

        for i, text in enumerate(texts):
            for lo in range(0, max(len(text), 1), BLOCK * WINDOW):
                part = windows_of(text[lo : lo + BLOCK * WINDOW])
                if held and size + len(part) > BLOCK:
                    flush()
                    held, owners, size = [], [], 0
                held.append(part)
                owners.append((i, len(part)))
                size += len(part)
        if held:
            flush()
        return sums / counts[:, None]


def fit(docs: DataFrame, modulus: int = 5, held_out: int = 0, bound: int = 6000, most_langs: int = 200, windows: int = 6, epochs: int = 6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learned from at most `bound` documents with a language (and a letter in the text), never those held out (crc32 of the id as
    text modulo modulus equal to held_out), with as equal shares of the languages as there are documents, up to `windows` windows
    evenly from each. Which: by a hash of the id, so that reruns agree; one row for each id. Of more than most_langs languages
    those with the most documents are learned. All that is collected is bounded by these parameters."""
    ident = F.col(id_col)
    fold = F.crc32(ident.cast("string").cast("binary")) % modulus
    told = docs.where(F.col(lang_col).isNotNull() & ident.isNotNull() & (fold != held_out) & F.col(text_col).rlike(r"\p{L}"))
    told = told.select(F.xxhash64(ident).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    sizes = {r["lang"]: r["count"] for r in told.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not sizes:
        return Model([], None)
    each = bound // len(sizes)
    # a little over `each` of every language on average, then exactly
    shares = docs.sparkSession.createDataFrame([(k, 1.5 * each / n) for k, n in sizes.items()], "lang string, share double")
    near = told.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    one = near.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(2):
                all_windows = windows_of(text.as_buffer().to_pybytes())
                parts.append(all_windows[np.unique(np.linspace(0, len(all_windows) - 1, windows).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["lang", "h", "windows"])

    rows = one.mapInArrow(cut, "lang string, h bigint, windows binary").orderBy(F.xxhash64("h"), "lang").limit(2 * bound).collect()
    langs, taken = sorted(sizes), dict.fromkeys(sizes, 0)
    x, y = [], []
    for row in rows:
        if taken[row["lang"]] < each:
            taken[row["lang"]] += 1
            x.append(np.frombuffer(row["windows"], np.uint8).reshape(-1, WINDOW))
            y += [langs.index(row["lang"])] * len(x[-1])
    net = Net(len(langs))
    net.train(np.concatenate(x), np.array(y), epochs)
    return Model(langs, net)


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col, the likeliest learned language over all windows of the whole text, and score_col, its mean probability.

    A null text, one without a letter and any text where nothing was learned give `und` with score 0. Ties go to the language
    that sorts first. Rows are independent, repeated ones told alike; own columns of these names are replaced; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @pandas_udf(kind)
    def tell(texts: pd.Series) -> pd.DataFrame:
        known, langs, scores = shared.value, [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t is not None]
        for lo in range(0, len(some) if known.langs else 0, 256):
            part = some[lo : lo + 256]
            shares = known.shares([texts.iat[i].encode() for i in part])
            best = shares.argmax(1)
            for i, k, share in zip(part, best, shares, strict=True):
                langs[i], scores[i] = known.langs[k], min(float(share[k]), 1.0)
        return pd.DataFrame({"lang": langs, "score": scores})

    text = F.col(f"`{text_col}`")
    told = docs.withColumn("_told", tell(F.when(text.rlike(r"\p{L}"), text)))
    return told.withColumns({pred_col: F.col("_told.lang"), score_col: F.col("_told.score")}).drop("_told")
