"""Toxicity by weak supervision: mined lexicon and pattern voters, a generative label model, a linear classifier."""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from auditloom.llm.common import stash
from auditloom.llm.labelled import labelled_sample

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
PIECE = 1 << 20
CACHED_WORDS = 200_000


def _words(text: str | None) -> set[str]:
    """The distinct lower-cased words; a very long text is read in pieces that end between words."""
    found: set[str] = set()
    at = 0
    text = text or ""
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (gap := re.compile(r"\W").search(text, end)):
            end = gap.start()
        elif end < len(text):
            end = len(text)
        found.update(WORD.findall(text[at:end].lower()))
        at = end
    return found


def _terms(word: str) -> list[str]:
    """A word as itself (a lexicon entry) and as patterns: each of its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task, in how many toxic and other texts each term occurs; flushed when the table has grown large."""
    counts: dict[str, list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(t, *n) for t, n in counts.items()], columns=["term", "toxic", "other"])
        counts.clear()
        return out

    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            for term in {t for w in _words(text) for t in _terms(w)}:
                counts.setdefault(term, [0, 0])[0 if y else 1] += 1
            if len(counts) > 500_000:
                yield flush()
    yield flush()


def mine_terms(sample: DataFrame, most: int, least_texts: int) -> list[tuple[str, float]]:
    """The `most` terms whose log odds of a toxic text are surest to differ from the sample's (by the near end of
    their 90 % interval), with those log odds. Only terms of at least least_texts texts; ties go by the term."""
    counted = sample.select("text", "y").mapInPandas(_mine, "term string, toxic bigint, other bigint")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where(F.col("t") + F.col("o") >= least_texts)
    n = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    if not n.n or not n.t or n.t == n.n:
        return []
    t, o = float(n.t), float(n.n - n.t)
    odds = F.log((F.col("t") + 0.5) / (t - F.col("t") + 0.5)) - F.log((F.col("o") + 0.5) / (o - F.col("o") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (t - F.col("t") + 0.5) + 1 / (F.col("o") + 0.5) + 1 / (o - F.col("o") + 0.5))
    ranked = counted.select("term", odds.alias("odds"), (F.abs(odds) - 1.64 * error).alias("sure")).orderBy(F.desc("sure"), "term").limit(most)
    return [(r.term, r.odds) for r in ranked.collect()]  # `most` rows


def vote_matrix(sample: DataFrame, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, labels): which terms occur in each of the sample's texts. The sample's bound and the number of
    terms bound what comes to the driver."""
    index = {t: i for i, t in enumerate(terms)}

    @pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        def row(text):
            hit = np.zeros(len(index), np.uint8)
            for w in _words(text):
                for t in _terms(w):
                    if (i := index.get(t)) is not None:
                        hit[i] = 1
            return np.packbits(hit).tobytes()

        return pd.Series([row(t) for t in texts], dtype=object)

    rows = stash(sample.select(bits("text").alias("bits"), "y"), "votes").collect()
    rows.sort(key=lambda r: (bytes(r["bits"]), r["y"]))
    votes = np.zeros((len(rows), len(terms)), np.uint8)
    for i, r in enumerate(rows):
        votes[i] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(terms))
    return votes, np.array([r["y"] for r in rows], np.float64)


class LabelModel:
    """A generative model of voters that fire or stay silent, and of the given label, all given the hidden label.

    EM estimates the hidden label's prior; the given label's two rates of being right (it is a voter like the others,
    which 20 imagined rows say is right in nine of ten cases); and for each voter how often it fires under either label,
    given also what the voter fired that it goes with most. Those pairs are the strongest tree of correlations between voters
    given the hidden label (by mutual information, those that pay for their two more numbers)."""

    def __init__(self, rounds: int = 12, smoothing: float = 1.0, right: float = 0.9, imagined: float = 20.0):
        self.rounds, self.smoothing, self.right, self.imagined = rounds, smoothing, right, imagined

    def fit(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """The posterior probability of label 1 for each row."""
        v = votes.astype(np.float32)
        posterior = np.where(given == 1, self.right, 1 - self.right)
        self.parent = np.full(v.shape[1], -1)
        for k in range(self.rounds):
            if k in (1, self.rounds // 2):
                self.parent = self._tree(v, posterior)
            self._estimate(v, given, posterior)
            posterior = self._expect(v, given)
        return posterior

    def _estimate(self, v: np.ndarray, given: np.ndarray, posterior: np.ndarray) -> None:
        s, m = self.smoothing, self.imagined
        weights = np.stack([1 - posterior, posterior])
        total = weights.sum(1)
        self.prior = (total[1] + s) / (total.sum() + 2 * s)
        self.given = (weights @ given + m * np.array([1 - self.right, self.right])) / (total + m)
        with_parent = v[:, np.maximum(self.parent, 0)] * (self.parent >= 0)
        self.fires = np.zeros((2, 2, v.shape[1]))  # hidden label, parent fired, voter
        for y, w in enumerate(weights):
            alone = (v.T @ w + s / 2) / (total[y] + s)
            both = (with_parent * v).T @ w
            parent = with_parent.T @ w
            self.fires[y, 1] = (both + s * alone) / (parent + s)
            self.fires[y, 0] = (v.T @ w - both + s * alone) / (total[y] - parent + s)

    def _expect(self, v: np.ndarray, given: np.ndarray) -> np.ndarray:
        spoken, silent = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        p = v[:, np.maximum(self.parent, 0)] * (self.parent >= 0)
        told = v * (p * spoken[1] + (1 - p) * spoken[0]) + (1 - v) * (p * silent[1] + (1 - p) * silent[0])
        own = np.where(given == 1, np.log(self.given[1] / self.given[0]), np.log((1 - self.given[1]) / (1 - self.given[0])))
        logit = np.log(self.prior / (1 - self.prior)) + own + told.sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _tree(self, v: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """The voter that each voter goes with, or -1."""
        n, k = v.shape
        gain = np.full((k, k), -np.log(max(n, 2)))
        for w in (1 - posterior, posterior):
            total, one = w.sum(), v.T @ w
            both = v.T @ (v * w[:, None].astype(np.float32))
            for a in (0, 1):
                for b in (0, 1):
                    i, j = (one if a else total - one)[:, None], (one if b else total - one)[None, :]
                    met = both if a and b else one[:, None] - both if a else one[None, :] - both if b else total - one[:, None] - one[None, :] + both
                    met = np.maximum(met, 1e-9)
                    gain += met * np.log(met * total / np.maximum(i * j, 1e-9))
        parent, done = np.full(k, -1), np.zeros(k, bool)
        done[:1] = True
        best, source = gain[0].copy() if k else gain, np.zeros(k, int)
        for _ in range(k - 1):
            j = int(np.where(done, -np.inf, best).argmax())
            parent[j] = source[j] if best[j] > 0 else -1
            done[j] = True
            better = gain[j] > best
            best, source = np.where(better, gain[j], best), np.where(better, j, source)
        return parent


def diverse(votes: np.ndarray, most: int, limit: float = 0.6) -> list[int]:
    """Columns in their order, without those that correlate by over limit with an earlier one that was taken, so
    that the words of one often-copied text don't crowd out the others; at most `most`."""
    v = votes.T.astype(np.float32)
    v -= v.mean(1, keepdims=True)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
    chosen, taken = np.zeros((most, v.shape[1]), np.float32), []
    for j, voter in enumerate(v):
        if len(taken) == most:
            break
        if not taken or np.abs(chosen[: len(taken)] @ voter).max() <= limit:
            chosen[len(taken)] = voter
            taken.append(j)
    return taken


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1e-5, rounds: int = 10, inner: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets with a small ridge: Newton steps, each solved by conjugate gradients."""
    n = len(x)
    x = np.hstack([x, np.ones((n, 1))]).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = ((s * (1 - s) + 1e-6) / n).astype(np.float32)
        left = x.T @ ((s - target) / n).astype(np.float32) + ridge * w
        step, toward, size = np.zeros_like(w), left.copy(), float(left @ left)
        for _ in range(inner):
            if size < 1e-12:
                break
            bent = x.T @ (curve * (x @ toward)) + ridge * toward
            rate = size / float(toward @ bent)
            step += rate * toward
            left -= rate * bent
            size, before = float(left @ left), size
            toward = left + size / before * toward
        w -= step
    return w[:-1], float(w[-1])


class Model:
    """Weights of terms, and the bias: what every task needs to score."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self._cache = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_cache": {}}

    def score(self, text: str | None) -> float:
        cache, hits = self._cache, set()
        for w in _words(text):
            got = cache.get(w)
            if got is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                got = cache[w] = tuple(t for t in _terms(w) if t in self.weights)
            if got:
                hits.update(got)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(self.weights[t] for t in hits)), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, held_out: int = 2, bound: int = 8000, voters: int = 50, features: int = 200, terms: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Voters are the terms with the strongest association with the labels in a sample of at most bound labelled
    rows: lexicon entries (words) and patterns (beginnings of words), those aside that nearly repeat another.
    The label model turns the votes of the first `voters` into posterior labels, and a linear classifier over
    the first `features` terms is trained on those, held back as by 0.3 rows. bound x terms bits come to the driver. Without labels of both kinds the model knows no term and scores 0.5 everywhere."""
    sample = stash(labelled_sample(docs, labels, label_col, modulus, held_out, bound, id_col, text_col).select("text", "y"), "sample")
    mined = mine_terms(sample, terms, 3)
    if not mined:
        return Model({}, 0.0)
    names = [t for t, _ in mined]
    votes, given = vote_matrix(sample, names)
    apart = diverse(votes, features)
    names, votes = [names[j] for j in apart], votes[:, apart]
    posterior = LabelModel().fit(votes[:, :voters], given)
    weights, bias = fit_linear(votes, posterior, ridge=0.3 / len(votes))
    return Model({t: float(w) for t, w in zip(names, weights, strict=True) if w}, bias)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, double from 0 to 1: how likely the text is toxic. Null and empty texts get the score
    of a text without known terms; repeated rows score alike; an empty table stays empty; an own column named
    score_col is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))
