"""Quality scores by Bradley-Terry pairwise ranking.

Each labelled document of higher quality is preferred to documents of lower quality (PAIRS opponents, chosen by hash);
weights minimise the logistic loss of the preferences on feature differences, so a document's strength is a weighted
sum of its features: shares of hashed word n-grams (one and two words) and of hashed character trigrams, beside a few
measures of the text's surface. The threshold is the quantile of strengths below which the labels put the low-quality
share; quantile and the slope of the score, a logistic function of the strength with value PASS at the threshold, are
fitted on CALIBRATION of the sample, which the weights have not seen.

Null and empty texts have the features of an empty text and a score like any other. The sample is bounded: SAMPLE_DOCS
labelled documents in expectation, chosen by hash of the id, whole texts; all rows are scored, whole. Labels with a null
id or quality are not used; of several labels of an id the highest holds; rows that share an id are chosen or left out
together. Further columns of docs are not read by fit() and kept by score().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import held_out, release_memory
from sparkwarden.session import ship_package

SAMPLE_DOCS, CALIBRATION = 6_000, 0.25
PAIRS = 8
PASS = 0.3
RIDGE = 1e-2
#: Scales of n-grams against surface measures; preferences among the rows set apart choose one.
HASHED_SCALES = (1.0, 0.3, 0.1, 0.03)
#: Bins of hashed n-grams of words and of characters, and how many preferences are added up at once.
WORD_BITS, CHAR_BITS = 8, 8
ROWS_AT_ONCE = 4_096
#: Characters hashed at once; parts end at white space.
CHUNK = 100_000
SURFACE = ("lower", "upper", "digit", "space", "line", "stop", "odd", "bar", "word_length", "distinct", "repeated", "caps", "tails", "ends", "size", "short_words")
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point up to U+FFFF: 0 other letters, then as SURFACE has them."""
    global _CLASSES
    if _CLASSES is None:
        out = np.zeros(0x10000, np.uint8)
        for c in range(0x10000):
            x = chr(c)
            out[c] = 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 5 if x == "\n" else 4 if x.isspace() else 0 if x.isalpha() else 6 if x in ".,;:'\"-?()" else 8 if x == "|" else 7
        _CLASSES = out
    return _CLASSES


N_FEATURES = len(SURFACE) + (1 << WORD_BITS) + (1 << CHAR_BITS)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_WHITE = re.compile(r"\s")


def bins(codes: np.ndarray, bits: int) -> np.ndarray:
    """How many codes fall into each of 2^bits bins by hash."""
    codes = (codes ^ (codes >> np.uint64(29))) * _TIMES
    return np.bincount((codes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, at + CHUNK)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def hashed(text: str) -> np.ndarray:
    """Square roots of the shares of hashed word n-grams and character trigrams, in lower case."""
    by_word, by_char = np.zeros(1 << WORD_BITS), np.zeros(1 << CHAR_BITS)
    word, tail = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for part in parts(text):
        cp = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        white = (cp == 32) | ((cp >= 9) & (cp <= 13))
        solid = np.concatenate([[False], ~white, [False]])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, end = edge[::2], edge[1::2]
        if len(start):
            first = np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(cp)]])))  # of each character's word
            place = np.arange(len(cp)) - first
            value = np.where(white, np.uint64(0), (cp + np.uint64(1)) * _TIMES * (2 * place.astype(np.uint64) + np.uint64(1)))
            own = np.add.reduceat(value, start)
            by_word += bins(own, WORD_BITS)
            own = np.concatenate([word, own])
            by_word += bins(own[:-1] * np.uint64(3) + own[1:] * np.uint64(7), WORD_BITS)
            word = own[-1:]
        cp = np.concatenate([tail, cp])
        by_char += bins((cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:], CHAR_BITS)
        tail = cp[-2:]
    return np.sqrt(np.concatenate([by_word / max(1, by_word.sum()), by_char / max(1, by_char.sum())]))


def surface(text: str) -> np.ndarray:
    """Shares of character classes, and measures of words and lines, by the names of SURFACE."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    by = np.bincount(classes()[np.minimum(cp, 0xFFFF)], minlength=9)
    n = max(1, len(cp))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    kinds = set(words)
    caps = sum(w.isupper() and len(w) > 1 for w in kinds) / max(1, len(kinds))
    tails = sum(not w[-1].isalnum() and w[-1] not in ".,;:'\"-?)" for w in kinds) / max(1, len(kinds))
    return np.array([
        *(by[1:9] / n), len(cp) / m / 10, len(kinds) / m, 1 - len(set(lines)) / max(1, len(lines)), caps, tails,
        sum(x[-1] in ".?:" for x in lines) / max(1, len(lines)), np.log1p(len(cp)) / 10, sum(len(w) < 4 for w in kinds) / max(1, len(kinds)),
    ])


def features(text: str) -> np.ndarray:
    return np.concatenate([surface(text), hashed(text)]).astype(np.float32)


class Ranker:
    """Weights of the features, and the curve from strength to score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.threshold, self.slope = 0.0, 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(PASS / (1 - PASS))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-d.w)) over preferences, d = x[better] - x[worse], by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slope, curve = ridge * w, ridge * np.eye(len(w))
        for at in range(0, len(better), ROWS_AT_ONCE):
            d = x[better[at : at + ROWS_AT_ONCE]] - x[worse[at : at + ROWS_AT_ONCE]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope = slope - d.T @ p / len(better)
            curve += (d * (p * (1 - p))[:, None].astype(d.dtype)).T @ d / len(better)
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Ranker:
    """docs(doc_id, text), labels(doc_id, quality): learns from rows that are not held out, with text and label."""
    ship_package(docs.sparkSession)
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    at = F.pmod(F.xxhash64(F.lit(9), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    apart = F.pmod(F.xxhash64(F.lit(10), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30) < CALIBRATION
    share = min(1.0, sample_docs / max(1, usable.count()))
    chosen = usable.filter(at < share)  # sample_docs rows in expectation
    keep = F.pandas_udf("array<float>")(lambda batch: pd.Series([features(t) for t in batch]))
    picked = docs.filter((at < share) & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = picked.select("doc_id", "quality", apart.alias("apart"), keep("text").alias("x")).toPandas().sort_values("doc_id")
    x, good = (np.stack(sample["x"].to_numpy()) if len(sample) else np.zeros((0, N_FEATURES), np.float32)), sample["quality"].to_numpy() == 1
    apart = sample["apart"].to_numpy().astype(bool)
    high, low = np.flatnonzero(good & ~apart), np.flatnonzero(~good & ~apart)
    if not len(high) or not len(low):
        model = Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES))
        model.threshold = -1.0 if good.any() or not len(sample) else 1.0
        return model
    mean, scale = x[~apart].mean(axis=0), np.maximum(x[~apart].std(axis=0), 1e-3)
    rng = np.random.default_rng(31)
    prefer = lambda high, low, n: (np.concatenate([rng.choice(high, min(len(high), n), replace=False) for _ in low]), np.repeat(low, min(len(high), n)))
    better, worse = prefer(high, low, PAIRS)
    of_high = prefer(low, high, 2)
    better, worse = np.concatenate([better, of_high[1]]), np.concatenate([worse, of_high[0]])
    if not (apart & good).any() or not (apart & ~good).any():
        apart = np.ones(len(x), bool)  # too few rows to set some apart
    unseen = prefer(np.flatnonzero(apart & good), np.flatnonzero(apart & ~good), PAIRS)
    tried = []
    for share in HASHED_SCALES:  # the less an n-gram is scaled to, the stronger is the ridge on its weight
        scaled = np.where(np.arange(N_FEATURES) < len(SURFACE), scale, scale / share)
        ranker = Ranker(mean, scaled, bradley_terry(np.clip((x - mean) / scaled, -8, 8), better, worse))
        s = ranker.strength(x)
        tried.append((np.log1p(np.exp(-np.clip(s[unseen[0]] - s[unseen[1]], -30, 30))).mean(), ranker))
    model = min(tried, key=lambda t: t[0])[1]
    s, good = model.strength(x[apart]), good[apart]
    # The quantile near the labels' share that parts them best.
    shares = np.linspace(0.2, 1.8, 33) * (~good).mean()
    best = max(np.clip(shares, 0.001, 0.999), key=lambda q: (((s >= np.quantile(s, q)) == good).mean(), -abs(q - (~good).mean())))
    model.threshold = float(np.quantile(s, best))
    rate = lambda k: np.clip(k * (s - model.threshold) + np.log(PASS / (1 - PASS)), -30, 30)
    model.slope = min((0.25, 0.5, 1.0, 2.0, 4.0), key=lambda k: np.log1p(np.exp(np.where(good, -rate(k), rate(k)))).mean())
    return model


def score(docs: DataFrame, model: Ranker, *, text_col: str = "text") -> DataFrame:
    """docs with score and predicted (1 from PASS on); columns of these names are replaced."""
    ship_package(docs.sparkSession)
    docs = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack([features("" if t is None else t) for t in batch])) if len(batch) else np.zeros(0))
        release_memory()

    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*cols, scored(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PASS).cast("int"))
