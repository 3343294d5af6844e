"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text becomes a row of 16-bit integers: letters in lower case by rank among all letters of the sample, letters that are
not in it as one, and each run of anything else as one boundary. A model holds, for each order, its n-grams' hashes sorted
in an array, beside discounted weights and back-off factors; the highest order counts occurrences, lower orders count
distinct left neighbours. The language of least cross-entropy per character wins; its score is the softmax of the
entropies over a fitted temperature.

Temperature and rejection are calibrated on CALIBRATION of the sample, which the models have not seen. A text is `rejected`
where it has no letter, or its entropy per character is above what FALSE_REJECTION of the winning language's own texts
exceed: the excess over the language's line in 1 / sqrt(length), in units that grow with it, has an exponential tail
fitted to its highest tenth over all languages. A language with under CALIBRATED texts to calibrate on rejects none. A text without letters, or null, is `und` with score 0. Texts are scored whole, a part at a time; what
stands before a part is carried into it.

Every language is learned. The sample is bounded: SAMPLE_DOCS documents for each language in expectation, chosen by hash
of the id, whole texts; documents with a null id, lang or text are not learned from, rows that share an id are chosen or
left out together. Further columns of docs are not read by fit() and kept by identify(). Models are fitted in a task for each language; the driver holds their arrays. Only where a sample
has more than MOST_LETTERS letters, about half of all that Unicode has, do the rarest of them share a symbol.
"""

from __future__ import annotations

import math
import pickle
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import free_name, held_out, materialize, release_memory
from sparkwarden.session import ship_package

ORDER = 4
SAMPLE_DOCS, CALIBRATION = 800, 0.25
#: Bits of a symbol, so that an n-gram of ORDER fits 64; and the letters that have one of their own.
BITS = 16
MOST_LETTERS = (1 << BITS) - 2
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
FALSE_REJECTION, TAIL, CALIBRATED = 1e-6, 0.1, 20
#: The unit of an excess is this and 1 / sqrt(length); and the least scale of its tail, for samples of equal texts.
FLAT, LEAST_TAIL = 0.05, 0.1
#: Characters scored at once.
CHUNK = 250_000

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.frombuffer(bytes(unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.bool_)
    return _LETTERS


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str, rank: np.ndarray) -> Iterator[np.ndarray]:
    """A text's symbols, CHUNK characters at a time: 0 for a boundary, at the end too (and one before the text, which is
    left out); 1 for a letter outside the alphabet; from 2 the letters of the alphabet."""
    text, last = text.lower(), 0
    for at in range(0, len(text), CHUNK):
        cp = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        got = np.where(letters()[cp], rank[cp], 0).astype(np.uint16)
        if at + CHUNK >= len(text):
            got = np.append(got, np.uint16(0))
        before = np.concatenate([[last], got[:-1]])
        last = got[-1]
        yield got[(got != 0) | (before != 0)]


def gram_parts(text: str, rank: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of a text's n-grams of the highest order, one for each symbol, a part at a time."""
    history = np.zeros(ORDER - 1, np.uint16)
    for x in symbols(text, rank):
        x = np.concatenate([history, x])
        yield grams(x, ORDER, BITS)
        history = x[len(x) - ORDER + 1 :]


def grams(x: np.ndarray, n: int, bits: int = 8) -> np.ndarray:
    """Codes of the n-grams of x: so many bits a symbol, so an n-gram's hash is exact up to order 64 / bits."""
    out = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(bits)) | x[k : len(x) - n + 1 + k].astype(np.uint64)
    return out


def counts(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(codes) if codes else np.zeros(0, np.uint64), return_counts=True)


def text_counts(texts: Iterable[str], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the texts' n-grams of the highest order."""
    held, size, codes, seen = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add() -> None:
        nonlocal held, size, codes, seen
        new, often = counts(held)
        codes, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
        seen = np.bincount(at, np.concatenate([seen, often]), len(codes)).astype(np.int64)
        held, size = [], 0

    for text in texts:
        for part in gram_parts(text, rank):
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                add()
    add()
    return codes, seen


class KneserNey:
    """One language's model: by order, sorted hashes with discounted weight, and sorted histories with back-off factor."""

    def __init__(self, top: np.ndarray, seen: np.ndarray, order: int, n_symbols: int, bits: int = 8):
        self.order, self.floor, self.bits = order, 1.0 / n_symbols, bits
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.histories: list[tuple[np.ndarray, np.ndarray]] = []
        levels = {order: (top, seen.astype(np.float64))}
        for n in range(order - 1, 0, -1):  # how many distinct symbols stand to the left
            mask = np.uint64((1 << (bits * n)) - 1)
            codes, left = np.unique(levels[n + 1][0] & mask, return_counts=True)
            levels[n] = (codes, left.astype(np.float64))
        for n in range(1, order + 1):
            codes, c = levels[n]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
            heads, at = np.unique(codes >> np.uint64(bits), return_inverse=True)
            total, kinds = np.bincount(at, c, len(heads)), np.bincount(at, minlength=len(heads))
            self.grams.append((codes, np.maximum(c - discount, 0) / total[at]))
            self.histories.append((heads, discount * kinds / total))

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(codes), missing)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return np.where(keys[at] == codes, values[at], missing)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram of the highest order, given the others."""
        p = np.full(len(codes), self.floor)
        for n in range(1, self.order + 1):
            own = codes & np.uint64((1 << (self.bits * n)) - 1)
            p = self._look(self.grams[n - 1], own, 0.0) + self._look(self.histories[n - 1], own >> np.uint64(self.bits), 1.0) * p
        return np.log(p)


class Identifier:
    """The models of all languages, with temperature and rejection levels."""

    def __init__(self, languages: list[str], rank: np.ndarray, models: list[KneserNey]):
        self.languages, self.rank, self.models = languages, rank, models
        self.temperature, self.levels = 0.05, np.tile([0.0, 0.0, np.inf], (len(languages), 1))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and each text's number of characters with letters."""
        total, length = np.zeros((len(texts), len(self.models))), np.zeros(len(texts))
        held, owners, size = [], [], 0

        def flush() -> None:
            nonlocal held, owners, size
            if held:
                codes, at = np.unique(np.concatenate(held), return_inverse=True)
                owner = np.repeat(owners, [len(h) for h in held])
                for k, model in enumerate(self.models):
                    total[:, k] -= np.bincount(owner, model.log_probability(codes)[at], len(texts))
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            for part in gram_parts(text, self.rank):
                length[i] += len(part)  # a text without letters has no symbol
                held.append(part)
                owners.append(i)
                size += len(part)
                if size >= CHUNK:
                    flush()
        flush()
        return total / np.maximum(length, 1)[:, None], length

    def measure(self, texts: list[str], truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts with letters: their places, entropies in their own languages, lengths, and losses at each temperature."""
        entropies, length = self.entropies(texts)
        at = np.flatnonzero(length > 0)
        entropies, length, truth, rows = entropies[at], length[at], truth[at], np.arange(len(at))
        losses = [-np.log(np.maximum(self.softmax(entropies, t)[rows, truth], 1e-12)) for t in TEMPERATURES]
        return at, entropies[rows, truth], length, np.array(losses).T

    def calibrate(self, truth: np.ndarray, entropy: np.ndarray, length: np.ndarray, losses: np.ndarray) -> None:
        if len(truth):
            self.temperature = TEMPERATURES[int(losses.mean(axis=0).argmin())]
        excess = np.full(len(truth), np.nan)
        for k in range(len(self.languages)):
            own = truth == k
            h, root = entropy[own], 1 / np.sqrt(length[own])
            if len(h) >= CALIBRATED:
                slope, base = np.polyfit(root, h, 1) if np.ptp(root) > 0 else (0.0, h.mean())
                slope = max(slope, 0.0)
                excess[own] = (h - base - slope * root) / (FLAT + root)
                self.levels[k, :2] = base, slope
        excess = excess[~np.isnan(excess)]
        if len(excess):
            start = np.quantile(excess, 1 - TAIL)
            beyond = max(LEAST_TAIL, (excess[excess > start] - start).mean() if (excess > start).any() else 0.0)
            enough = np.bincount(truth, minlength=len(self.languages)) >= CALIBRATED
            self.levels[enough, 2] = start + beyond * np.log(TAIL / FALSE_REJECTION)

    def excess(self, best: np.ndarray, entropy: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How far entropies are above (positive) or below what the languages' own texts of that length have."""
        base, slope, level = self.levels[best].T
        root = 1 / np.sqrt(np.maximum(length, 1))
        return (entropy - base - slope * root) / (FLAT + root) - level

    @staticmethod
    def softmax(entropies: np.ndarray, temperature: float) -> np.ndarray:
        z = -entropies / temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropies, length = self.entropies(texts)
        best, some = entropies.argmin(axis=1), length > 0
        rows = np.arange(len(texts))
        rejected = ~some | (self.excess(best, entropies[rows, best], length) > 0)
        score = np.where(some, self.softmax(entropies, self.temperature)[rows, best], 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best, some)], score, rejected


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """Learn from text and non-null lang of the documents that are not held out."""
    ship_package(docs.sparkSession)
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    at = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n"))
    apart = (F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30) < CALIBRATION).alias("apart")
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").filter(at < share).select("lang", "text", apart)
    sample = materialize(sample, "language-sample")  # sample_docs for each language

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cp, often = counts([points(t) for t in batch["text"]])
            own = letters()[cp.astype(np.int64)]
            yield pd.DataFrame({"letter": cp[own].astype(np.int32), "n": often[own].astype(np.int64)})
        release_memory()

    found = sample.select("text").mapInPandas(seen, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # letters of Unicode at most
    alphabet = [r["letter"] for r in sorted(found, key=lambda r: (-r["n"], r["letter"]))][:MOST_LETTERS]
    rank = np.ones(0x110000, np.uint16)
    rank[np.array(alphabet, np.int64)] = np.arange(2, 2 + len(alphabet))
    n_symbols = len(alphabet) + 2

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        model = KneserNey(*text_counts(group["text"], rank), ORDER, n_symbols, BITS)
        out = pd.DataFrame({"lang": group["lang"].iloc[:1], "model": [pickle.dumps(model)]})
        del model
        release_memory()
        return out

    learned = {r["lang"]: pickle.loads(r["model"]) for r in sample.filter(~F.col("apart")).groupBy("lang").applyInPandas(learn, "lang string, model binary").toLocalIterator()}
    languages = sorted(learned)
    found = Identifier(languages, rank, [learned[lang] for lang in languages])
    if languages:
        place = {lang: k for k, lang in enumerate(languages)}

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                truth = batch["lang"].map(place).to_numpy()
                at, entropy, length, losses = found.measure(list(batch["text"]), truth)
                yield pd.DataFrame({"truth": truth[at], "entropy": entropy, "length": length, "losses": list(losses)})
            release_memory()

        known = sample.filter(F.col("apart") & F.col("lang").isin(languages)).select("lang", "text")
        got = known.mapInPandas(measured, "truth int, entropy double, length double, losses array<double>").toPandas().sort_values(["truth", "length", "entropy"])
        losses = np.array(list(got["losses"])).reshape(len(got), len(TEMPERATURES))
        found.calibrate(got["truth"].to_numpy(), got["entropy"].to_numpy(), got["length"].to_numpy(), losses)
    return found


def identify(docs: DataFrame, model: Identifier, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced). Repeated rows are judged each."""
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, score, rejected = model.judge(["" if t is None else t for t in batch])
            yield pd.DataFrame({"lang_pred": names, "score": score, "rejected": rejected})
            del batch
        release_memory()

    cols = [F.col(f"`{c}`") for c in docs.columns]
    at = free_name(docs, "judged")
    return docs.withColumn(at, judged(F.col(text_col).cast("string"))).select(*cols, f"{at}.*")
