"""Packing of documents into token windows by lexical retrieval.

Documents are encoded and cut: each stretch of a whole window is a sequence of its own, what is left of a document (less
than a window) is dealt to shards of about SHARD_ROWS rows, by turns, so that no key can crowd one. A shard is one task: it
has a BM25 inverted index of its rows (terms are token ids; document frequencies and the mean length are those of the
whole corpus). The first unused row is a seed. Its terms are looked up in the index, and the unused rows of the shard fill
the seed's window, best score first, rows without a common term last; the row that meets the window's end is cut there,
and its rest is the next seed. So all windows are full but the last one of each shard.

What reaches the driver is one document frequency a token id at most, which the vocabulary bounds.

Results in the edge cases: a null or empty text is its end token alone. A repeated row is packed again. An empty table gives
no rows. Other columns are not read. A very long text is encoded in parts; only its last piece goes to a shard.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwarden.llm.bpe import HIGH, SPACE, TOKEN_BITS, TrieBpe, byte_symbols, low_class, parts
from sparkwarden.llm.common import materialize, release_memory
from sparkwarden.llm.merges import WIDTHS, Merges, places
from sparkwarden.session import ship_package

#: Tokens of a sequence, the id that ends each document, and rows of a shard.
WINDOW, END_ID, SHARD_ROWS = 2048, 1, 2048
#: BM25's saturation of term frequencies and weight of lengths.
K1, B = 1.2, 0.75
#: Characters of texts whose chunks between spaces are encoded together.
GROUP_CHARS = 4_000_000
#: The pattern of words that are runs of a kind, and the kinds.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES, LETTER, NUMBER, OTHER = range(4)


class LibraryWords(TrieBpe):
    """Gives texts the ids that the library gives. Of a group of texts only the distinct chunks between spaces are split into
    words and encoded, all of them at once in arrays; the library's own merges encode very long words."""

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary)
        if any(c.isspace() for c in "".join(self.special)):
            raise ValueError("special tokens must have no space")
        symbols = byte_symbols()
        pairs = {(pair >> TOKEN_BITS, pair & (1 << TOKEN_BITS) - 1): k for pair, k in self.rank.items()}
        merged = np.zeros(len(self.rank), np.int32)
        for token, k in enumerate(self.made):
            if k >= 0:
                merged[k] = token
        self.merges = Merges(pairs, merged, np.array([self.ids[c] for c in symbols]), np.array([self.ids[c + self.suffix] for c in symbols]))
        self.library, self.symbols = Tokenizer.from_str(vocabulary).model, symbols
        # The kind of each code point below U+0300, if words are runs of a kind.
        pattern = next(p["pattern"]["Regex"] for p in json.loads(vocabulary)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.kinds = None
        if pattern == RUNS:
            self.kinds = np.full(0x300, OTHER, np.uint8)
            for kind, own in ((LETTER, low_class("L")), (NUMBER, low_class("N")), (SPACES, re.findall(f"[{SPACE}]", "".join(map(chr, range(0x300)))))):
                self.kinds[[ord(c) for c in own if ord(c) < 0x300]] = kind

    def _plant_suffixes(self) -> None:
        """No automaton: merges are made."""

    def word_ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, given: dict[int, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places of data, and their number for each word. `given` has the ids of some."""
        others = dict(given or {})
        for k in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            word = "".join(map(self.symbols.__getitem__, data[starts[k] : starts[k] + lengths[k]].tolist()))
            others[k] = [t.id for t in self.library.tokenize(word)]
        if not others:
            return self.merges.encode(data, starts, lengths)
        counts, short = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        short[list(others)] = False
        own, counts[short] = self.merges.encode(data, starts[short], lengths[short])
        for k, ids in others.items():
            counts[k] = len(ids)
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        out[places((ends - counts)[short], counts[short])] = own
        for k, ids in others.items():
            out[ends[k] - counts[k] : ends[k]] = ids
        return out, counts

    def listed_ids(self, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words, of which numbers are special tokens, and their number for each word."""
        coded = [w.encode() if isinstance(w, str) else b"" for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        special = {k: [words[k]] for k in np.flatnonzero(lengths == 0).tolist()}
        return self.word_ids(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(lengths) - lengths, lengths, special)

    def runs(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, chunk) of the words of chunks that have no apostrophe and no code point from U+0300 on, and the
        numbers of the other chunks."""
        lengths = np.diff(bounds)
        if self.kinds is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.flatnonzero(lengths)
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        odd = np.zeros(len(lengths), bool)
        odd[chunk[np.flatnonzero((data == ord("'")) | (data >= 0xCC))]] = True
        kind = self.kinds[data]  # wrong for what is not ASCII
        inner = data >> 6 == 2
        second = np.flatnonzero(inner & ~odd[chunk])
        kind[second] = kind[second - 1] = self.kinds[(data[second - 1].astype(np.int64) & 31) << 6 | data[second] & 63]
        starts = np.concatenate([[True], (kind[1:] != kind[:-1]) | (chunk[1:] != chunk[:-1])])[: len(data)] | (kind == NUMBER)
        start = np.flatnonzero(starts & ~inner)
        length = np.diff(np.append(start, len(data)))
        word = (kind[start] != SPACES) & ~odd[chunk[start]]
        return start[word], length[word], chunk[start[word]], np.flatnonzero(odd)

    def chunk_ids(self, chunks: pa.StringArray, full: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without a space, and their number for each. They are in lower case, or split by the full rules."""
        if full:
            start = length = chunk = np.zeros(0, np.int64)
            data, odd, split = np.zeros(0, np.uint8), np.arange(len(chunks)), self.pieces
        else:
            _, offsets, data = chunks.buffers()
            bounds = np.frombuffer(offsets, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
            data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
            start, length, chunk, odd = self.runs(data, bounds - bounds[0])
            split = self.split.findall
        ids, n = self.word_ids(data, start, length)
        if len(odd):
            words = [split(c) for c in chunks.take(pa.array(odd)).to_pylist()]
            more, of_each = self.listed_ids(list(chain.from_iterable(words)))
            ids, n = np.concatenate([ids, more]), np.concatenate([n, of_each])
            chunk = np.concatenate([chunk, np.repeat(odd, [len(w) for w in words])])
            order = np.argsort(chunk, kind="stable")
            ids, n, chunk = ids[places((np.cumsum(n) - n)[order], n[order])], n[order], chunk[order]
        return ids, np.bincount(chunk, weights=n, minlength=len(chunks)).astype(np.int64)

    def encode_parts(self, parts: list[str], full: bool) -> list[bytes]:
        """Ids of parts. Pre-tokens never span a space, so only the distinct chunks between spaces are split and encoded; the
        ids of all of them are then gathered."""
        lists = pc.split_pattern(pa.array(parts, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        tokens, lengths = self.chunk_ids(coded.dictionary, full)
        at = coded.indices.to_numpy()
        n = lengths[at]
        every = tokens.astype("<u4")[places((np.cumsum(lengths) - lengths)[at], n)]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.asarray(lists.offsets)]
        return [every[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Long texts are encoded in parts, so that only about
        GROUP_CHARS characters are held as chunks. Parts that may hold a special token, or code points that combine, are
        split by the vocabulary's full rules."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: dict[bool, list[tuple[list[bytes], int, str]]] = {False: [], True: []}
        size = 0

        def flush() -> None:
            for full, some in held.items():
                if some:
                    for (own, k, _), ids in zip(some, self.encode_parts([p for _, _, p in some], full), strict=True):
                        own[k] = ids
                    some.clear()

        for own, text in zip(out, texts, strict=True):
            for part in parts(text):
                full = "<|" in part or not part.isascii() and HIGH.search(part) is not None
                held[full].append((own, len(own), (part if full else part.lower()).replace("\n", " ")))
                own.append(b"")
                size += len(part)
                if size >= GROUP_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]


_CODERS: dict[int, LibraryWords] = {}


def cut(docs: DataFrame, vocabulary_path: str, *, id_col: str, text_col: str) -> DataFrame:
    """Pieces (doc_id, doc_tokens, start, length, ids_crc32, sequence_id, ids): those that fill a window have a sequence, the
    rest of a document has its ids."""
    vocabulary = Path(vocabulary_path).read_text(encoding="utf-8")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary)
        if key not in _CODERS:
            _CODERS[key] = LibraryWords(vocabulary)
        coder, task, sequence = _CODERS[key], TaskContext.get().partitionId(), 0
        last = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows, out = [], []
            for row, ids in enumerate(coder.encode_batch([t or "" for t in batch["text"].to_pylist()])):
                n = len(ids) // 4 + 1
                for start in range(0, n, WINDOW):
                    piece = ids[4 * start : 4 * (start + WINDOW)]
                    if start + WINDOW >= n:
                        piece += last
                    rows.append(row)
                    if len(piece) == 4 * WINDOW:
                        # Sequences of whole windows have even numbers, those of shards odd ones.
                        out.append((n, start, WINDOW, zlib.crc32(piece), 2 * (task << 32 | sequence), None))
                        sequence += 1
                    else:
                        out.append((n, start, len(piece) // 4, zlib.crc32(piece), None, piece))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())],
                ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "ids"],
            )
        release_memory()

    return docs.mapInArrow(run, f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, ids binary")


def frequencies(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the distinct terms of each row, in that order."""
    ids = np.concatenate(rows)
    terms = 1 + int(ids.max())
    kind = np.uint32 if len(rows) * terms < 1 << 32 else np.uint64
    keys = np.repeat(np.arange(len(rows), dtype=kind), [len(r) for r in rows]) * kind(terms) + ids.astype(kind)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, tf = keys[first], np.diff(np.append(first, len(keys)))
    row = keys // kind(terms)
    return row.astype(np.int64), (keys - row * kind(terms)).astype(np.int64), tf


def document_frequencies(rests: DataFrame) -> DataFrame:
    """(token, df): rows that hold the token; token -1 has the rows and -2 the tokens of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            own = [np.frombuffer(x, "<u4") for x in batch["ids"].to_pylist()]
            if own:
                _, term, _ = frequencies(own)
                own_df = np.bincount(term, minlength=len(df))
                own_df[: len(df)] += df
                df, rows, tokens = own_df, rows + len(own), tokens + sum(map(len, own))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int64()), pa.array([*df[at].tolist(), rows, tokens], pa.int64())], ["token", "df"])

    return rests.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Shard:
    """The inverted index of some rows: for each term those that hold it and their BM25 weights. Terms that more than half
    of the corpus hold tell nothing apart: their weight is not above 0, and they are left out."""

    def __init__(self, rows: list[np.ndarray], weight: np.ndarray, mean: float):
        self.n, self.terms = len(rows), len(weight)
        lengths = np.array([len(r) for r in rows])
        row, term, tf = frequencies(rows)
        telling = weight[term] > 0
        row, term, tf = row[telling], term[telling], tf[telling]
        value = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))
        self.term_of, self.row_bounds = term, np.searchsorted(row, np.arange(self.n + 1))
        order = np.argsort(term.astype(np.uint16) if self.terms <= 1 << 16 else term, kind="stable")
        self.row, self.value = row[order].astype(np.int32), value[order]
        self.bounds = np.searchsorted(term[order], np.arange(self.terms + 1))
        self.unused, self.indexed = np.ones(self.n, bool), self.n

    def use(self, row: int) -> None:
        """Take a row out. Its postings go when half of the rows are used."""
        self.unused[row] = False
        if (left := int(self.unused.sum())) * 2 <= self.indexed:
            stay = self.unused[self.row]
            self.bounds = np.concatenate([[0], np.cumsum(stay)])[self.bounds]
            self.row, self.value, self.indexed = self.row[stay], self.value[stay], left

    def scores(self, seed: int) -> np.ndarray:
        terms = self.term_of[self.row_bounds[seed] : self.row_bounds[seed + 1]]
        first, n = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(n.sum())
        return np.bincount(self.row[at], weights=self.value[at], minlength=self.n)

    def neighbours(self, seed: int) -> Iterator[tuple[int, float]]:
        """Unused rows, best score first, of equal scores the first row; as many as are asked for."""
        scores = self.scores(seed)
        rows = np.flatnonzero(self.unused)
        some = 32
        while len(rows):
            own = scores[rows]
            if len(rows) > some:
                least = np.partition(own, len(rows) - some)[len(rows) - some]
                top = own >= least
            else:
                top = np.ones(len(rows), bool)
            best = rows[top]
            for row in best[np.argsort(-scores[best], kind="stable")].tolist():
                yield row, float(scores[row])
            rows, some = rows[~top], 4 * some


def fill(rows: list[np.ndarray], weight: np.ndarray, mean: float) -> Iterator[tuple[int, int, int, int, int, float | None]]:
    """Pieces (row, start, length, sequence, offset, score) that fill windows: a seed has no score."""
    shard = Shard(rows, weight, mean)
    done, rest, following, sequence = [0] * len(rows), None, 0, 0
    while True:
        if rest is None:
            while following < len(rows) and not shard.unused[following]:
                following += 1
            if following == len(rows):
                return
            rest = following
            shard.use(rest)
        seed, offset, rest = rest, 0, None
        candidates = shard.neighbours(seed)
        row, score = seed, None
        while True:
            n = min(WINDOW - offset, len(rows[row]) - done[row])
            yield row, done[row], n, sequence, offset, score
            done[row], offset = done[row] + n, offset + n
            if done[row] < len(rows[row]):
                rest = row
            if offset == WINDOW:
                break
            found = next(candidates, None)
            if found is None:
                break
            row, score = found
            shard.use(row)
        sequence += 1


def pack(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, role (`whole`: fills a window
    alone; `seed`; `neighbour`) and score (a neighbour's BM25 score for its seed)."""
    ship_package(docs.sparkSession)
    pieces = materialize(cut(docs, vocabulary_path, id_col=id_col, text_col=text_col), "pieces", compression="zstd")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "role", "score"]
    whole = pieces.filter(F.col("ids").isNull()).withColumns({"offset": F.lit(0).cast("long"), "role": F.lit("whole"), "score": F.lit(None).cast("double")}).select(columns)
    rests = pieces.filter(F.col("ids").isNotNull()).select("doc_id", "doc_tokens", "start", "ids_crc32", "ids")
    counts = {r.token: r.df for r in document_frequencies(rests).collect()}
    rows, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
    if not rows:
        return whole
    weight = np.zeros(1 + max(counts))
    for token, df in counts.items():
        weight[token] = np.log((rows - df + 0.5) / (df + 0.5))
    weight[END_ID] = 0  # all rows end with it
    mean = tokens / rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        shard = TaskContext.get().partitionId()
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        own = [np.frombuffer(x, "<u4") for x in table["ids"].to_pylist()]
        out = list(fill(own, weight, mean))
        row = pa.array([p[0] for p in out], pa.int64())
        starts = table["start"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                table["doc_id"].combine_chunks().take(row),
                pa.array([starts[p[0]] + p[1] for p in out], pa.int64()),
                pa.array([p[2] for p in out], pa.int64()),
                pa.array([zlib.crc32(own[p[0]][p[1] : p[1] + p[2]].tobytes()) for p in out], pa.int64()),
                table["doc_tokens"].combine_chunks().take(row),
                pa.array([2 * (shard << 32 | p[3]) + 1 for p in out], pa.int64()),
                pa.array([p[4] for p in out], pa.int64()),
                pa.array(["seed" if p[5] is None else "neighbour" for p in out], pa.string()),
                pa.array([p[5] for p in out], pa.float64()),
            ],
            columns,
        )
        release_memory()

    shards = rests.repartition(-(-rows // SHARD_ROWS))
    return whole.unionByName(shards.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, role string, score double"))
