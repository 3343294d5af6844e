"""BPE encoding by traversing the prefix trie of distinct words.

The encoding of every prefix of a word is known once its last token is known: the rest is the encoding of the prefix
without that token. Sorted words visit their trie depth first, so the last-token states of a shared prefix are computed
once and reused by all the words below it. At each step down, one transition of a suffix automaton of the tokens gives
those that end there; the last token is the one that may follow the last token of what is before it. Whether
a token may follow another is read off their merge trees.

Normalizing and splitting follow the vocabulary file. Words with code points from U+0300 on go through the library's own
normalizer and splitting pattern, so that their Unicode tables are the library's; below that, regex's are equal (tested
for each code point).

Null and empty texts give no ids and an empty decoded text. The strings of special tokens in a text become those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from sparkwarden.llm.common import release_memory
from sparkwarden.session import ship_package

#: White space below U+0300 as the vocabulary's normalizer sees it.
SPACE = r"\t-\r \x85\xa0"
#: From here on, characters may combine, and tables of Unicode versions differ.
HIGH = regex.compile(r"[̀-\U0010FFFF]")
#: Distinct words that a worker remembers of each of two generations: words of the older one that come again are taken
#: over into the younger, the others go with it. Pairs and steps it remembers before it starts over.
WORDS_KEPT = 60_000
PAIRS_KEPT = STEPS_KEPT = 100_000
CHUNK_WORDS, PART_CHARS = 20_000, 100_000
#: Units are bytes; the last unit of a word is its byte plus 256. Tokens and units fit these bits of a pair's key.
END, TOKEN_BITS, UNIT_BITS = 256, 24, 9


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


def low_class(category: str) -> str:
    """The characters of a Unicode category that texts below U+0300 have in lower case, to stand within brackets."""
    low = "".join(map(chr, range(0x300)))
    return "".join(sorted(set(regex.findall(rf"\p{{{category}}}", low + low.lower()))))


class TrieBpe:
    """Encoder and decoder of one vocabulary file (tokenizers JSON, BPE with word ends)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.byte = {s: b for b, s in enumerate(byte_symbols())}
        self._plant_merges(model["merges"])
        self._plant_suffixes()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = re.compile(regex.sub(r"\\p\{(\w)\}", lambda m: low_class(m[1]), pattern).replace(r"\s", SPACE))
        bare = spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}
        self.library_normal = Tokenizer.from_str(json.dumps(bare)).normalizer.normalize_str
        self.library_split = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.little = [i.to_bytes(4, "little") for i in range(1 + max(self.ids.values()))]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def units(self, token: str) -> list[int]:
        """The units that a token stands for."""
        ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
        out = [self.byte[c] for c in (token[: -len(self.suffix)] if ends else token)]
        if ends:
            out[-1] += END
        return out

    def _plant_merges(self, merges: list) -> None:
        """Ranks of pairs; for each token the rank of the merge that makes it (-1: none) and that merge's two sides."""
        n = 1 + max(self.ids.values())
        self.made, self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n, {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, token = self.ids[a], self.ids[b], self.ids[a + b]
            if self.made[token] >= 0 or max(self.made[left], self.made[right]) >= k:
                raise ValueError(f"merge {k} makes a token again, or of later ones")
            self.made[token], self.left[token], self.right[token] = k, left, right
            self.rank[left << TOKEN_BITS | right] = k

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether BPE never joins across the border of two tokens by a merge of a rank under limit.

        Merges are undone from the last on, on both sides of the border; the two tokens met at each step stand side by
        side in BPE until the merge undone just before, so a pair of lower rank would have been joined. Of equal merges
        the leftmost is made first."""
        made, rank = self.made, self.rank
        while True:
            joined = rank.get(left << TOKEN_BITS | right)
            if joined is not None and joined < limit:
                return False
            if made[left] > made[right]:
                limit, left = made[left], self.right[left]
            elif made[right] < 0:
                return True
            else:
                limit, right = made[right] + 1, self.left[right]

    def _plant_suffixes(self) -> None:
        """The automaton: nodes are prefixes of tokens; `ends[node]`: (token, units) that end there, longest first."""
        self.step: dict[int, int] = {}
        token_at, whole, below = {}, [False] * len(self.made), [[]]
        for token, i in sorted(self.ids.items(), key=lambda x: self.made[x[1]]):
            # A token can only come out of BPE if its merge tree is what BPE makes of its units.
            left, right = self.left[i], self.right[i]
            whole[i] = left < 0 or whole[left] and whole[right] and self._apart(left, right, self.made[i])
            if not whole[i]:
                continue
            node, units = 0, self.units(token)
            for u in units:
                nxt = self.step.get(node << UNIT_BITS | u)
                if nxt is None:
                    nxt = self.step[node << UNIT_BITS | u] = len(below)
                    below[node].append((u, nxt))
                    below.append([])
                node = nxt
            token_at[node] = (i, len(units))
        self.fail, self.ends, queue = [0] * len(below), [()] * len(below), deque([0])
        while queue:
            node = queue.popleft()
            for u, nxt in below[node]:
                back = self.fail[node]
                while node and back and back << UNIT_BITS | u not in self.step:
                    back = self.fail[back]
                self.fail[nxt] = self.step.get(back << UNIT_BITS | u, 0) if node else 0
                own = (token_at[nxt],) if nxt in token_at else ()
                self.ends[nxt] = own + self.ends[self.fail[nxt]]
                queue.append(nxt)
        self.steps: dict[int, int] = {}

    def _down(self, node: int, unit: int) -> int:
        """The node of the longest suffix that starts a token, one more unit on."""
        at = node
        while (found := self.step.get(at << UNIT_BITS | unit)) is None and at:
            at = self.fail[at]
        if len(self.steps) >= STEPS_KEPT:
            self.steps.clear()
        self.steps[node << UNIT_BITS | unit] = found = found or 0
        return found

    def _follows(self, before: int, token: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        good = self.pairs[before << TOKEN_BITS | token] = self._apart(before, token, len(self.rank))
        return good

    def learn(self, words: set[str]) -> None:
        """Encode new words: their trie is walked depth first, in sorted order.

        For each depth of the path, `nodes` has the automaton's node, `states` the last token of the encoding of the
        units down to there, and `lengths` that token's units."""
        steps, down, ends, pairs, follows, known, little = self.steps, self._down, self.ends, self.pairs, self._follows, self.known, self.little
        nodes, states, lengths, path = [0], [-1], [0], b""
        for units, word in sorted([(w.encode(), w) for w in words]):
            end = len(units) - 1
            same, most = 0, min(len(path), end)
            if path[:most] == units[:most]:
                same = most
            else:
                while path[same] == units[same]:
                    same += 1
            del nodes[same + 1 :], states[same + 1 :], lengths[same + 1 :]
            node, depth, path = nodes[-1], same, units[:end]
            for unit in (*units[same:end], units[end] + END):
                depth += 1
                at = steps.get(node << UNIT_BITS | unit)
                node = down(node, unit) if at is None else at
                for token, length in ends[node]:
                    if length == depth:
                        break
                    before = states[depth - length]
                    good = pairs.get(before << TOKEN_BITS | token)
                    if good or good is None and follows(before, token):
                        break
                else:
                    raise ValueError("no token of the vocabulary ends here")
                nodes.append(node)
                states.append(token)
                lengths.append(length)
            out = []
            while depth:
                out.append(little[states[depth]])
                depth -= lengths[depth]
            out.reverse()
            known[word] = b"".join(out)
            nodes.pop()  # the last unit ends this word only
            states.pop()
            lengths.pop()

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text; a special token is given as its id."""
        if self.cut is None or "<" not in text:
            return self.plain(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self.plain(part))
        return out

    def plain(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens: runs between spaces that hold a high code point are the library's."""
        if text.isascii() or not HIGH.search(text):
            return self.split.findall(text.lower())
        out, done = [], 0
        for found in HIGH.finditer(text):
            at = found.start()
            if at >= done:
                start = max(done, text.rfind(" ", done, at) + 1)
                stop = text.find(" ", at)
                stop = len(text) if stop < 0 else stop
                out += self.split.findall(text[done:start].lower())
                out += [piece for piece, _ in self.library_split(self.library_normal(text[start:stop]))]
                done = stop
        return out + self.split.findall(text[done:].lower())

    def know(self, words: set[str]) -> None:
        """Have the ids of all these words in `known`."""
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        new = words - self.known.keys()
        again = new & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(new - again)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Pre-tokens never span a space, so long texts are
        cut there, and only about CHUNK_WORDS pre-tokens are held."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str | int]]] = []
        count = 0

        def flush() -> None:
            self.know({w for w in set(chain.from_iterable(p for _, p in held)) if isinstance(w, str)})
            get = self.known.__getitem__
            for k, p in held:
                try:
                    out[k].append(b"".join(map(get, p)))
                except KeyError:
                    out[k].append(b"".join(get(w) if isinstance(w, str) else w.to_bytes(4, "little") for w in p))
            held.clear()

        for k, text in enumerate(texts):
            for part in parts(text):
                held.append((k, self.pieces(part)))
                count += len(held[-1][1])
                if count >= CHUNK_WORDS:
                    flush()
                    count = 0
        flush()
        return [b"".join(x) for x in out]

    def decoded(self, ids: bytes) -> Iterator[str]:
        """The decoded text in parts: the file names no decoder, so the tokens are joined by spaces."""
        view = memoryview(ids).cast("I") if ids else ()
        for at in range(0, len(view), CHUNK_WORDS):
            yield (" " if at else "") + " ".join(map(self.strings.__getitem__, view[at : at + CHUNK_WORDS].tolist()))

    def decode(self, ids: bytes) -> str:
        return "".join(self.decoded(ids))

    def decoded_sha256(self, ids: bytes) -> str:
        digest = hashlib.sha256()
        for part in self.decoded(ids):
            digest.update(part.encode())
        return digest.hexdigest()


def parts(text: str) -> Iterator[str]:
    """A text cut before spaces into parts of about PART_CHARS characters."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + PART_CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


_CODERS: dict[int, TrieBpe] = {}


def coder(vocabulary: str) -> TrieBpe:
    """One coder for each vocabulary and Python worker; its cache of words goes on from batch to batch."""
    key = hash(vocabulary)
    if key not in _CODERS:
        _CODERS[key] = TrieBpe(vocabulary)
    return _CODERS[key]


def encode(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (binary, if keep_ids), ids_sha256, decoded (if keep_decoded), decoded_sha256.

    Repeated rows are encoded each; other columns of docs are not read.
    """
    vocabulary = Path(vocabulary_path).read_text(encoding="utf-8")
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = "ids binary, " * keep_ids + "decoded string, " * keep_decoded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(vocabulary)
        for batch in batches:
            ids = bpe.encode_batch([t or "" for t in batch.pop("text")])
            out = {"doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in ids]}
            if keep_ids:
                out["ids"] = ids
            if keep_decoded:
                out["decoded"] = [bpe.decode(x) for x in ids]
            out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
            out["decoded_sha256"] = [bpe.decoded_sha256(x) for x in ids]
            yield pd.DataFrame(out)
            del batch, ids, out
        release_memory()

    return docs.mapInPandas(run, f"doc_id {kind}, n_tokens long, {extra}ids_sha256 string, decoded_sha256 string")
