"""Token counts that follow edits: a segment tree over the pre-tokens of a document.

A text is split into pre-tokens, which are encoded each by itself, so the count of a text is the sum over its pre-tokens.
Leaves of the tree are runs of up to LEAF pre-tokens with their text, lengths and counts; inner nodes hold the sums of
characters and tokens below them. An edit replaces a range of characters: pre-tokens are split anew from two before the
edit (what they look ahead to is then before it too) until a boundary behind the edit falls on an old one; from there on
the old ones hold. Only the region's text is read, its pre-tokens counted, its leaves written and the sums above those
leaves updated; the rest of the tree and of the text is not touched. A tree that grew too deep or has too many empty
leaves is planted anew over its leaves, which costs a constant number of sums for each leaf that edits made.

Null and empty texts have no tokens. Edits outside the text are cut to it. A null edit changes nothing; a null start is
the beginning of the text, a null end is the start, a null new text is empty. Repeated rows are counted each. An empty
table gives no rows; columns other than id, text and edits are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import release_memory
from sparkwarden.session import ship_package

LEAF = 64
#: Pre-tokens whose counts a worker remembers before it starts over.
KEPT = 100_000


class Counter:
    """Counts of pre-tokens in one vocabulary of ranks."""

    def __init__(self, ranks: bytes, pattern: str):
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def of(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            new = {p for p in pieces if p not in known}
            if len(known) + len(new) > KEPT:
                known.clear()
                new = set(pieces)
            for p in new:
                known[p] = len(self.encoding.encode_ordinary(p))
            return [known[p] for p in pieces]


class Node:
    """Sums of characters and tokens; a leaf also has the text, lengths and counts of its pre-tokens."""

    __slots__ = ("chars", "tokens", "up", "left", "right", "text", "lengths", "counts")

    def __init__(self):
        self.up = self.left = self.right = None

    @classmethod
    def over(cls, left: Node, right: Node) -> Node:
        node = cls()
        node.left, node.right, left.up, right.up = left, right, node, node
        node.chars, node.tokens = left.chars + right.chars, left.tokens + right.tokens
        return node

    def hold(self, text: str, lengths: list[int], counts: list[int]) -> tuple[int, int]:
        """Make it a leaf of this run; returns by how much its sums change."""
        before = (self.chars, self.tokens) if hasattr(self, "chars") else (0, 0)
        self.text, self.lengths, self.counts = text, lengths, counts
        self.chars, self.tokens = len(text), sum(counts)
        return self.chars - before[0], self.tokens - before[1]


def runs(pieces: list[str], counts: list[int]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Runs of up to LEAF pre-tokens, of equal numbers, so that a full leaf that is split has room on both sides."""
    n = -(-len(pieces) // LEAF)
    for k in range(n):
        a, b = k * len(pieces) // n, (k + 1) * len(pieces) // n
        part = pieces[a:b]
        yield "".join(part), list(map(len, part)), counts[a:b]


def plant(nodes: list[Node]) -> Node:
    """A balanced tree over nodes in their order."""
    while len(nodes) > 1:
        odd = nodes[-1:] if len(nodes) % 2 else []
        nodes = [Node.over(a, b) for a, b in zip(nodes[::2], nodes[1::2])] + odd
    nodes[0].up = None
    return nodes[0]


def leaf_of(run: tuple[str, list[int], list[int]]) -> Node:
    node = Node()
    node.hold(*run)
    return node


class Tree:
    """A document's pre-tokens as leaves, with sums of characters and tokens over them."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.split.findall(text)
        self.root = plant([leaf_of(run) for run in runs(pieces, counter.of(pieces))] or [leaf_of(("", [], []))])
        self.n_leaves, self.n_empty = max(1, -(-len(pieces) // LEAF)), 0 if pieces else 1
        #: Pre-tokens counted, and sums written, by the last step.
        self.counted, self.summed = len(pieces), 2 * self.n_leaves - 1

    @property
    def total(self) -> int:
        return self.root.tokens

    def leaves(self) -> Iterator[Node]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node
            else:
                stack += (node.right, node.left)

    def text(self) -> str:
        return "".join(leaf.text for leaf in self.leaves())

    def leaf_at(self, char: int) -> tuple[Node, int, int]:
        """The leaf that holds a character, where it starts, and its depth: down the tree by sums of characters."""
        node, start, depth = self.root, 0, 0
        while node.left is not None:
            depth += 1
            if node.right.chars and char >= start + node.left.chars:
                start += node.left.chars
                node = node.right
            else:
                node = node.left
        return node, start, depth

    @staticmethod
    def beside(leaf: Node, ahead: bool) -> Node | None:
        """The next leaf (or the one before) that is not empty."""
        node = leaf
        while node.up is not None:
            came, node = node, node.up
            other = node.right if ahead else node.left
            if other is not came and other.chars:
                node = other
                while node.left is not None:
                    near, far = (node.left, node.right) if ahead else (node.right, node.left)
                    node = near if near.chars else far
                return node
        return None

    def replace(self, start: int, end: int, new: str) -> int:
        """Put `new` in place of the characters from start to end; returns the new total."""
        start = max(0, min(start, self.root.chars))
        end = max(start, min(end, self.root.chars))
        leaf, at, depth = self.leaf_at(max(0, start - 2))
        keep = bisect_left(list(accumulate(leaf.lengths)), start - 1 - at) - 1  # all but one of those that end two before the edit
        if keep <= 0:
            keep, before = 0, self.beside(leaf, False)
            if before is not None:
                leaf, at = before, at - before.chars
                keep = len(leaf.lengths) - 1
        kept = sum(leaf.lengths[:keep])
        begin, head = at + kept, (leaf.text[:kept], leaf.lengths[:keep], leaf.counts[:keep])
        touched, old, lengths, counts = [leaf], leaf.text[kept:], leaf.lengths[keep:], leaf.counts[keep:]

        def more() -> str | None:
            """Take the next leaf into the region; returns its text."""
            ahead = self.beside(touched[-1], True)
            if ahead is None:
                return None
            touched.append(ahead)
            lengths.extend(ahead.lengths)
            counts.extend(ahead.counts)
            return ahead.text

        final = False
        while begin + len(old) < end and (text := more()) is not None:
            old += text
        text = old[: start - begin] + new + old[end - begin :]
        shift, fixed = len(new) - (end - start), start - begin + len(new)
        bounds, pieces, pos = set(accumulate(lengths)), [], 0
        while True:
            match = self.counter.split.match(text, pos)
            while not final and (match is None or match.end() + 2 > len(text)):
                known, ahead = sum(lengths), more()
                final = ahead is None
                if not final:
                    text += ahead
                    bounds.update(accumulate(touched[-1].lengths, initial=known))
                    match = self.counter.split.match(text, pos)
            if match is None:
                break
            pieces.append(match.group())
            pos = match.end()
            if pos >= fixed and pos - shift in bounds and pos - shift >= end - begin:
                break
        rest = bisect_left(list(accumulate(lengths, initial=0)), pos - shift)
        again = self.counter.of(pieces)
        self.counted = len(pieces)
        pieces, again = pieces + split_at(text[pos:], lengths[rest:]), again + counts[rest:]
        pieces, again = split_at(head[0], head[1]) + pieces, head[2] + again
        self._write(touched, list(runs(pieces, again)))
        depth = max(depth, self.depth_written)
        if depth > 2 * self.n_leaves.bit_length() + 4 or self.n_empty > self.n_leaves // 2 + 4:
            nodes = [x for x in self.leaves() if x.chars] or [leaf_of(("", [], []))]
            self.root, self.n_leaves, self.n_empty = plant(nodes), len(nodes), 0 if nodes[0].chars else 1
            self.summed += self.n_leaves
        return self.total

    def _write(self, touched: list[Node], new: list[tuple[str, list[int], list[int]]]) -> None:
        """Put runs into leaves: further ones as a tree in the last leaf's place, leaves without one stay empty."""
        self.summed = self.depth_written = 0
        for k, leaf in enumerate(touched):
            was_empty = not leaf.chars
            if k == len(touched) - 1 and len(new) > len(touched):
                mine = plant([leaf_of(run) for run in new[k:]])
                change, up = (mine.chars - leaf.chars, mine.tokens - leaf.tokens), leaf.up
                if up is None:
                    self.root = mine
                elif up.left is leaf:
                    up.left = mine
                else:
                    up.right = mine
                mine.up = up
                self.n_leaves += len(new) - len(touched)
                self.summed += 2 * (len(new) - k) - 1
                depth, is_empty = (len(new) - k).bit_length(), False
            else:
                change, up = leaf.hold(*(new[k] if k < len(new) else ("", [], []))), leaf.up
                self.summed += 1
                depth, is_empty = 0, not leaf.chars
            self.n_empty += is_empty - was_empty
            while up is not None:
                up.chars += change[0]
                up.tokens += change[1]
                up, depth = up.up, depth + 1
                self.summed += 1
            self.depth_written = max(self.depth_written, depth)


def split_at(text: str, lengths: list[int]) -> list[str]:
    ends = list(accumulate(lengths, initial=0))
    return [text[a:b] for a, b in zip(ends, ends[1:])]


_COUNTERS: dict[int, Counter] = {}


def counter(ranks: bytes, pattern: str) -> Counter:
    key = hash((ranks, pattern))
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(ranks, pattern)
    return _COUNTERS[key]


def count_edits(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """docs with an array of edits (start int, end int, new string), done in turn -> doc_id, n_tokens, n_tokens_edited
    (null edits: none), n_counted (pre-tokens of the text), n_recounted (pre-tokens counted again by all edits), n_summed
    (sums of the trees written by all edits)."""
    ship_package(docs.sparkSession)
    ranks = Path(ranks_path).read_bytes()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).alias("edits"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = counter(ranks, pattern)
        for batch in batches:
            rows = []
            for text, edits in zip(batch["text"], batch["edits"]):
                tree = Tree(text or "", counts)
                before, first, again, sums = tree.total, tree.counted, 0, 0
                for e in edits if edits is not None else ():
                    if e is None:
                        continue
                    start = 0 if e["start"] is None else int(e["start"])
                    tree.replace(start, start if e["end"] is None else int(e["end"]), e["new"] or "")
                    again += tree.counted
                    sums += tree.summed
                rows.append((before, tree.total, first, again, sums))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_counted", "n_recounted", "n_summed"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out
        release_memory()

    return docs.mapInPandas(run, f"doc_id {kind}, n_tokens long, n_tokens_edited long, n_counted long, n_recounted long, n_summed long")
