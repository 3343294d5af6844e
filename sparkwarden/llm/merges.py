"""BPE merges of many words at once, in arrays.

Words of like length are the rows of one matrix of symbols. In each round every row makes the merge of its lowest rank, at
the leftmost place, as BPE does for one word; only the two pairs beside the merged one get another rank. Symbols are linked
to those beside them, so nothing is moved. A row without a known pair is done.
"""

from __future__ import annotations

import numpy as np

#: Longest words in units of each matrix; longer words are not for this class.
WIDTHS = (1, 2, 4, 6, 8, 10, 12, 16, 20, 28, 40, 64)
#: Words that are rows of a matrix at once.
ROWS = 1 << 15
#: No token, and the rank of pairs that are never merged.
NONE, NEVER = -1, 2**31 - 1
#: The multiplier that spreads keys of pairs over slots (2^64 over the golden ratio).
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """`rank`: (left, right) token to rank, 0 the first; `merged`: the token of each rank; `inner`, `last`: the token of
    each byte within a word and at its end."""

    def __init__(self, rank: dict[tuple[int, int], int], merged: np.ndarray, inner: np.ndarray, last: np.ndarray):
        self.merged, self.inner, self.last = merged.astype(np.int32), inner.astype(np.int32), last.astype(np.int32)
        bits = max(4, (8 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        pairs = np.array(list(rank), np.int64).reshape(-1, 2)
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], np.fromiter(rank.values(), np.int32, len(rank))
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        slots = self._slots(keys)
        while len(keys):  # of the keys that meet in a free slot one stays there, the others go on to the next slot
            free = np.flatnonzero(self.key[slots] == -1)
            self.key[slots[free]] = keys[free]
            placed = self.key[slots] == keys
            self.value[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], slots[~placed] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * SPREAD >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        found, out = self.key[slots], self.value[slots]
        other = np.flatnonzero(found != keys)
        out[other] = NEVER
        other = other[found[other] != -1]
        slots = slots[other]
        while len(other):
            slots = slots + 1 & self.mask
            found = self.key[slots]
            same = found == keys[other]
            out[other[same]] = self.value[slots[same]]
            more = ~same & (found != -1)
            other, slots = other[more], slots[more]
        return out

    def _matrix(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of at most `width` bytes, row after row, and their number in each row."""
        n, wide = len(starts), width + 2  # no token stands before and after a row
        place = np.arange(width)
        units = data[np.minimum(starts[:, None] + place, len(data) - 1)]
        inside = place < lengths[:, None]
        tokens = np.full((n, wide), NONE, np.int32)
        tokens[:, 1:-1] = np.where(inside, self.inner[units], NONE)
        tokens[np.arange(n), lengths] = self.last[units[np.arange(n), lengths - 1]]
        rank = np.full((n, wide), NEVER, np.int32)
        if width > 1:
            row, at = np.nonzero(inside[:, 1:])
            rank[row, at + 1] = self.ranks(tokens[row, at + 1], tokens[row, at + 2])
        flat, flat_rank = tokens.reshape(-1), rank.reshape(-1)
        after, before = np.arange(1, n * wide + 1, dtype=np.int32), np.arange(-1, n * wide - 1, dtype=np.int32)
        rows = np.arange(n)
        while len(rows):
            own = rank[rows]
            at = rows * wide + own.argmin(1)
            best = flat_rank[at]
            going = best != NEVER
            rows, at, best = rows[going], at[going], best[going]
            right, left = after[at], before[at]
            beyond = after[right]
            new = self.merged[best]
            flat[at], flat[right], flat_rank[right] = new, NONE, NEVER
            after[at], before[beyond] = beyond, at
            flat_rank[at] = self.ranks(new, flat[beyond])
            flat_rank[left] = self.ranks(flat[left], new)
        stay = tokens != NONE
        return tokens[stay], stay.sum(1)

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words data[start : start + length], in their order, and the number of tokens of each word. No word
        is empty or longer than the last of WIDTHS."""
        counts = np.zeros(len(starts), np.int64)
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], WIDTHS, side="right").tolist()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for width, a, b in zip(WIDTHS, [0, *bounds[:-1]], bounds, strict=True):
            for k in range(a, b, ROWS):
                words = order[k : min(k + ROWS, b)]
                tokens, counts[words] = self._matrix(data, starts[words], lengths[words], width)
                done.append((words, tokens))
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        for words, tokens in done:
            out[places(ends[words] - counts[words], counts[words])] = tokens
        return out, counts


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches of these starts and lengths, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
