"""A compressed full-text index over one shard, for many patterns at once.

The suffixes are ordered by their first ``depth`` symbols, the last column is kept
as a wavelet matrix of packed bits with a count per word, and backward search
runs over arrays of patterns in step.
"""

from __future__ import annotations

import numpy as np


class PackedBits:
    """Bits with rank: a 64-bit word and a running count for every 64 positions."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels, self.zeros, self.bits = [], [], bits
        for k in reversed(range(bits)):
            bit = ((symbols >> k) & 1).astype(bool)
            self.levels.append(PackedBits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(1 << bits)
        self.first = self._walk(every, np.zeros(1 << bits, dtype=np.int64)) if bits <= 16 else None

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level, zeros in zip(reversed(range(self.bits)), self.levels, self.zeros):
            ones = level.rank(i)
            i = np.where((c >> k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        first = self.first[c] if self.first is not None else self._walk(c, np.zeros(len(c), dtype=np.int64))
        return self._walk(c, i) - first


class FMIndex:
    """Index of ``text``, symbols 0 to ``sigma`` - 1 with 0 between records, for
    patterns of up to ``span`` + 1 symbols."""

    def __init__(self, text: np.ndarray, sigma: int, span: int) -> None:
        n = len(text)
        self.text, self.span = text, span
        self.bits = max(1, int(sigma - 1).bit_length())
        self.q = min(60 // self.bits, span)
        padded = np.concatenate([text, np.zeros(2 * span + 2, dtype=text.dtype)])
        key, have = padded.astype(np.int64), 1
        while have < self.q:  # symbols in a row packed into one number
            take = min(have, self.q - have)
            shifted = key[have:] if take == have else key[have:] >> (self.bits * (have - take))
            key = (key[: len(shifted)] << (self.bits * take)) | shifted
            have += take
        key = key[:n]
        order = np.argsort(key)
        self.key, self.sorted_key = key, key[order]
        h, rank = self.q, _ranks(order, self.sorted_key)
        half, rank_half = h, rank
        while h < span + 1:
            half, rank_half = h, rank
            pair = rank.astype(np.int64) * n
            pair[: max(0, n - h)] += rank[h:]
            order = np.argsort(pair)
            rank = _ranks(order, pair[order])
            h *= 2
        # rows with the same first `span` symbols are one block
        a = rank_half[order]
        b = rank_half[np.minimum(order + max(0, span - half), n - 1)]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.order = order
        self.block = np.cumsum(new, dtype=np.int32) - 1
        self.starts = np.append(np.flatnonzero(new), n)
        last = text[order - 1].astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        self.wavelet = WaveletMatrix(last, self.bits)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for each pattern."""
        m = len(c)
        r = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.before[c]
        return base + r[:m], base + r[m:]

    def block_matches(self, start: np.ndarray, length: np.ndarray):
        """Matching statistics of the documents text[start : start + length], cut at
        ``span``: yields (documents, window, block) for all their windows, from the
        last to the first. Documents must be given longest first."""
        q, span, text = self.q, self.span, self.text
        tail = self.key[start + length - q]
        lo, hi = np.searchsorted(self.sorted_key, tail, "left"), np.searchsorted(self.sorted_key, tail, "right")
        longest = int(length.max(initial=0))
        for t in range(q, longest + 1):
            live = int(np.searchsorted(-length, -t, "right"))  # documents of at least t symbols
            if t > q:
                c = text[start[:live] + length[:live] - t].astype(np.int64)
                lo, hi = self.extend(c, lo[:live], hi[:live])
            if t >= span:
                block = self.block[lo[:live]]
                yield np.arange(live), length[:live] - t, block
                # the longest suffix kept is span symbols: widen to its interval
                lo, hi = self.starts[block], self.starts[block + 1]


def _ranks(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.concatenate([[0], np.cumsum(values[1:] != values[:-1], dtype=np.int32)])
    return rank
