"""Evaluation texts leaking into training text, by greedy string tiling.

The evaluation items are a stated query set: they are numbered word by word and
sent to the executors in blocks of bounded size, one after the other; every document is
held against every block, and a block's findings are stored before it goes. Rolling hashes of ``min_match`` words give the seeds; runs of seeds
are the maximal common stretches; the longest ones are marked first, and what a
mark covers of a later stretch is cut away, so passages count in any order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import written

_WORDS = regex.compile(r"[\p{L}\p{N}]+|\x01").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PART = 2_000_000  # characters worked on at once
_HITS = 4_000_000  # places of items worked on at once


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return _WORDS(text.replace("\x01", " ").lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x, h = (ids + 2).astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h *= _BASE
        h += x[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def tiles(matches: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (document start, item start, length):
    longest first (then by position), each cut to its longest unmarked parts."""
    heap = [(-n, p, q) for p, q, n in matches]
    heapq.heapify(heap)
    used_p, used_q, out = set(), set(), []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = [p + i not in used_p and q + i not in used_q for i in range(n)]
        if all(free):
            used_p.update(range(p, p + n))
            used_q.update(range(q, q + n))
            out.append((p, q, n))
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= min_match:
                    heapq.heappush(heap, (start - i, p + start, q + start))
                start = None
    return out


class ItemIndex:
    """Word numbers, texts and seeds of one block of items."""

    def __init__(self, texts: list[str], k: int) -> None:
        self.k, self.vocab = k, {}
        number, parts, owner, self.lengths = self.vocab.setdefault, [], [], []
        for i, t in enumerate(texts):
            ids = [number(w, len(self.vocab)) for w in words(t)]
            self.lengths.append(len(ids))
            parts += [*ids, -1]
            owner += [i] * (len(ids) + 1)
        self.ids, self.owner = np.array(parts, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.array(self.lengths, dtype=np.int64) + 1)])
        at = np.flatnonzero(_whole(self.ids, k))
        h = rolling(self.ids, k)[at]
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of ``ids`` whose hash the items have: their places, and where in the order
        of hashes it stands how often."""
        where = np.flatnonzero(_whole(ids, self.k))
        if not len(where) or not len(self.hashes):
            return where[:0], where[:0], where[:0]
        h = rolling(ids, self.k)[where]
        lo = np.searchsorted(self.hashes, h, "left")
        hit = self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h
        where, lo = where[hit], lo[hit]
        return where, lo, np.searchsorted(self.hashes, h[hit], "right") - lo

    def matches(self, ids: np.ndarray, where: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal common stretches of at least k words from seeds: start in ``ids``, start in
        the items, length. Negative ids match nothing."""
        none = np.zeros(0, dtype=np.int64)
        p = np.repeat(where, n)
        q = self.at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(p), dtype=bool)
        for j in range(self.k):  # equal hashes are verified word by word
            same &= ids[p + j] == self.ids[q + j]
        p, q = p[same], q[same]
        order = np.lexsort((p, q - p))
        p, q = p[order], q[order]
        if not len(p):
            return none, none, none
        new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(q - p) != 0)])
        head = np.flatnonzero(new)
        return p[head], q[head], np.diff(np.concatenate([head, [len(p)]])) + self.k - 1


def _whole(ids: np.ndarray, k: int) -> np.ndarray:
    """Where k ids in a row are known words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    return bad[k:] == bad[:n]


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, item_text: str, min_match: int = 12, min_coverage: float = 0.0, block_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id, longest, tiled_words, n_tiles, item_words, coverage`` of every document and item
    whose tiles of at least ``min_match`` words cover ``min_coverage`` of the
    item's words; ``longest`` is the longest common stretch in words.

    Words are maximal runs of letters or digits, compared in lower case. Defined
    cases: null or empty texts have no words and give no row; items shorter than
    ``min_match`` words cannot be found; repeated documents and repeated items
    each have their own rows; texts of any length are searched whole; further
    columns are not read. Items go out in blocks of at most ``block_chars``
    characters, so the broadcast is bounded and more items mean more blocks.
    """
    spark = docs.sparkSession
    src = items.select(items[item_id].alias("i"), items[item_text].alias("t")).filter(F.col("t").isNotNull())
    blocks = max(1, -(-(src.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    corpus = docs.select(docs[doc_id].alias("d"), docs[text].alias("t")).filter(F.col("t").isNotNull())
    did, iid = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {did}, item_id {iid}, longest int, tiled_words int, n_tiles int, item_words int, coverage double"
    out = None
    for b in range(blocks):
        rows = (src.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else src).collect()
        sent = spark.sparkContext.broadcast(([r["i"] for r in rows], ItemIndex([r["t"] for r in rows], min_match)))
        got = written(corpus.mapInArrow(_searcher(sent, min_match, min_coverage), schema), "leaks")
        sent.destroy()
        out = got if out is None else out.unionByName(got)
    return out


def _shares(where: np.ndarray, n: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Seeds of documents (which end before ``ends``) in shares of at most ``_HITS`` places of items,
    or one document: wording that many items have is not expanded for all documents at once."""
    so_far, edges = np.concatenate([[0], np.cumsum(n)]), np.unique(np.append(np.searchsorted(where, ends), len(where)))
    out, first = [], 0
    while first < len(where):
        after = int(np.searchsorted(edges, first, "right"))
        stop = int(edges[max(after, int(np.searchsorted(so_far[edges], so_far[first] + _HITS, "right")) - 1)])
        out.append((first, stop))
        first = stop
    return out


def _searcher(sent, min_match: int, min_coverage: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = sent.value
        get = index.vocab.get
        for b in batches:
            texts = b.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(7)]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (size < _PART or stop == start):
                    size += len(texts[stop])
                    stop += 1
                joined = " \x01 ".join(t.replace("\x01", " ") for t in texts[start:stop]).lower()
                found = _WORDS(joined)
                # documents are kept apart by a word that no item has
                ids = np.fromiter(map(get, found, repeat(-1)), dtype=np.int64, count=len(found))
                ends = np.flatnonzero(np.fromiter((w == "\x01" for w in found), dtype=bool, count=len(found)))
                seeds = index.seeds(ids)
                for first, last in _shares(seeds[0], seeds[2], ends):
                    p, q, n = index.matches(ids, *(x[first:last] for x in seeds))
                    if not len(p):
                        continue
                    of_doc, of_item = np.searchsorted(ends, p), index.owner[q]
                    order = np.lexsort((of_item, of_doc))
                    key = of_doc[order] * len(names) + of_item[order]
                    for part in np.split(order, np.flatnonzero(np.diff(key)) + 1):
                        marked = tiles([(int(p[x]), int(q[x]), int(n[x])) for x in part], min_match)
                        item, total = int(of_item[part[0]]), sum(m for _, _, m in marked)
                        length = index.lengths[item]
                        if total >= min_coverage * length:
                            for c, v in zip(cols, (start + int(of_doc[part[0]]), names[item], max(m for _, _, m in marked), total, len(marked), length, total / length)):
                                c.append(v)
                start = stop
            if cols[0]:
                first = b.column(0).take(pa.array(cols[0]))
                i32 = lambda c: pa.array(c, type=pa.int32())
                yield pa.RecordBatch.from_arrays([first, pa.array(cols[1]), *map(i32, cols[2:6]), pa.array(cols[6], type=pa.float64())], names=["doc_id", "item_id", "longest", "tiled_words", "n_tiles", "item_words", "coverage"])

    return search
