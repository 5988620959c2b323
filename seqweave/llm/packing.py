"""Filling fixed-capacity containers with texts measured in tokens.

Items are dealt by hash to partitions of bounded size and packed best-fit
decreasing. Dual feasible functions give each partition a proven lower bound on
its number of containers; the partitions above theirs give the documents of
their slack containers to an exchange, which is packed again in new, fewer
partitions. This goes on until every partition is certified or an exchange saves no
container; that one is not taken.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import written

#: Pre-tokenisation of the public byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts a text's tokens: merges never cross the pattern's pieces, so the
    count of a text is the sum over its pieces, which are looked up."""

    def __init__(self, ranks_path: str, pattern: str = PATTERN, remembered: int = 400_000) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split, self.remembered, self.known = regex.compile(pattern).findall, remembered, {}

    def count(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.split(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(piece) <= 40:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[piece] = n
            total += n
        return total


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(df: DataFrame, id_col: str, text_col: str, ranks_path: str) -> DataFrame:
    """``id, n_tokens`` of every non-null text; an empty text has 0 tokens."""
    kind = df.schema[id_col].dataType

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(ranks_path) or _COUNTERS.setdefault(ranks_path, TokenCounter(ranks_path))
        for b in batches:
            n = [counter.count(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64())], names=["id", "n_tokens"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text")).filter(F.col("text").isNotNull())
    return src.mapInArrow(sizes, f"id {kind.simpleString()}, n_tokens long")


def lower_bound(hist: np.ndarray, capacity: int, steps: int = 24) -> int:
    """A proven lower bound on the containers of items counted by size: the largest
    over the volume bound, the functions that round sizes above capacity - e up and
    below e down, and the staircase functions of 2 to ``steps`` + 1 equal parts."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((hist * x).sum()) // capacity)
    items, volume = np.cumsum(hist), np.cumsum(hist * x)
    e = np.arange(1, capacity // 2 + 1)
    high = items[-1] - items[capacity - e]
    mid = volume[capacity - e] - volume[e - 1]
    best = max(best, int((-(-(high * capacity + mid) // capacity)).max(initial=0)))
    for k in range(1, steps + 1):
        # in units of capacity / (k (k + 1)), so that all values are integers over capacity
        exact = ((k + 1) * x) % capacity == 0
        f = np.where(exact, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((hist * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; a bit per residual capacity finds the tightest."""
    out = np.empty(len(sizes), dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        open_[r - s].append(b)
        mask |= 1 << (r - s)
    return out


_PACKED = "id {}, copy long, piece int, n_tokens long, round int, part long, bin long, fill long, bins long, bound long"


def _pack(capacity: int, number: int):
    def run(t: pa.Table) -> pa.Table:
        sizes = t["n_tokens"].to_numpy()
        # the same items make the same containers, in whatever order they come
        order = np.lexsort((t["order"].to_numpy(), -sizes))
        where = np.empty(len(sizes), dtype=np.int64)
        where[order] = best_fit_decreasing(sizes[order], capacity)
        fill = np.bincount(where, weights=sizes).astype(np.int64)
        same = lambda v, k=pa.int64(): pa.array(np.full(len(sizes), v), type=k)
        cols = {"id": t["id"], "copy": t["copy"], "piece": t["piece"], "n_tokens": t["n_tokens"], "round": same(number, pa.int32()), "part": t["part"], "bin": pa.array(where), "fill": pa.array(fill[where]), "bins": same(len(fill)), "bound": same(lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity))}
        return pa.table(cols)

    return run


def pack(sizes: DataFrame, *, capacity: int = 2048, part_items: int = 100_000, slack: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """Containers of ``sizes`` (``id, n_tokens``), and their certificate.

    First table: ``id, piece, token_start, n_tokens, container``; an item above the
    capacity is cut into pieces of exactly the capacity and one rest, any other
    is whole with piece 0. Second: ``round, part, items, containers, lower_bound, unused``
    of every packing made, with part -1 for all partitions of a round together, and last
    a row with round -1 for the containers of the first table as they are, against
    the bound of all items; ``unused`` is the room left in tokens.

    Defined cases: items of 0 tokens take a place like others; a null size is left
    out; equal items and repeated rows are each packed; an empty table gives none; the
    result does not depend on the order or the files the rows come in.
    A partition gets about ``part_items`` items whatever the table's size;
    containers with more than ``slack`` of their room unused are exchanged.
    """
    kind = sizes.schema["id"].dataType.simpleString()
    schema = _PACKED.format(kind)
    # rows that repeat are told apart by a number, so dealing needs no order of the input
    whole = sizes.filter(F.col("n_tokens").isNotNull()).groupBy("id", "n_tokens").agg(F.count("*").alias("copies"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = whole.select("id", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("id", "n_tokens", "copy", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
    items = items.select("id", "copy", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("long").alias("n_tokens"))

    def packed(df: DataFrame, number: int) -> DataFrame:
        parts = max(1, -(-df.count() // part_items))
        order = F.xxhash64("id", "copy", "piece", F.lit(number))
        dealt = df.select("id", "copy", "piece", "n_tokens", order.alias("order")).withColumn("part", F.pmod(F.shiftright("order", 7), F.lit(parts)).cast("long"))
        return written(dealt.groupBy("part").applyInArrow(_pack(capacity, number), schema), f"packed-{number}")

    def bound_of(df: DataFrame) -> int:
        hist = df.groupBy("n_tokens").count().collect()  # at most capacity + 1 sizes
        counts = np.zeros(capacity + 1, dtype=np.int64)
        counts[[r["n_tokens"] for r in hist]] = [r["count"] for r in hist]
        return lower_bound(counts, capacity) if hist else 0

    def certificate(df: DataFrame) -> DataFrame:
        room = (F.col("containers") * capacity - F.col("tokens")).alias("unused")
        each = df.groupBy("round", "part").agg(F.count("*").alias("items"), F.max("bins").alias("containers"), F.max("bound").alias("lower_bound"), F.sum("n_tokens").alias("tokens"))
        total = each.groupBy("round").agg(F.lit(-1).cast("long").alias("part"), F.sum("items").alias("items"), F.sum("containers").alias("containers"), F.lit(bound_of(df)).cast("long").alias("lower_bound"), F.sum("tokens").alias("tokens"))
        return each.unionByName(total).select("round", "part", "items", "containers", "lower_bound", room)

    now, final, report, number = packed(items, 0), [], [], 0
    report.append(certificate(now))
    everything = bound_of(now)
    while True:
        number += 1
        loose = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity * (1 - slack))
        pool = now.filter(loose)
        before = pool.select("round", "part", "bin").distinct().count()
        if before < 2:
            break
        again = packed(pool, number)
        after = again.select("part", "bin").distinct().count()
        if after >= before:
            break
        final.append(now.filter(~loose))
        report.append(certificate(again))
        now = again
    final.append(now)
    out = reduce(DataFrame.unionByName, final)
    used = out.groupBy("round", "part", "bin").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    last = used.agg(F.lit(-1).alias("round"), F.lit(-1).cast("long").alias("part"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.count("*").alias("containers"), F.lit(everything).cast("long").alias("lower_bound"), F.coalesce(F.count("*") * capacity - F.sum("tokens"), F.lit(0)).alias("unused"))
    out = out.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("token_start"), "n_tokens", F.format_string("%d-%d-%d", "round", "part", "bin").alias("container"))
    return out, reduce(DataFrame.unionByName, report).unionByName(last.filter("containers > 0"))
