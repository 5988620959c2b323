"""References to records that do not exist.

Keys are cut into ranges that hold about as many rows each, bounds drawn from the
keys of both sides. Each range holds its parents as one sorted array; batches of
references are probed against it by binary search. The references of a range with
more rows than ``block_rows`` are dealt to several blocks, each with a copy of the
range's parents, so one key on a third of all rows makes more blocks, not a longer task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANGES = 65_536
_POINTS = 400_000  # keys that the bounds are drawn from, about
_WIDE = 64
_NEVER = np.iinfo(np.int64).max
_FIRST = np.iinfo(np.int64).min


def _fixed(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Strings as fixed-width bytes that sort and compare exactly; keys beyond
    64 bytes become digests with a mark that no shorter key has."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    if not len(keys):
        return np.zeros(0, dtype=f"S{_WIDE + 2}")
    raw = keys.cast(pa.binary())
    odd = pc.or_(pc.greater(pc.binary_length(raw), _WIDE), pc.or_(pc.invert(pc.string_is_ascii(keys)), pc.ends_with(keys, "\0")))
    out = np.zeros(len(keys), dtype=f"S{_WIDE + 2}")
    plain = pc.ascii_rpad(keys.filter(pc.invert(odd)), _WIDE + 2, "\0").cast(pa.binary())
    flat = np.frombuffer(plain.buffers()[2], dtype=f"S{_WIDE + 2}", count=len(plain), offset=np.frombuffer(plain.buffers()[1], dtype=np.int32)[plain.offset]) if len(plain) else out[:0]
    odd = odd.to_numpy(zero_copy_only=False)
    out[~odd] = flat
    # only keys that are long or not ASCII are handled one by one
    for i in np.flatnonzero(odd):
        k = raw[int(i)].as_py()
        out[i] = k if len(k) <= _WIDE and not k.endswith(b"\0") else b"\xff" + hashlib.blake2b(k, digest_size=32).digest() + b"\xff"
    return out


def _points(most: int):
    """``point, rows``: every so many keys of a task in their order, and how many each stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate([_fixed(pa.array([], type=pa.string())), *(_fixed(b.column(0)) for b in batches)]))
        if len(keys):
            cuts = np.unique(np.linspace(0, len(keys), min(most, len(keys)) + 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[(cuts[:-1] + cuts[1:]) // 2].tolist(), type=pa.binary()), pa.array(np.diff(cuts))], names=["point", "rows"])

    return run


class Ranges:
    """Ranges of the keys with about ``rows`` of the rows that the points stand for, ``least`` of
    them if there are as many points, and the blocks of each."""

    def __init__(self, points: list[bytes], weights: list[int], rows: int, least: int, block_rows: int) -> None:
        order = np.argsort(np.array(points, dtype=f"S{_WIDE + 2}"), kind="stable") if points else np.zeros(0, dtype=np.int64)
        key, weight = np.array(points, dtype=f"S{_WIDE + 2}")[order], np.array(weights, dtype=np.int64)[order]
        before = np.cumsum(weight) - weight
        n = int(min(MAX_RANGES, max(least, -(-int(weight.sum()) // rows), 1)))
        at = np.searchsorted(before, np.arange(1, n) * (weight.sum() / n))
        # a key begins a range, so rows of one key stay in one; a range begins behind it too
        self.bounds = np.unique(key[np.minimum(at, len(key) - 1)]) if len(key) else key
        share = np.bincount(self.of(key), weights=weight, minlength=len(self.bounds) + 1)
        self.blocks = np.maximum(1, -(-share.astype(np.int64) // block_rows))
        self.first = np.cumsum(self.blocks) - self.blocks
        self.count = int(self.blocks.sum())

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, "right")

    def deal(self, copies: bool):
        """Adds ``home`` to rows by their first column: references go to one block of their range
        each in turn, parents to all of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn = 0
            for b in batches:
                r = self.of(_fixed(b.column(0)))
                if copies:
                    n = self.blocks[r]
                    at = np.repeat(np.arange(len(r)), n)
                    home = self.first[r][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    b = b.take(pa.array(at))
                else:
                    home = self.first[r] + (turn + np.arange(len(r))) % self.blocks[r]
                    turn += len(r)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32))], names=[*b.schema.names, "home"])

        return run


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    key = _fixed(parents["pkey"])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = parents["first"].combine_chunks().fill_null(_FIRST).to_numpy(zero_copy_only=False)[order]
    gone = parents["gone"].combine_chunks().fill_null(_NEVER).to_numpy(zero_copy_only=False)[order]
    ref, at = _fixed(refs["rkey"]), refs["at"].combine_chunks()
    when, known = at.fill_null(0).to_numpy(zero_copy_only=False), at.is_valid().to_numpy(zero_copy_only=False)
    if len(key):
        pos = np.searchsorted(key, ref)
        near = np.minimum(pos, len(key) - 1)
        hit = (pos < len(key)) & (key[near] == ref)
    else:
        near, hit = np.zeros(len(ref), dtype=np.int64), np.zeros(len(ref), dtype=bool)
    reason = np.zeros(len(ref), dtype=np.int8)
    if len(key):
        reason[hit & known & (when < first[near])] = 2
        reason[hit & known & (when >= gone[near])] = 3
    reason[~hit] = 1
    bad = reason > 0
    names = np.array([None, "absent", "not_yet", "withdrawn"], dtype=object)[reason[bad]]
    kept = refs.filter(pa.array(bad))
    drop = ("rkey", "at", "home")
    cols = {n: kept[n] for n in kept.column_names if n not in drop}
    return pa.table(cols | {"reason": pa.array(names, type=pa.string())})


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    ref_key: str,
    ref_time: str | None,
    parent_key: str,
    parent_first: str | None = None,
    parent_gone: str | None = None,
    carry: list[str],
    block_rows: int = 500_000,
    range_rows: int = 200_000,
) -> DataFrame:
    """Rows of ``refs`` whose key has no valid parent, with ``carry`` columns and ``reason``.

    ``reason`` is ``absent`` (no parent of that key), ``not_yet`` (the row is
    earlier than the parent's earliest ``parent_first``) or ``withdrawn`` (the
    row is at or after the earliest ``parent_gone``; it wins over ``not_yet``).

    Defined cases: a null key refers to nothing and is never reported; a null
    time is only tested for absence; a parent with null times has no such bound;
    repeated parents count with their earliest times; repeated references each
    come out; empty refs give no row and empty parents report every reference.
    Columns are named explicitly, so further or clashing columns of either side
    do no harm; keys of any length compare exactly up to a 256-bit digest.
    """
    micros = lambda df, c: F.unix_micros(df[c].cast("timestamp")) if c else F.lit(None).cast("long")
    least = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = [f"carry_{i}" for i in range(len(carry))]
    p = parents.select(parents[parent_key].alias("pkey"), micros(parents, parent_first).alias("first"), micros(parents, parent_gone).alias("gone")).filter(F.col("pkey").isNotNull())
    r = refs.select(refs[ref_key].alias("rkey"), micros(refs, ref_time).alias("at"), *(refs[c].alias(i) for c, i in zip(carry, inner))).filter(F.col("rkey").isNotNull())
    keys = r.select("rkey").unionByName(p.select(F.col("pkey").alias("rkey")))
    # a bounded number of keys in all, whatever the number of tasks
    drawn = keys.mapInArrow(_points(max(1, min(256, _POINTS // max(1, keys.rdd.getNumPartitions())))), "point binary, rows long").toArrow()
    ranges = Ranges(drawn["point"].to_pylist(), drawn["rows"].to_pylist(), range_rows, least, block_rows)
    p = p.groupBy("pkey").agg(F.min("first").alias("first"), F.min("gone").alias("gone"))
    dealt = lambda df, copies: df.mapInArrow(ranges.deal(copies), T.StructType([*df.schema.fields, T.StructField("home", T.IntegerType())])).repartitionById(ranges.count, "home").groupBy("home")
    schema = T.StructType([T.StructField(i, refs.schema[c].dataType) for c, i in zip(carry, inner)] + [T.StructField("reason", T.StringType())])
    found = dealt(r, False).cogroup(dealt(p, True)).applyInArrow(_probe, schema)
    return found.select(*(F.col(i).alias(c) for c, i in zip(carry, inner)), "reason")
