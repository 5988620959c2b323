"""Per-key results where a few keys hold most rows.

Each input split encodes its keys against a dictionary of its own and adds
into dense arrays with ``bincount``; equal splits take equal time however the
keys are spread. The arrays are cut into hash blocks and summed block by block,
in a tree whose fan-in is bounded, so no task sees more than one entry per key
and split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCHEMA = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("total", T.ArrayType(T.DoubleType()))])


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = pa.array(np.concatenate(parts), type=kind) if parts else pa.array([], type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)


class _Dense:
    """Dense accumulators over a growing dictionary."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.n, self.total = np.zeros(1024, dtype=np.int64), np.zeros(1024)

    def add(self, keys: pa.Array, n: np.ndarray | None, total: np.ndarray) -> None:
        coded = keys.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_pylist()
        own = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words), dtype=np.int64, count=len(words))
        while len(self.ids) > len(self.n):
            self.n, self.total = np.concatenate([self.n, np.zeros_like(self.n)]), np.concatenate([self.total, np.zeros_like(self.total)])
        if n is None:
            self.n[own] += np.bincount(index, minlength=len(words))
        else:
            np.add.at(self.n, own[index], n)
        self.total[own] += np.bincount(index, weights=total, minlength=len(words))

    def blocks(self, count: int, part: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        keys = np.array(list(self.ids), dtype=object)
        block = (pd.util.hash_array(keys, categorize=False) % np.uint64(count)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        rows = np.split(order, cuts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block[r[0]] for r in rows], type=pa.int32()), pa.array([part] * len(rows), type=pa.int32()), _lists([keys[r] for r in rows], pa.string()), _lists([self.n[r] for r in rows], pa.int64()), _lists([self.total[r] for r in rows], pa.float64())],
            names=["block", "part", "keys", "n", "total"],
        )


def per_key_totals(df: DataFrame, key: str, value: str | None = None, *, blocks: int | None = None, fan_in: int = 256, flush_keys: int = 1_000_000) -> DataFrame:
    """``key_id, n_rows, total`` for every non-null key of ``df``.

    ``n_rows`` counts rows, repeats included; ``total`` adds the non-null
    ``value``s as doubles (0 without a value column). A null key has no row; an
    empty table gives no row; the empty string is a key like any other.
    Only the two named columns are read, whatever else the table holds.
    """
    spark = df.sparkSession
    src = df.select(df[key].cast("string").alias("k"), (df[value].cast("double") if value else F.lit(0.0)).alias("v")).filter(F.col("k").isNotNull())
    splits = src.rdd.getNumPartitions()
    # a split has a bounded number of keys, so blocks that grow with the splits stay bounded
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), splits // 4)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, acc = TaskContext.get().partitionId(), _Dense()
        for b in batches:
            acc.add(b.column(0), None, np.nan_to_num(b.column(1).fill_null(0.0).to_numpy(zero_copy_only=False)))
            if len(acc.ids) > flush_keys:
                yield from acc.blocks(blocks, part)
                acc = _Dense()
        yield from acc.blocks(blocks, part)

    def summed(t: pa.Table) -> _Dense:
        acc = _Dense()
        flat = lambda c: c.combine_chunks().flatten()
        acc.add(flat(t["keys"]), flat(t["n"]).to_numpy(zero_copy_only=False), flat(t["total"]).to_numpy(zero_copy_only=False))
        return acc

    def reduce(t: pa.Table) -> pa.Table:
        block, part = t["block"][0].as_py(), t["part"][0].as_py()
        acc = summed(t)
        m = len(acc.ids)
        return pa.table({"block": pa.array([block], type=pa.int32()), "part": pa.array([part], type=pa.int32()), "keys": _lists([np.array(list(acc.ids), dtype=object)], pa.string()), "n": _lists([acc.n[:m]], pa.int64()), "total": _lists([acc.total[:m]], pa.float64())})

    def last(t: pa.Table) -> pa.Table:
        acc = summed(t)
        m = len(acc.ids)
        return pa.table({"key_id": pa.array(list(acc.ids), type=pa.string()), "n_rows": pa.array(acc.n[:m]), "total": pa.array(acc.total[:m])})

    arrays = src.mapInArrow(local, _SCHEMA)
    while splits > fan_in:
        splits = -(-splits // fan_in)
        arrays = arrays.withColumn("part", F.pmod(F.col("part"), F.lit(splits)).cast("int")).groupBy("block", "part").applyInArrow(reduce, _SCHEMA)
    return arrays.groupBy("block").applyInArrow(last, "key_id string, n_rows long, total double")
