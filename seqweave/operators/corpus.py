"""Curating corpora: filters, first-wins tables, symbols and adjacent pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.functions.sequences import letter_count, symbols

#: Letters a training sequence may hold at most once each (fixed values).
RARE = ("X", "B", "U", "Z")


def quality_filter(df: DataFrame, seq: str, *, max_len: int = 3000, min_len: int = 1, rare: tuple = RARE, most: int = 1) -> DataFrame:
    """Rows whose sequence has ``min_len`` to ``max_len`` symbols and at most ``most``
    of each rare letter; null sequences are left out."""
    keep = F.length(seq).between(min_len, max_len)
    for x in rare:
        keep = keep & (letter_count(seq, x) <= most)
    return df.filter(keep)


def said_true(flag: str, text: str = "True") -> Column:
    """Whether a truth value kept as text says so; null says no."""
    return F.coalesce(F.col(flag) == text, F.lit(False))


def without_long_parents(slices: DataFrame, key: str, whole: DataFrame, whole_key: str, seq: str, max_len: int = 3000) -> DataFrame:
    """Slices of sequences whose whole is not above ``max_len``: an anti join, so a
    slice without a whole stays."""
    long = whole.filter(F.length(seq) > max_len).select(F.col(whole_key).alias(key)).distinct()
    return slices.join(long, key, "left_anti")


def alphabet(df: DataFrame, seq: str) -> DataFrame:
    """``symbol``: the distinct letters."""
    return df.select(F.explode(symbols(seq)).alias("symbol")).distinct()


def adjacent_pairs(df: DataFrame, symbol_array: Column | None = None, seq: str = "sequence") -> DataFrame:
    """``left, right, cnt`` of neighbouring symbols, overlaps included (AAA: 2)."""
    s = symbol_array if symbol_array is not None else symbols(seq)
    zipped = F.transform(F.slice(F.col("s"), F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("left"), F.get(F.col("s"), i + 1).alias("right")))
    return df.select(s.alias("s")).select(F.explode(zipped).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("cnt"))


def first_rows(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by an explicit order (first writer wins)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list, order: list, required: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(inserted, rejected): of ``rows``, the first of each key that ``target`` lacks,
    and all others. Rows with a null in ``required`` are rejected; keys compare as
    SQL unique keys do, so a null key never repeats another."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    numbered = rows.withColumn("_n", F.when(null_key, 1).otherwise(F.row_number().over(W.partitionBy(*keys).orderBy((~whole).cast("int"), *order))))
    have = target.select(*keys).dropna().distinct().withColumn("_have", F.lit(True))
    marked = numbered.join(have, keys, "left").withColumn("_in", whole & (F.col("_n") == 1) & F.col("_have").isNull())
    back = lambda flag: marked.filter(flag).select(*rows.columns)
    return back(F.col("_in")), back(~F.col("_in"))


def occurrence_number(df: DataFrame, keys: list, order: list, name: str = "occurrence") -> DataFrame:
    """Numbers the rows of each key from 1 by an explicit order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def undersampled(df: DataFrame, group: str, ident: Column, limit: Column | int, seed: str = "42") -> DataFrame:
    """At most ``limit`` rows of each group, chosen by the md5 of (seed, ident); groups
    within the limit are kept whole."""
    order = F.md5(F.concat_ws("|", F.lit(seed), ident))
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(order, ident))).filter(F.col("_n") <= limit).drop("_n")


def hash_sample(df: DataFrame, ident: Column, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows chosen by the md5 of (seed, ident)."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), ident))).orderBy("_h", ident).limit(n).drop("_h")
