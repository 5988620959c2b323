"""Merging overlapping intervals and listing the gaps.

Each entity's intervals are sorted by start within coarse ranges of the
coordinate; one small row per entity and range carries the largest end seen
before it, so the running maximum goes on across ranges while no task sorts more
than one range of one entity. A start beyond the running maximum opens an island
and, but for the first, closes a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.session import written


def islands_and_gaps(df: DataFrame, entity: str, start: str, end: str, *, min_start: int | None = None, range_width: int = 16_384, step: int = 1) -> DataFrame:
    """``entity_id, kind, start_index, end_index`` with kind ``covered`` or ``gap``.

    Both ends are included; an interval that starts at most ``step`` after the
    running end continues its stretch (1: touching residues are one).
    Rows with a null entity or bound, a start above its end or a start below
    ``min_start`` are left out. Equal intervals and repeated rows change nothing;
    an empty table gives no row. Only the three named columns are read.
    """
    src = df.select(df[entity].alias("e"), df[start].cast("long").alias("s"), df[end].cast("long").alias("t")).filter(F.col("e").isNotNull() & F.col("s").isNotNull() & (F.col("s") <= F.col("t")))
    if min_start is not None:
        src = src.filter(F.col("s") >= min_start)
    # one row per entity and start: repeats end here, before the sort; read twice, so written
    src = written(src.groupBy("e", "s").agg(F.max("t").alias("t")).withColumn("r", F.floor(F.col("s") / range_width)), "starts")
    by_range = W.partitionBy("e", "r").orderBy("s")
    over = W.partitionBy("e").orderBy("r")
    carried = src.groupBy("e", "r").agg(F.max("t").alias("m")).withColumn("carry", F.max("m").over(over.rowsBetween(W.unboundedPreceding, -1)))
    opened = (
        src.join(carried.select("e", "r", "carry"), ["e", "r"])
        .withColumn("prev", F.greatest("carry", F.max("t").over(by_range.rowsBetween(W.unboundedPreceding, -1))))
        .filter(F.col("prev").isNull() | (F.col("s") > F.col("prev") + step))
        .select("e", "r", "s", "prev")
    )
    # the end of an island is the running maximum where the next one opens
    after = W.partitionBy("e").orderBy("r").rowsBetween(1, W.unboundedFollowing)
    heads = carried.select("e", "r", "m").join(opened.groupBy("e", "r").agg(F.min_by("prev", "s").alias("head_prev"), F.count("*").alias("opens")), ["e", "r"], "left")
    heads = heads.withColumn("next_prev", F.first(F.when(F.col("opens").isNotNull(), F.col("head_prev")), ignorenulls=True).over(after)).withColumn("last", F.max("m").over(W.partitionBy("e")))
    rows = opened.join(heads.select("e", "r", "next_prev", "last"), ["e", "r"]).withColumn("stop", F.coalesce(F.lead("prev").over(by_range), "next_prev", "last"))
    covered = F.struct(F.lit("covered").alias("kind"), F.col("s").alias("a"), F.col("stop").alias("b"))
    gap = F.when(F.col("prev").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("prev") + 1).alias("a"), (F.col("s") - 1).alias("b")))
    both = rows.select("e", F.explode(F.filter(F.array(covered, gap), lambda x: x.isNotNull())).alias("x"))
    return both.select(F.col("e").alias("entity_id"), F.col("x.kind").alias("kind"), F.col("x.a").alias("start_index"), F.col("x.b").alias("end_index"))
