"""An addition of this engine: unit and event counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions.sequences import symbols


def windowed_counts(stream: DataFrame, time: str, key: str, *, window: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, end, key, n`` per window; rows later than the watermark are dropped."""
    over = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return stream.withWatermark(time, late).groupBy(over.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("w.start", "w.end", "key", "n")


def pair_counts(stream: DataFrame, seq: str) -> DataFrame:
    """Running ``left, right, cnt`` of adjacent symbols of arriving sequences."""
    s = stream.select(symbols(seq).alias("s"))
    zipped = F.transform(F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("left"), F.get(F.col("s"), i + 1).alias("right")))
    return s.select(F.explode(zipped).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("cnt"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what has arrived into Parquet and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what has arrived into running totals: Parquet, replaced as a whole by each batch."""
    df.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
