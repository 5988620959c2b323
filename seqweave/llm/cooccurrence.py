"""Items that appear together: an incremental table of pair counts.

The table keeps, in a shared folder, the items of every basket and the number of
baskets of every item as logs of signed changes, and the number of baskets of every
pair in hash buckets. A change names added or removed (basket, item) rows; only the
baskets it touches emit signed deltas, only the buckets these fall in are written
anew, only the scores of items it touches are computed again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.session import lasting_path

_PAIRS = "a string, b string, joint long"
_ITEMS = "item string, n long"
_BASKETS = "basket string, item string, sign int"
_COUNTS = "a string, b string, joint long, n_a long, n_b long"


class PairTable:
    """Counts of baskets, items and pairs of items that share a basket.

    Defined cases: null baskets are left out; a null item makes its basket count and is
    no item; repeated rows count once, in a change as in the table; removing what is
    not there changes nothing; an item added and removed in one change is removed; an
    item has no pair with itself; empty changes and tables are allowed.

    A bucket holds about ``bucket_rows`` pairs: their number doubles as the table grows.
    Logs of more than ``compact`` changes are written anew as one.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, *, bucket_rows: int = 2_000_000, chunk: int = 512, compact: int = 16) -> None:
        self.spark, self.root, self.bucket_rows, self.chunk, self.compact = spark, root or lasting_path(spark, "pairs"), bucket_rows, chunk, compact
        self.version, self.baskets, self.state = 0, 0, {"buckets": 1, "rows": 0, "pairs": {}, "items": [], "own": [], "scores": None}

    # -- reading

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def contents(self) -> DataFrame:
        """``basket, item``: what every basket holds."""
        return self._held(self._read(self.state["own"], _BASKETS)).filter("old > 0 AND item IS NOT NULL").select("basket", "item")

    @staticmethod
    def _held(log: DataFrame) -> DataFrame:
        return log.groupBy("basket", "item").agg(F.sum("sign").cast("int").alias("old"))

    def items(self) -> DataFrame:
        """``item, n``: the number of baskets of every item."""
        return self._read(self.state["items"], _ITEMS).groupBy("item").agg(F.sum("n").alias("n")).filter("n <> 0")

    def pairs(self, buckets: list[int] | None = None) -> DataFrame:
        """``a, b, joint``: the baskets that hold both, a < b."""
        known = self.state["pairs"]
        return self._read([p for k, p in sorted(known.items()) if buckets is None or k in buckets], _PAIRS)

    # -- changing

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        """Apply a change; gives the items it touched (``item``)."""
        spark, at = self.spark, f"{self.root}/v{self.version + 1}"
        none = spark.createDataFrame([], "basket string, item string")
        plain = lambda df: none if df is None else df.select(F.col(df.columns[0]).cast("string").alias("basket"), F.col(df.columns[1]).cast("string").alias("item")).filter("basket IS NOT NULL")
        mark = lambda df, old, add, rem: df.select("basket", "item", F.lit(old).alias("old") if isinstance(old, int) else old, F.lit(add).alias("add"), F.lit(rem).alias("rem"))
        given = [mark(plain(added), 0, 1, 0)] + ([mark(plain(removed), 0, 0, 1)] if removed is not None else [])
        if self.version:
            # rows of the table enter only for baskets that the change names
            named = given[0].select("basket").unionByName(given[-1].select("basket")).distinct()
            given.append(mark(self._read(self.state["own"], _BASKETS).join(named, "basket", "left_semi"), F.col("sign").alias("old"), 0, 0))
        rows = given[0]
        for g in given[1:]:
            rows = rows.unionByName(g)
        rows = rows.groupBy("basket", "item").agg(F.sum("old").cast("int").alias("old"), F.max("add").alias("add"), F.max("rem").alias("rem"))
        rows = rows.withColumn("new", F.greatest("old", "add") * (1 - F.col("rem"))).filter("old + new > 0").select("basket", "item", "old", "new")
        rows.write.parquet(f"{at}/changed")
        rows = spark.read.schema("basket string, item string, old int, new int").parquet(f"{at}/changed")
        moved = F.col("new") - F.col("old")
        sizes = rows.groupBy("basket").agg(F.max("old").alias("old"), F.max("new").alias("new"), F.max(moved).alias("up"), F.min(moved).alias("down"), F.count("item").alias("m"))
        self.baskets += sizes.agg(F.coalesce(F.sum(moved), F.lit(0))).first()[0]
        touched = sizes.filter("(up > 0 OR down < 0) AND m > 1").select("basket", F.ceil(F.col("m") / self.chunk).cast("int").alias("chunks"))
        sets = rows.filter("item IS NOT NULL").join(touched, "basket").withColumn("c", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
        # a basket of many items is dealt to pairs of chunks, so none is worked off in one task
        later = sets.select("basket", "item", "old", "new", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("chunks") - 1)).alias("j"))
        prior = sets.select("basket", F.col("item").alias("item2"), F.col("old").alias("old2"), F.col("new").alias("new2"), F.explode(F.sequence(F.lit(0), "c")).alias("i"), F.col("c").alias("j"))
        both = later.join(prior, ["basket", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("item") < F.col("item2")))
        sign = F.col("new") * F.col("new2") - F.col("old") * F.col("old2")
        delta = both.select(F.least("item", "item2").alias("a"), F.greatest("item", "item2").alias("b"), sign.cast("long").alias("joint")).filter("joint <> 0").groupBy("a", "b").agg(F.sum("joint").alias("joint")).filter("joint <> 0")
        delta.write.parquet(f"{at}/delta")
        self._merge(spark.read.schema(_PAIRS).parquet(f"{at}/delta"), at)
        rows.filter("new <> old").select("basket", "item", moved.alias("sign")).write.parquet(f"{at}/own")
        rows.filter("new <> old AND item IS NOT NULL").groupBy("item").agg(F.sum(moved).alias("n")).write.parquet(f"{at}/items")
        self.state |= {"items": [*self.state["items"], f"{at}/items"], "own": [*self.state["own"], f"{at}/own"]}
        if len(self.state["own"]) > self.compact:
            self._held(self._read(self.state["own"], _BASKETS)).filter("old > 0").select("basket", "item", F.col("old").alias("sign")).write.parquet(f"{at}/own-all")
            self.items().write.parquet(f"{at}/items-all")
            self.state |= {"items": [f"{at}/items-all"], "own": [f"{at}/own-all"]}
        self.version += 1
        return self._read([f"{at}/items"], _ITEMS).select("item")

    def _merge(self, delta: DataFrame, at: str) -> None:
        """Add signed pair counts to the buckets they fall in."""
        known, buckets = self.state["pairs"], self.state["buckets"]
        in_bucket = delta.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).alias("k")).count().collect()  # at most as many rows as buckets
        changes = sum(r["count"] for r in in_bucket)
        if not changes:
            return
        # no more pairs than there were and the delta brings; a doubled number of buckets splits each in two
        while buckets * self.bucket_rows < self.state["rows"] + changes:
            buckets *= 2
        bucket = F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int")
        grown = buckets > self.state["buckets"]
        hit = sorted(known) if grown else [r["k"] for r in in_bucket]
        all_ = delta.unionByName(self.pairs(hit)).withColumn("bucket", bucket)
        # one exchange: rows of a bucket stay in their partition for the sum
        merged = all_.repartition(max(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").groupBy("bucket", "a", "b").agg(F.sum("joint").alias("joint")).filter("joint <> 0")
        merged.write.partitionBy("bucket").parquet(f"{at}/pairs")
        there = {int(n.removeprefix("bucket=")) for n in self._folders(f"{at}/pairs")}
        kept = {} if grown else {k: p for k, p in known.items() if k not in hit}
        self.state |= {"buckets": buckets, "pairs": kept | {k: f"{at}/pairs/bucket={k}" for k in there}, "rows": self.state["rows"] + changes}

    def _folders(self, path: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]

    def manifest(self) -> str:
        """What to keep to open the table again (see ``reopen``)."""
        return json.dumps({"root": self.root, "bucket_rows": self.bucket_rows, "chunk": self.chunk, "compact": self.compact, "version": self.version, "baskets": self.baskets, "state": self.state})

    @classmethod
    def reopen(cls, spark: SparkSession, manifest: str) -> PairTable:
        m = json.loads(manifest)
        table = cls(spark, m["root"], bucket_rows=m["bucket_rows"], chunk=m["chunk"], compact=m["compact"])
        table.version, table.baskets = m["version"], m["baskets"]
        table.state = m["state"] | {"pairs": {int(k): p for k, p in m["state"]["pairs"].items()}}
        return table

    # -- scores

    def _counts(self, affected: DataFrame | None = None) -> DataFrame:
        """``a, b, joint, n_a, n_b`` of all pairs, or of those with an item of ``affected``."""
        pairs = self.pairs().select("a", "b", "joint")
        if affected is not None:
            hit = lambda c: affected.select(F.col("item").alias(c), F.lit(True).alias(f"in_{c}"))
            pairs = pairs.join(hit("a"), "a", "left").join(hit("b"), "b", "left").filter("in_a OR in_b").select("a", "b", "joint")
        n = self.items()
        return pairs.join(n.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "joint", "n_a", "n_b")

    def rescore(self, affected: DataFrame) -> None:
        """Store the counts behind the scores again for pairs with an item of ``affected`` (what
        ``update`` gave); the others keep theirs."""
        path = f"{self.root}/v{self.version}/scores"
        # where none are stored yet, all are computed
        fresh = self._counts(affected if self.state["scores"] else None)
        if self.state["scores"]:
            old = self._read([self.state["scores"]], _COUNTS)
            for c in ("a", "b"):
                old = old.join(affected.select(F.col("item").alias(c)), c, "left_anti")
            fresh = old.select("a", "b", "joint", "n_a", "n_b").unionByName(fresh)
        fresh.write.parquet(path)
        self.state["scores"] = path

    def scores(self, affected: DataFrame | None = None, *, min_joint: int = 1) -> DataFrame:
        """``a, b, joint, n_a, n_b, n_baskets, lift, pmi, jaccard`` of all pairs (from what
        ``rescore`` stored, if it has), or of those with an item of ``affected``."""
        stored = affected is None and self.state["scores"]
        pairs = (self._read([self.state["scores"]], _COUNTS) if stored else self._counts(affected)).filter(F.col("joint") >= min_joint)
        lift = F.col("joint").cast("double") * self.baskets / F.col("n_a") / F.col("n_b")
        return pairs.select("a", "b", "joint", "n_a", "n_b", F.lit(self.baskets).cast("long").alias("n_baskets"), lift.alias("lift"), F.log(lift).alias("pmi"), (F.col("joint") / (F.col("n_a") + F.col("n_b") - F.col("joint"))).alias("jaccard"))
