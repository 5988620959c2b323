"""Ancestors in an ontology of terms with several parents each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.session import written


def closure(edges: DataFrame) -> DataFrame:
    """``child, ancestor``: all proper ancestors of each term, by joining the paths found
    with themselves until none is new (paths double in each round); rings end too.
    A term on a ring is its own ancestor."""
    known = written(edges.select(F.col("child"), F.col("parent").alias("ancestor")).filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), "closure")
    n = known.count()
    while True:
        step = known.select("child", F.col("ancestor").alias("via")).join(known.select(F.col("child").alias("via"), "ancestor"), "via").select("child", "ancestor")
        known = written(known.unionByName(step).distinct(), "closure")
        m = known.count()
        if m == n:
            return known
        n = m


def nearest_in(edges: DataFrame, slim: DataFrame) -> DataFrame:
    """``term, slim``: for each term the members of the slim (``term``) among itself and
    its ancestors that have no other such member below them on the way."""
    paths = closure(edges)
    terms = edges.select(F.col("child").alias("t")).unionByName(edges.select(F.col("parent").alias("t"))).unionByName(slim.select(F.col("term").alias("t"))).filter("t IS NOT NULL").distinct()
    up = terms.select(F.col("t").alias("term"), F.col("t").alias("slim")).unionByName(paths.select(F.col("child").alias("term"), F.col("ancestor").alias("slim")))
    hits = up.join(slim.select(F.col("term").alias("slim")).distinct(), "slim").select("term", "slim").distinct()
    lower = paths.filter("child <> ancestor").select(F.col("child").alias("low"), F.col("ancestor").alias("slim"))
    shadowed = hits.join(lower, "slim").join(hits.select("term", F.col("slim").alias("low")), ["term", "low"]).select("term", "slim").distinct()
    return hits.join(shadowed, ["term", "slim"], "left_anti")


def without_ancestors(df: DataFrame, key: str, term: str, paths: DataFrame) -> DataFrame:
    """Rows whose term has no descendant among the same key's terms."""
    have = df.select(key, F.col(term).alias("child")).distinct()
    covered = have.join(paths.filter("child <> ancestor"), "child").select(key, F.col("ancestor").alias(term)).distinct()
    return df.join(covered, [key, term], "left_anti")


def slim_graph(edges: DataFrame, slim: DataFrame, root: str = "root") -> DataFrame:
    """``child, parent``: the links between members of the slim (``term``), and one to a
    made root for each member without a parent among them."""
    s = slim.select("term").distinct()
    inside = edges.join(s.select(F.col("term").alias("child")), "child", "left_semi").join(s.select(F.col("term").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
    tops = s.join(inside.select(F.col("child").alias("term")), "term", "left_anti")
    return inside.unionByName(tops.select(F.col("term").alias("child"), F.lit(root).alias("parent")))
