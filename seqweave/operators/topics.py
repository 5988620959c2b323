"""Class-based term weights, smoothing over the unit graph, and similarities.

Matrices are tables of their non-zero cells; a product is a join and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.session import written


def unit_documents(tokens: Column, min_len: int = 0) -> Column:
    """The units of at least ``min_len`` letters, joined by blanks."""
    return F.array_join(F.filter(tokens, lambda t: F.length(t) >= min_len), " ")


def class_counts(df: DataFrame, label: str, tokens: str, min_len: int = 1) -> DataFrame:
    """``class, term, n`` over all documents of a class."""
    return df.select(F.col(label).alias("class"), F.explode(tokens).alias("term")).filter(F.col("class").isNotNull() & (F.length("term") >= min_len)).groupBy("class", "term").agg(F.count("*").alias("n"))


def df_filtered(counts: DataFrame, *, max_df: float = 0.9, min_df: int = 1) -> DataFrame:
    """Terms in at least ``min_df`` classes and at most ``max_df`` of all classes."""
    classes = counts.agg(F.countDistinct("class").alias("classes"))
    keep = counts.groupBy("term").agg(F.countDistinct("class").alias("in_classes")).crossJoin(F.broadcast(classes)).filter((F.col("in_classes") >= min_df) & (F.col("in_classes") <= max_df * F.col("classes")))
    return counts.join(keep.select("term"), "term", "left_semi")


def class_tfidf(counts: DataFrame, value: str = "n", by: tuple = ()) -> DataFrame:
    """``class, term, weight``: the root of the term's share of its class times
    ln(1 + average class total, cut to a whole number, over the term's total); all of it
    within each ``by``."""
    x = F.col(value)
    per_class = counts.groupBy(*by, "class").agg(F.sum(x).alias("in_class"))
    mean = per_class.groupBy(*by).agg(F.avg("in_class").cast("long").alias("mean_class"))
    per_term = counts.groupBy(*by, "term").agg(F.sum(x).alias("of_term"))
    joined = counts.join(per_class, [*by, "class"]).join(per_term, [*by, "term"])
    joined = joined.join(mean, list(by)) if by else joined.crossJoin(F.broadcast(mean))
    return joined.select(*by, "class", "term", (F.sqrt(x / F.col("in_class")) * F.log(1 + F.col("mean_class") / F.col("of_term"))).alias("weight"))


def unit_graph(edges: DataFrame, *, by: tuple = (), alpha: float = 1.0, beta: float = 3.0, theta: float = 2.0) -> DataFrame:
    """``a, b, weight``, symmetric, of edges (``src, dst, kind``): ``alpha`` between a
    unit and its parts, ``theta`` between a parent and its mutations, ``beta`` between
    mutations of one parent; of several links the mutational one counts, of these the
    one between siblings. A unit has no link with itself. ``by`` keeps graphs apart, one
    for each tokenizer."""
    e = edges.select(*by, "src", "dst", "kind").distinct().filter("src <> dst")
    link = lambda df, a, b, w, rank: df.select(*by, F.col(a).alias("a"), F.col(b).alias("b"), F.lit(float(w)).alias("weight"), F.lit(rank).alias("rank"))
    pair, kin = e.filter("kind = 'pair'"), e.filter("kind = 'mutation'")
    twins = kin.select(*by, "src", F.col("dst").alias("x")).join(kin.select(*by, "src", F.col("dst").alias("y")), [*by, "src"]).filter("x <> y")
    every = link(pair, "src", "dst", alpha, 1).unionByName(link(pair, "dst", "src", alpha, 1)).unionByName(link(kin, "src", "dst", theta, 2)).unionByName(link(kin, "dst", "src", theta, 2)).unionByName(link(twins, "x", "y", beta, 3))
    return every.groupBy(*by, "a", "b").agg(F.max_by("weight", "rank").alias("weight"))


def smoothing(graph: DataFrame, units: DataFrame, lam: float = 0.5, by: tuple = ()) -> DataFrame:
    """``a, b, value`` of (1 - lam) I + lam A D: the graph with its columns brought to
    sum 1, mixed with the identity over ``units`` (``unit``); a matrix for each ``by``."""
    col = graph.groupBy(*by, "b").agg(F.sum("weight").alias("total"))
    spread = graph.join(col, [*by, "b"]).select(*by, "a", "b", (lam * F.col("weight") / F.col("total")).alias("value"))
    same = units.select(*by, F.col("unit").alias("a"), F.col("unit").alias("b"), F.lit(1 - lam).alias("value"))
    return spread.unionByName(same).groupBy(*by, "a", "b").agg(F.sum("value").alias("value"))


def smoothed_counts(counts: DataFrame, matrix: DataFrame, by: tuple = ()) -> DataFrame:
    """``class, term, n``: counts times the smoothing matrix, or times each of several (``by``,
    columns of the matrix that become columns of the result)."""
    return counts.join(matrix.withColumnRenamed("a", "term"), "term").groupBy(*by, "class", F.col("b").alias("term")).agg(F.sum(F.col("n") * F.col("value")).alias("n"))


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds the place of each row in an order over the whole table, from 1: rows are cut into
    ranges, numbered inside each, and moved by the sizes of the ranges before."""
    placed = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    # one row per range, as many as there are partitions
    before = placed.groupBy("_p").agg(F.count("*").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_p", "_off")), "_p").withColumn(name, F.col("_off") + F.row_number().over(W.partitionBy("_p").orderBy(*order))).drop("_p", "_off")


def permuted(df: DataFrame, ident: str, label: str, seed: str = "42") -> DataFrame:
    """The null model: the labels dealt anew among the rows, in the order of the md5 of (seed,
    ident); each label keeps its number of rows."""
    rows = numbered(df.drop(label), F.md5(F.concat_ws("|", F.lit(seed), F.col(ident).cast("string"))), F.col(ident))
    labels = numbered(df.select(label, F.col(ident).alias("_i")), label, "_i").drop("_i")
    return rows.join(labels, "place").drop("place")


def top_terms(weights: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest terms of each class, ties by name."""
    return weights.withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy(F.desc("weight"), "term"))).filter(F.col("rank") <= n)


def cosine_pairs(cells: DataFrame) -> DataFrame:
    """``a, b, cosine`` for a < b, of cells (``id, dim, v``): a join on the dimension;
    pairs without a common one have no row. The ids are classes, a small set."""
    norm = cells.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).filter("norm > 0")
    x = cells.select(F.col("id").alias("a"), "dim", F.col("v").alias("x"))
    y = cells.select(F.col("id").alias("b"), "dim", F.col("v").alias("y"))
    dot = x.join(y, "dim").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    named = lambda c: norm.select(F.col("id").alias(c), F.col("norm").alias(f"norm_{c}"))
    return dot.join(named("a"), "a").join(named("b"), "b").select("a", "b", (F.col("dot") / F.col("norm_a") / F.col("norm_b")).alias("cosine"))


def _mean_ranks(df: DataFrame, c: str) -> DataFrame:
    """``c, rank``: the mean rank of each distinct value. Values are cut into ranges,
    ranked inside each, and moved by the counts of the ranges before."""
    n = df.groupBy(c).agg(F.count("*").alias("m"))
    placed = written(n.repartitionByRange(F.col(c)).withColumn("_p", F.spark_partition_id()), "ranks")
    # one row per range, as many as there are partitions
    before = placed.groupBy("_p").agg(F.sum("m").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    below = F.coalesce(F.sum("m").over(W.partitionBy("_p").orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_below", below).join(F.broadcast(before.select("_p", "_off")), "_p").select(c, (F.col("_off") + F.col("_below") + (F.col("m") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, rho``: rank correlation with mean ranks for ties, over rows where neither value
    is null or NaN."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    d = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).filter(ok("_x") & ok("_y"))
    for c in ("_x", "_y"):
        d = d.join(_mean_ranks(d.select(c), c).withColumnRenamed("rank", f"_rank{c}"), c)
    return d.agg(F.count("*").alias("n"), F.corr("_rank_x", "_rank_y").alias("rho"))


def similarity_correlation(weights: DataFrame, profile: DataFrame, *, strategy: str = "all", n: int = 100, seed: str = "42") -> DataFrame:
    """``n, rho``: how the cosines between classes by their term weights (``class, term,
    weight``) rank against those by another profile (``id, dim, v``). ``strategy`` takes
    all terms, the union of each class's ``n`` heaviest (``top``), or as many terms as
    that union has, drawn by md5 (``random``)."""
    w = weights
    if strategy != "all":
        union = top_terms(weights, n).select("term").distinct()
        if strategy == "random":
            size = union.count()
            union = weights.select("term").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("term"))), "term").limit(size)
        w = weights.join(union, "term", "left_semi")
    a = cosine_pairs(w.select(F.col("class").alias("id"), F.col("term").alias("dim"), F.col("weight").alias("v"))).withColumnRenamed("cosine", "x")
    b = cosine_pairs(profile).withColumnRenamed("cosine", "y")
    return spearman(a.join(b, ["a", "b"]), "x", "y")


def spearman_p(n: int, rho: float) -> float:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees, the
    distribution integrated by Simpson's rule."""
    import math

    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    k = n - 2
    t = abs(rho) * math.sqrt(k / (1 - rho * rho))
    c = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi)
    f = lambda u: c * (1 + u * u / k) ** (-(k + 1) / 2)
    steps = 2000
    h = t / steps
    area = h / 3 * (f(0) + f(t) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps)))
    return max(0.0, 1 - 2 * area)


def scaled(cells: DataFrame, value: str) -> DataFrame:
    """Adds ``scaled``: the value brought to 0 to 1 over all cells, 0 where all agree."""
    ends = cells.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return cells.crossJoin(F.broadcast(ends)).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def balance_threshold(counts: DataFrame, n: str = "n", denom: int = 1) -> int:
    """The mean, cut to a whole number, of the largest count(*) // denom class counts; 0
    where there is none. One number, so it can bound a window before its rows are sorted."""
    counts = written(counts.select(n), "class-counts")
    most = counts.count() // denom
    return counts.orderBy(F.desc(n)).limit(most).agg(F.avg(n).cast("long")).first()[0] or 0 if most else 0
