"""Families, lineages and statistics of unit vocabularies.

A vocabulary is a table ``config_id, token_id, token, frequency, merge_order,
pair, parent, similarity, is_parent``; exact repeats count once everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.sequences import hashed_number
from seqweave.session import written


def vocabulary(df: DataFrame) -> DataFrame:
    """One row per (config_id, token): exact repeats dropped, the lowest id first."""
    cols = ["token_id", "frequency", "merge_order", "pair", "parent", "similarity", "is_parent"]
    return df.groupBy("config_id", "token").agg(F.min(F.struct(*cols)).alias("v")).select("config_id", "token", "v.*")


def families(v: DataFrame) -> DataFrame:
    """``config_id, family, member, is_head``: the star of each parent and its
    children; tokens without a family have no row. A child's family is its parent's
    even where it is a parent too, so a head may be listed in two."""
    child = v.filter(F.col("parent").isNotNull()).select("config_id", F.col("parent").alias("family"), F.col("token").alias("member"), F.lit(False).alias("is_head"))
    head = v.filter(F.col("is_parent")).select("config_id", F.col("token").alias("family"), F.col("token").alias("member"), F.lit(True).alias("is_head"))
    return head.unionByName(child)


def lineage(v: DataFrame) -> DataFrame:
    """Per token: its own fields and, in order of token id, the arrays
    ``child_pair``, ``child_mutation``, ``partner_left``, ``partner_right`` and the
    flag ``partner_self``. Links to tokens outside the configuration are dropped."""
    left, right = F.get("pair", F.lit(0)), F.get("pair", F.lit(1))
    made = v.filter(left.isNotNull() & right.isNotNull()).select("config_id", "token_id", F.col("token").alias("child"), left.alias("l"), right.alias("r"))
    role = lambda who, kind, other: F.struct(who.alias("token"), F.lit(kind).alias("kind"), other.alias("other"))
    l, r, child = F.col("l"), F.col("r"), F.col("child")
    one = F.array(role(l, "self", child), role(l, "child", child))
    two = F.array(role(l, "right", r), role(r, "left", l), role(l, "child", child), role(r, "child", child))
    roles = made.select("config_id", "token_id", F.explode(F.when(l == r, one).otherwise(two)).alias("x")).select("config_id", "token_id", "x.*")
    kids = v.filter(F.col("parent").isNotNull()).select("config_id", "token_id", F.col("parent").alias("token"), F.lit("mutation").alias("kind"), F.col("token").alias("other"))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("token_id", "other")))), lambda x: x["other"])
    arrays = roles.unionByName(kids).groupBy("config_id", "token").agg(pick("child").alias("child_pair"), pick("mutation").alias("child_mutation"), pick("left").alias("partner_left"), pick("right").alias("partner_right"), F.max(F.col("kind") == "self").alias("partner_self"))
    own = v.select("config_id", "token", "token_id", "frequency", "merge_order", "pair", "parent", "similarity")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return own.join(arrays, ["config_id", "token"], "left").select(*own.columns, *(empty(c) for c in ("child_pair", "child_mutation", "partner_left", "partner_right")), F.coalesce("partner_self", F.lit(False)).alias("partner_self"))


def edges(v: DataFrame) -> DataFrame:
    """``config_id, src, dst, kind``: origin to unit, kind ``pair`` or ``mutation``."""
    parts = v.select("config_id", F.explode(F.array_distinct("pair")).alias("src"), F.col("token").alias("dst"), F.lit("pair").alias("kind")).filter("src IS NOT NULL")
    return parts.unionByName(v.filter("parent IS NOT NULL").select("config_id", F.col("parent").alias("src"), F.col("token").alias("dst"), F.lit("mutation").alias("kind")))


def vocabulary_stats(v: DataFrame) -> DataFrame:
    """Per configuration: size, shares of parents and mutated units, unit length."""
    n = F.count("*")
    return v.groupBy("config_id").agg(n.alias("v_size"), (F.count_if("is_parent") / n).alias("p_ratio"), (F.count("parent") / n).alias("m_ratio"), F.avg(F.length("token")).alias("ulength_mean"), F.stddev_samp(F.length("token")).alias("ulength_std"))


def shared_units(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """Of two tables ``token, n`` of used units: how many are shared, and the share of
    the use of each side that falls on shared units. ``compat`` divides by the other
    side's use, as the figures' names are often taken."""
    both = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), "token", "full")
    on = F.col("na").isNotNull() & F.col("nb").isNotNull()
    sum_a, sum_b = F.sum("na"), F.sum("nb")
    return both.agg(F.count_if(on).alias("shared"), (F.count_if(on) / F.count("na")).alias("shared_ratio"), (F.sum(F.when(on, F.col("na"))) / (sum_b if compat else sum_a)).alias("used_ratio_a"), (F.sum(F.when(on, F.col("nb"))) / (sum_a if compat else sum_b)).alias("used_ratio_b"))


def vocabulary_identity(v: DataFrame, match=None) -> DataFrame:
    """``config_a, config_b, shared, identity``: units of a that b has too, over a's
    size (not symmetric). Counted from tokens in several configurations, so disjoint
    pairs have no row. ``match``, a condition on the two names, says which to compare."""
    t = v.select("config_id", "token")
    size = t.groupBy("config_id").agg(F.count("*").alias("size"))
    both = t.withColumnRenamed("config_id", "config_a").join(t.withColumnRenamed("config_id", "config_b"), "token")
    if match is not None:
        both = both.filter(match(F.col("config_a"), F.col("config_b")))
    both = both.groupBy("config_a", "config_b").agg(F.count("*").alias("shared"))
    return both.join(size.withColumnRenamed("config_id", "config_a"), "config_a").select("config_a", "config_b", "shared", (F.col("shared") / F.col("size")).alias("identity"))


def observed_ratios(v: DataFrame, used: DataFrame) -> DataFrame:
    """Per configuration, over a corpus' use of its units (``config_id, token, n``): length mean
    and deviation of the units as they occur, and the shares of occurrences that are
    parents and mutated units. Units outside the vocabulary do not count."""
    n, size = F.col("n"), F.length("token")
    j = used.join(v.select("config_id", "token", "parent", "is_parent"), ["config_id", "token"])
    total, mean = F.sum("n"), F.sum(n * size) / F.sum("n")
    spread = F.sqrt((F.sum(n * size * size) - F.sum("n") * mean * mean) / (F.sum("n") - 1))
    return j.groupBy("config_id").agg(total.alias("n"), mean.alias("ulength_mean"), spread.alias("ulength_std"), (F.sum(F.when(F.col("is_parent"), n).otherwise(0)) / total).alias("p_ratio"), (F.sum(F.when(F.col("parent").isNotNull(), n).otherwise(0)) / total).alias("m_ratio"))


def random_clone(v: DataFrame, letters: str, seed: str = "clone", tries: int = 40) -> DataFrame:
    """``config_id, token_id, token`` of a random vocabulary of the same lengths; single
    letters stay. A draw that collides is drawn again, up to ``tries`` times in all; the
    units left over get words that are still free. Only a unit of a length whose words
    are all taken has no row."""
    spread = F.array(*(F.lit(x) for x in letters))

    def word(k: int) -> Column:
        at = lambda i: F.get(spread, F.pmod(hashed_number(F.lit(seed), F.col("config_id"), F.col("token_id").cast("string"), F.lit(str(k)), i.cast("string")), F.lit(len(letters))))
        return F.when(F.length("token") == 1, F.col("token")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length("token")), at), ""))

    left, taken = written(v.select("config_id", "token_id", "token"), "clone-left"), None
    for k in range(tries):
        # a word goes to the lowest id that draws it, if no unit of a round before has it
        asked = left.select("config_id", "token_id", word(k).alias("token"))
        if taken is not None:
            asked = asked.join(taken.select("config_id", "token"), ["config_id", "token"], "left_anti")
        won = written(asked.groupBy("config_id", "token").agg(F.min("token_id").alias("token_id")).select("config_id", "token_id", "token"), "clone")
        taken = won if taken is None else taken.unionByName(won)
        left = written(left.join(won.select("config_id", "token_id"), ["config_id", "token_id"], "left_anti"), "clone-left")
        if left.isEmpty():
            return taken
    return taken.unionByName(_free_words(left, taken, letters, seed))


def _free_words(left: DataFrame, taken: DataFrame, letters: str, seed: str) -> DataFrame:
    """``config_id, token_id, token``: the units in ``left`` with words of their length that
    ``taken`` has not, dealt in the order of their hashes, as far as there are any."""
    m, n, i = len(letters), F.length("token").alias("length"), F.col("i")
    both = left.select("config_id", n, F.lit(1).alias("open")).unionByName(taken.select("config_id", n, F.lit(0).alias("open")))
    need = both.groupBy("config_id", "length").agg(F.count("*").alias("units"), F.sum("open").alias("open")).filter("open > 0 AND length > 1")
    # twice as many words as units are enough to find a free one for each
    words = F.least(F.pow(F.lit(float(m)), "length"), F.lit(2.0) * F.col("units")).cast("long").alias("words")
    block = need.select("config_id", "length", words).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / 4096))))
    each = block.select("config_id", "length", F.explode(F.sequence(F.col("block") * 4096, F.least("words", (F.col("block") + 1) * 4096) - 1)).alias("i"))
    spread = F.array(*(F.lit(x) for x in letters))

    def at(k: Column) -> Column:
        digit = F.floor(i / F.pow(F.lit(float(m)), k)) + F.pmod(hashed_number(F.lit(seed), F.lit("free"), F.col("config_id"), k.cast("string")), F.lit(m))
        return F.get(spread, F.pmod(digit, F.lit(m)).cast("int"))

    free = each.select("config_id", "length", F.array_join(F.transform(F.sequence(F.lit(0), F.col("length") - 1), at), "").alias("token")).join(taken.select("config_id", "token"), ["config_id", "token"], "left_anti")
    turn = lambda *order: F.row_number().over(Window.partitionBy("config_id", "length").orderBy(*order)).alias("turn")
    free = free.select("config_id", "length", "token", turn(hashed_number(F.lit(seed), F.col("config_id"), F.col("token")), F.col("token")))
    asked = left.select("config_id", n, "token_id").select("config_id", "length", "token_id", turn(F.col("token_id")))
    return asked.join(free, ["config_id", "length", "turn"]).select("config_id", "token_id", "token")


def gaussian_density(df: DataFrame, group: str, value: str, grid: DataFrame, x: str = "x") -> DataFrame:
    """``group, x, density``: Gaussian kernel density with Scott's bandwidth. Equal
    values are counted first, so the grid meets distinct values only."""
    stats = df.groupBy(group).agg((F.stddev_samp(value) * F.pow(F.count("*"), F.lit(-0.2))).alias("h"), F.count("*").alias("n"))
    counted = df.groupBy(group, value).agg(F.count("*").alias("w")).join(stats, group).filter("h > 0")
    z = (F.col(x) - F.col(value)) / F.col("h")
    return counted.crossJoin(F.broadcast(grid)).groupBy(group, x).agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))
