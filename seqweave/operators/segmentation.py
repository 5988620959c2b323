"""Agreement of segmentations of the same sequence, in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqweave.functions.sequences import boundaries, let


def _both(a: Column, b: Column, body) -> Column:
    return let(F.struct(boundaries(a).alias("x"), boundaries(b).alias("y")), lambda cuts: body(cuts["x"], cuts["y"]))


def boundary_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the cut positions, 0 and the end among them; null for
    segmentations of unequal length."""
    body = lambda x, y: F.when(F.element_at(x, -1) == F.element_at(y, -1), 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))
    return _both(a, b, body)


def boundary_accuracy(a: Column, b: Column) -> Column:
    """Share of the positions from 0 to the end on which both agree to cut or not;
    null for segmentations of unequal length."""

    def body(x: Column, y: Column) -> Column:
        length = F.element_at(x, -1)
        odd = F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(x, y))
        return F.when(length == F.element_at(y, -1), (length + 1 - odd) / (length + 1))

    return _both(a, b, body)


def kway_dice(*tokenisations: Column) -> Column:
    """k times the cuts common to all k segmentations over all their cuts."""

    def body(cuts: Column) -> Column:
        common, total = cuts["c0"], F.size(cuts["c0"])
        for k in range(1, len(tokenisations)):
            common, total = F.array_intersect(common, cuts[f"c{k}"]), total + F.size(cuts[f"c{k}"])
        return len(tokenisations) * F.size(common) / total

    return let(F.struct(*(boundaries(t).alias(f"c{k}") for k, t in enumerate(tokenisations))), body)


def pair_indices(a: Column, b: Column) -> Column:
    """Rand, Dice and Jaccard indices of "in one unit" over all pairs of symbols, as
    struct (tp, fp, fn, tn, rand, dice, jaccard). The cells between all cuts are the
    overlaps of the units, so counts come from squares of lengths, not from pairs.
    Null for segmentations of unequal length; without pairs the Rand index is null."""
    two = lambda n: (n * (n - 1) / 2).cast("long")
    zero = F.lit(0).cast("long")

    def pairs(cuts: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.lit(0).alias("at"))
        return F.aggregate(cuts, start, lambda acc, c: F.struct((acc["sum"] + two(c - acc["at"])).alias("sum"), c.alias("at")), lambda acc: acc["sum"])

    def body(x: Column, y: Column) -> Column:
        same = F.element_at(x, -1) == F.element_at(y, -1)
        counts = F.struct(pairs(F.array_sort(F.array_union(x, y))).alias("tp"), pairs(x).alias("a"), pairs(y).alias("b"), two(F.element_at(x, -1)).alias("all"))
        return F.when(same, let(counts, figures))

    def figures(n: Column) -> Column:
        tp = n["tp"]
        fp, fn = n["a"] - tp, n["b"] - tp
        tn = n["all"] - tp - fp - fn
        return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.try_divide(tp + tn, n["all"]).alias("rand"), (2 * tp / (2 * tp + fp + fn + 1e-10)).alias("dice"), (tp / (tp + fp + fn + 1e-10)).alias("jaccard"))

    return _both(a, b, body)
