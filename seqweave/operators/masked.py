"""Scoring substitutions at masked positions with a pluggable scorer.

A scorer is a table ``prev, next, letter, score``: here a model of neighbours
counted from a corpus. Anything that scores (sequence, position, letter) can take
its place, for instance a language model behind a pandas UDF.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.sequences import hashed_number, let, symbols, with_letter
from seqweave.operators.substitution import ALTERNATIVE_LETTERS
from seqweave.session import written

EDGE = "^"


def masked(seq: Column, pos: Column, mask: str = "?") -> Column:
    """The sequence with the letter at ``pos`` (from 0) hidden."""
    return with_letter(seq, pos, F.lit(mask))


def neighbour_scores(df: DataFrame, seq: str) -> DataFrame:
    """``prev, next, letter, n``: how often a letter stands between two others."""
    edge = F.array(F.lit(EDGE))
    three = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 2), lambda i: F.struct(F.get(a, i - 1).alias("prev"), F.get(a, i + 1).alias("next"), F.get(a, i).alias("letter")))
    # only the three letters leave a sequence, never copies of the whole
    each = df.filter(F.length(seq) > 0).select(F.explode(let(F.concat(edge, symbols(seq), edge), three)).alias("x"))
    return each.groupBy("x.prev", "x.next", "x.letter").agg(F.count("*").alias("n"))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


PAIRS = (("orig", "mut"), ("orig", "alt"), ("orig", "base"), ("mut", "alt"), ("mut", "base"), ("alt", "base"))


def win_rates(df: DataFrame, scores: DataFrame, *by: str, max_pos: int | None = None) -> DataFrame:
    """Of sequences ``original, mutated, alternative, baseline``: how often each kind's
    letter scores above another's at the positions where all three differ from the
    original, as shares of all such positions, per group. ``max_pos`` leaves out later
    positions, as a model of bounded length does. An unseen letter scores 0; each
    (neighbours, letter) is looked up once per position."""
    names = ("original", "mutated", "alternative", "baseline")
    last = max_pos if max_pos is not None else 1 << 31
    keys = ("prev", "next", "orig", "mut", "alt", "base")

    @F.arrow_udf("array<struct<prev:string,next:string,orig:string,mut:string,alt:string,base:string>>")
    def places(o: pa.Array, m: pa.Array, a: pa.Array, r: pa.Array) -> pa.Array:
        cells: list[list] = [[] for _ in keys]
        sizes = []
        for row in zip(*(x.to_pylist() for x in (o, m, a, r))):
            n = 0 if None in row else min(map(len, row))
            at = np.zeros(0, dtype=np.int64)
            if n:
                x = [np.frombuffer(t[:n].encode("utf-32-le"), dtype=np.uint32) for t in row]
                at = np.flatnonzero((x[0] != x[1]) & (x[0] != x[2]) & (x[0] != x[3]))
                at = at[at < last]
            sizes.append(len(at))
            for i in at.tolist():
                text = row[0]
                for c, v in zip(cells, (text[i - 1] if i else EDGE, text[i + 1] if i + 1 < len(text) else EDGE, *(t[i] for t in row))):
                    c.append(v)
        cell = pa.StructArray.from_arrays([pa.array(c, type=pa.string()) for c in cells], names=list(keys))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), cell)

    p = df.select(*by, F.explode(places(*names)).alias("x")).select(*by, "x.*")
    by_place = scores.groupBy("prev", "next").agg(F.map_from_entries(F.collect_list(F.struct("letter", "n"))).alias("m"))
    p = p.join(by_place, ["prev", "next"], "left")
    score = lambda k: F.coalesce(F.element_at("m", F.col(k)), F.lit(0))
    wins = [(F.count_if(score(a) > score(b)) / F.count("*")).alias(f"{a}_wins_vs_{b}") for a, b in PAIRS]
    return p.groupBy(*by).agg(F.count("*").alias("positions"), *wins)


def random_baseline(original: Column, mutation: Column, alternative: Column, *seed: Column) -> Column:
    """The mutation with a hash-drawn letter, never the original's, wherever it differs
    from the original and from the alternative; the mutation itself for unequal lengths."""
    at = lambda c, i: F.substr(c, i, F.lit(1))

    def letter(i: Column) -> Column:
        o, m = at(original, i), at(mutation, i)
        others = F.filter(F.array(*(F.lit(x) for x in ALTERNATIVE_LETTERS)), lambda x: x != o)
        drawn = F.get(others, F.pmod(hashed_number(*seed, i.cast("string")), F.size(others)))
        return F.when((o != m) & (m != at(alternative, i)), drawn).otherwise(m)

    return F.when(F.length(original) == F.length(mutation), F.array_join(F.transform(F.sequence(F.lit(1), F.length(mutation)), letter), "")).otherwise(mutation)


def replaced_sequences(encoded: DataFrame, replacements: DataFrame, ident: str = "seq_id") -> DataFrame:
    """``config_id, seq_id, original, mutated, alternative, baseline, changes, score``: every token
    of ``config_id, seq_id, tokens`` that has a replacement (``config_id, token, mutation,
    alternative, score``) is exchanged for it in each of the three ways."""
    t = encoded.select("config_id", ident, F.posexplode("tokens").alias("i", "token")).join(replacements, ["config_id", "token"], "left")
    base = random_baseline(F.col("token"), F.col("mutation"), F.col("alternative"), F.lit("base"), F.col(ident).cast("string"), F.col("i").cast("string"))
    new = lambda c: F.coalesce(c, F.col("token"))
    t = t.select("config_id", ident, F.struct("i", "token", new(F.col("mutation")).alias("m"), new(F.col("alternative")).alias("a"), F.when(F.col("mutation").isNotNull(), base).otherwise(F.col("token")).alias("b")).alias("x"), "score")
    g = t.groupBy("config_id", ident).agg(F.array_sort(F.collect_list("x")).alias("x"), F.count("score").alias("changes"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))
    join = lambda c: F.array_join(F.transform("x", lambda e: e[c]), "")
    return g.select("config_id", ident, join("token").alias("original"), join("m").alias("mutated"), join("a").alias("alternative"), join("b").alias("baseline"), "changes", "score")


def replacement_win_rates(encoded: DataFrame, replacements: DataFrame, scores: DataFrame, ident: str = "seq_id") -> DataFrame:
    """``config_id, positions`` and the shares of ``win_rates`` over ``replaced_sequences`` for sequences
    ``ident, tokens`` that all configurations cut alike. Replacements (``config_id, token,
    mutation, alternative``, all of the token's length) come in as letters at places of tokens; each
    such place of a sequence is looked at once, and places that look the same are counted together
    before the configurations have a part in it."""
    at = lambda c, i: F.substr(c, i, F.lit(1))
    letters = lambda i: F.struct(i.alias("k"), at(F.col("token"), i).alias("orig"), at(F.col("mutation"), i).alias("mut"), at(F.col("alternative"), i).alias("alt"))
    r = replacements.select("config_id", "token", F.inline(F.transform(F.sequence(F.lit(1), F.length("token")), letters)))
    r = written(r.filter("orig <> mut AND orig <> alt"), "replacements")
    wanted = r.groupBy("token").agg(F.collect_set("k").alias("ks"))
    edge = F.lit(EDGE)
    beside = lambda a: F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("token"), F.coalesce(F.right(F.get(a, i - 1), F.lit(1)), edge).alias("first"), F.coalesce(F.left(F.get(a, i + 1), F.lit(1)), edge).alias("last")))
    t = encoded.select(ident, F.inline(let(F.col("tokens"), beside))).join(wanted, "token").withColumn("k", F.explode("ks"))
    # the letter that ``random_baseline`` draws there
    orig, text, k = at(F.col("token"), F.col("k")), F.concat("first", "token", "last"), F.col("k")
    own = F.instr(F.lit(ALTERNATIVE_LETTERS), orig)
    drawn = F.pmod(hashed_number(F.lit("base"), F.col(ident).cast("string"), F.col("i").cast("string"), k.cast("string")), F.lit(len(ALTERNATIVE_LETTERS)) - (own > 0).cast("int"))
    drawn = at(F.lit(ALTERNATIVE_LETTERS), drawn + 1 + ((own > 0) & (drawn + 1 >= own)).cast("int"))
    place = ("token", "k", "prev", "next", "drawn")
    p = t.select("token", "k", at(text, k).alias("prev"), at(text, k + 2).alias("next"), drawn.alias("drawn")).groupBy(*place).agg(F.count("*").alias("n"))
    by_place = scores.groupBy("prev", "next").agg(F.map_from_entries(F.collect_list(F.struct("letter", "n"))).alias("m"))
    p = p.join(by_place, ["prev", "next"], "left")
    way = ("token", "k", "orig", "mut", "alt")
    # the baseline is the mutation where that is also the alternative
    p = p.join(r.select(*way).distinct(), ["token", "k"]).withColumn("base", F.when(F.col("mut") != F.col("alt"), F.col("drawn")).otherwise(F.col("mut")))
    score = lambda k: F.coalesce(F.element_at("m", F.col(k)), F.lit(0))
    won = [F.sum(F.when(score(a) > score(b), F.col("n")).otherwise(0)).alias(f"{a}_{b}") for a, b in PAIRS]
    each = p.groupBy(*way).agg(F.sum("n").alias("n"), *won)
    return r.join(each, list(way)).groupBy("config_id").agg(F.sum("n").alias("positions"), *((F.sum(f"{a}_{b}") / F.sum("n")).alias(f"{a}_wins_vs_{b}") for a, b in PAIRS))
