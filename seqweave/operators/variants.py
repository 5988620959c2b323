"""Point variants: making them, and whether a segmentation survives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.sequences import boundaries, hashed_number, let, with_letter

#: The twenty amino acids (fixed value).
LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def random_mutations(df: DataFrame, ident: str, seq: str, seed: str = "25") -> DataFrame:
    """Adds ``pos`` (from 0), ``orig``, ``mut`` and ``mutated``: one substitution per
    sequence, its place and letter drawn by md5 of (seed, ident), never the letter it
    replaces. Null and empty sequences are left out."""
    n = hashed_number(F.lit(seed), F.lit("pos"), F.col(ident))
    k = hashed_number(F.lit(seed), F.lit("letter"), F.col(ident))
    d = df.filter(F.length(seq) > 0).withColumn("pos", F.pmod(n, F.length(seq)).cast("int"))
    d = d.withColumn("orig", F.substr(seq, F.col("pos") + 1, F.lit(1)))
    others = F.filter(F.array(*(F.lit(x) for x in LETTERS)), lambda x: x != F.col("orig"))
    return d.withColumn("mut", F.get(others, F.pmod(k, F.size(others)))).withColumn("mutated", with_letter(seq, F.col("pos"), F.col("mut")))


def token_at(tokens: Column, pos: Column) -> Column:
    """The token that covers ``pos`` (from 0); null where none does."""
    covers = lambda b: F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (F.get(b, i) <= pos) & (pos < F.get(b, i + 1)))
    return F.when(F.size(tokens) > 0, F.get(tokens, F.get(let(boundaries(tokens), covers), F.lit(0))))


def judged(df: DataFrame, ori: str, mut: str, pos: str, sibling) -> DataFrame:
    """Adds ``same`` (both tokenisations cut alike), ``ori_token``, ``mut_token`` and
    ``is_sibling``: same, and ``sibling(ori_token, mut_token)`` holds."""
    same = boundaries(F.col(ori)) == boundaries(F.col(mut))
    d = df.withColumn("same", same).withColumn("ori_token", token_at(F.col(ori), F.col(pos))).withColumn("mut_token", token_at(F.col(mut), F.col(pos)))
    return d.withColumn("is_sibling", F.col("same") & F.coalesce(sibling(F.col("ori_token"), F.col("mut_token")), F.lit(False)))


def with_siblings(df: DataFrame, families: DataFrame) -> DataFrame:
    """Adds ``is_sibling`` to rows with ``config_id, same, ori_token, mut_token``: both
    tokens are members of one family of their configuration."""
    f = families.select("config_id", "family", "member").distinct()
    pairs = df.select("config_id", "ori_token", "mut_token").distinct()
    a = pairs.join(f.withColumnRenamed("member", "ori_token"), ["config_id", "ori_token"])
    hit = a.join(f.withColumnRenamed("member", "mut_token"), ["config_id", "mut_token", "family"]).select("config_id", "ori_token", "mut_token").distinct().withColumn("kin", F.lit(True))
    return df.join(hit, ["config_id", "ori_token", "mut_token"], "left").withColumn("is_sibling", F.col("same") & F.coalesce("kin", F.lit(False))).drop("kin")


def sibling_rates(df: DataFrame, *by: str) -> DataFrame:
    """Per group: the share of variants with unchanged cuts, and of these the share
    whose changed token is a sibling (null where there is none)."""
    same = F.count_if("same")
    return df.groupBy(*by).agg(F.count("*").alias("n"), (same / F.count("*")).alias("same_idx"), F.try_divide(F.count_if("is_sibling"), same).alias("sibling_rate"))


def bin_counts(df: DataFrame, bin_col: str, *by: str) -> DataFrame:
    """Per group: unchanged and sibling variants, with bin 1 and with any other."""
    one = F.coalesce(F.col(bin_col) == 1, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(F.col("same") & one).alias("same_count_pos"), F.count_if(F.col("same") & ~one).alias("same_count_neg"), F.count_if(F.col("is_sibling") & one).alias("sibling_count_pos"), F.count_if(F.col("is_sibling") & ~one).alias("sibling_count_neg"))
