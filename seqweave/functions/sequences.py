"""Column functions over symbol sequences, tokens and coded strings.

Null in, null out unless said otherwise. All are JVM expressions but for ``boundaries``,
which works on whole Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often body names it (inside
    a lambda a plain expression is computed anew for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def symbols(seq: Column | str) -> Column:
    """One symbol per character; an empty string has none."""
    c = _c(seq)
    return F.when(c.isNotNull(), F.filter(F.split(c, ""), lambda x: x != ""))


def letter_count(seq: Column | str, letter: str) -> Column:
    """How often one letter occurs."""
    c = _c(seq)
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def kmers(seq: Column | str, k: int) -> Column:
    """Non-overlapping k-mers from the left; the shorter rest is kept."""
    c = _c(seq)
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{k}}}"), F.lit(0))


def running_ends(t: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of strings: where each list begins among all strings, where each string ends in
    its list (in symbols), and the strings themselves."""
    flat = t.flatten()
    counts = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    before = np.concatenate([[0], ends])[first[:-1]]
    return first, ends - np.repeat(before, counts), flat


def boundaries(tokens: Column | str) -> Column:
    """Cut positions of a tokenisation, 0 and the end among them."""

    # running sums of whole batches; in a higher-order function every step copies the array
    @F.arrow_udf("array<int>")
    def cuts(t: pa.Array) -> pa.Array:
        first, ends, _ = running_ends(t)
        out = np.insert(ends, first[:-1], 0).astype(np.int32)
        offsets = pa.array(first + np.arange(len(first)), type=pa.int32(), mask=np.append(t.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(out))

    return cuts(_c(tokens))


def offsets(tokens: Column | str) -> Column:
    """``array<struct<token, start, end>>``, end exclusive."""
    t = _c(tokens)
    return let(boundaries(t), lambda b: F.transform(t, lambda x, i: F.struct(x.alias("token"), F.get(b, i).alias("start"), F.get(b, i + 1).alias("end"))))


def with_letter(seq: Column | str, pos: Column, letter: Column) -> Column:
    """The sequence with the letter at ``pos`` (from 0) replaced."""
    return F.overlay(_c(seq), letter, pos + 1, F.lit(1))


def mutation_code(code: Column | str) -> Column:
    """``K232E`` as struct (orig, pos from 0, mut); null where it is no such code."""
    c, form = _c(code), "^([A-Z])([0-9]+)([A-Z])$"
    part = lambda i: F.regexp_extract(c, form, i)
    return F.when(c.rlike(form), F.struct(part(1).alias("orig"), (part(2).cast("int") - 1).alias("pos"), part(3).alias("mut")))


def tokens_over(pos: Column, seq: Column | str, max_len: int) -> Column:
    """All substrings of 1 to ``max_len`` letters that cover ``pos`` (from 0) and lie
    inside the sequence, shorter first, then by start."""
    s = _c(seq)
    of_len = lambda n: F.transform(F.filter(F.sequence(pos - n + 1, pos), lambda i: (i >= 0) & (i + n <= F.length(s))), lambda i: F.substr(s, i + 1, n))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_len)), of_len))


def differing_positions(original: Column, *others: Column) -> Column:
    """Positions (from 0) where every other string differs from the original, up to
    the shortest length."""
    arrays = F.struct(symbols(original).alias("o"), *(symbols(x).alias(f"x{k}") for k, x in enumerate(others)))

    def found(a: Column) -> Column:
        n = F.least(F.size(a["o"]), *(F.size(a[f"x{k}"]) for k in range(len(others)))) if others else F.size(a["o"])

        def every(i: Column) -> Column:
            test = F.lit(True)
            for k in range(len(others)):
                test = test & (F.get(a[f"x{k}"], i) != F.get(a["o"], i))
            return test

        return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), every)).when(n == 0, F.array().cast("array<int>"))

    return let(arrays, found)


def features(text: Column | str, kind: str) -> Column:
    """A feature string ``KIND a..b; /note="x"; /evidence="y"; KIND ...`` as an array of
    structs (start_index, end_index, note, evidence); missing parts are null."""
    c = _c(text)
    entry = rf"{kind} ([0-9]+)\.\.([0-9]+)((?:; /[a-z]+=\"[^\"]*\")*)"
    group = lambda i: F.regexp_extract_all(c, F.lit(entry), F.lit(i))
    named = lambda a, n: F.nullif(F.regexp_extract(a, rf'/{n}="([^"]*)"', 1), F.lit(""))
    whole = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("attrs"))
    return F.transform(whole, lambda z: F.struct(z["a"].cast("int").alias("start_index"), z["b"].cast("int").alias("end_index"), named(z["attrs"], "note").alias("note"), named(z["attrs"], "evidence").alias("evidence")))


def literal_list(text: Column | str) -> Column:
    """A list of strings written as a literal, ``['A', 'BC']``, as an array."""
    return F.regexp_extract_all(_c(text), F.lit("'([^']*)'"), F.lit(1))


def feature_rows(df: DataFrame, ident: str, columns: dict[str, str]) -> DataFrame:
    """``ident, source, start_index, end_index, note, evidence``: all features of several
    feature columns, each given with the kind its entries begin with."""
    cells = F.array(*(F.struct(F.lit(c).alias("source"), features(c, kind).alias("found")) for c, kind in columns.items()))
    return df.select(ident, F.inline(cells)).select(ident, "source", F.inline("found"))


def interval_list(text: Column | str) -> Column:
    """``11-41_290-389`` as an array of structs (start_index, end_index)."""
    return F.transform(F.split(_c(text), "_"), lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("int").alias("start_index"), F.split_part(x, F.lit("-"), F.lit(2)).cast("int").alias("end_index")))


#: corpus, matrix, kind, similarity cut-off, shortest and longest unit, frequency cut-off, size, variant
CONFIG = r"^([^_]+)_([^_]+)_(mutbpe|bpe)_(?:([0-9.]+)_([0-9]+)_([0-9]+)_([0-9.]+)_)?([0-9]+)(?:_(.*))?$"


def config_parts(name: Column | str) -> Column:
    """A configuration's name taken apart; parts a name lacks are null."""
    c = _c(name)
    part = lambda i, kind="string": F.nullif(F.regexp_extract(c, CONFIG, i), F.lit("")).cast(kind)
    return F.struct(part(1).alias("corpus"), part(2).alias("matrix"), (part(3) == "bpe").alias("is_bpe"), part(4, "double").alias("sim_cutoff"), part(5, "int").alias("min_len"), part(6, "int").alias("max_len"), part(7, "double").alias("freq_cutoff"), part(8, "int").alias("v_size"), part(9).alias("variant"))


def config_name(corpus: Column, matrix: Column, size: Column, sim: Column | None = None, min_len: Column | None = None, max_len: Column | None = None, freq: Column | None = None) -> Column:
    """The name of a configuration; without a similarity cut-off a plain one."""
    if sim is None:
        return F.concat_ws("_", corpus, matrix, F.lit("bpe"), size)
    return F.concat_ws("_", corpus, matrix, F.lit("mutbpe"), sim, min_len, max_len, freq, size)


def hashed_number(*parts: Column) -> Column:
    """A number from 0 to 2^28 - 1 that any engine with md5 derives alike."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *parts)), F.lit(1), F.lit(7)), 16, 10).cast("int")
