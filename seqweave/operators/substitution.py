"""Substitution matrices and what follows from them: mutations of a unit, and
alternatives to a substitution.

A matrix is a table ``a, b, score``. It is read from a file in NCBI's text format
(``seqweave.sources.readers.read_matrix``) or built by rule from letter classes.
It has at most a few hundred cells, so it enters plans as a literal.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dayhoff's six classes of amino acids (fixed values).
CLASSES = ("AGPST", "C", "DENQ", "FWY", "HKR", "ILMV")
#: Ambiguity letters and what they stand for (fixed values).
AMBIGUOUS = {"B": "DN", "Z": "EQ"}


def class_matrix() -> dict[tuple[str, str], int]:
    """By rule: 10 less the class's size for a letter with itself, 1 within a class,
    -2 between classes; an ambiguity letter has 3 with each of its letters and
    itself, X has -1 with all."""
    letters = sorted("".join(CLASSES)) + list(AMBIGUOUS) + ["X"]
    kin = {x: c for c in CLASSES for x in c}
    out = {}
    for a in letters:
        for b in letters:
            if "X" in (a, b):
                s = -1
            elif a in AMBIGUOUS or b in AMBIGUOUS:
                s = 3 if a == b or b in AMBIGUOUS.get(a, "") or a in AMBIGUOUS.get(b, "") else -2
            elif a == b:
                s = 10 - len(kin[a])
            else:
                s = 1 if kin[a] == kin[b] else -2
            out[a, b] = s
    return out


def matrix_frame(spark: SparkSession, matrix: dict) -> DataFrame:
    return spark.createDataFrame([(a, b, float(s)) for (a, b), s in sorted(matrix.items())], "a string, b string, score double")


def matrix_values(matrix: dict) -> str:
    """The matrix as a SQL VALUES list."""
    return ", ".join(f"('{a}', '{b}', {s})" for (a, b), s in sorted(matrix.items()))


def mutations(token: Column | str, matrix: dict, cutoff: float) -> Column:
    """All other strings of the token's length with similarity of at least ``cutoff``,
    as an array of structs (mutated, similarity), most similar first, then by name.

    Similarity is 1 less the lost score over the token's score with itself. At a
    position only letters of score 0 or more count whose own loss stays below
    1 - cutoff; X and letters outside the matrix stay as they are and have no
    score. The token itself is left out; a token of X alone has none."""
    own = {a: float(s) for (a, b), s in matrix.items() if a == b and a != "X"}
    near: dict = {}
    for (a, b), s in sorted(matrix.items()):
        if a in own and s >= -1e-4:
            near.setdefault(a, []).append((own[a] - s, ord(b)))
    near = {a: (np.array([x for x, _ in v]), np.array([c for _, c in v], dtype=np.uint32)) for a, v in near.items()}
    kind = pa.struct([("mutated", pa.string()), ("similarity", pa.float64())])

    def grown(t: str) -> tuple[list, np.ndarray] | None:
        total = sum(own.get(a, 0.0) for a in t)
        if total <= 0:
            return None
        room = total * (1 - cutoff)
        text, lost = np.zeros((1, 0), dtype=np.uint32), np.zeros(1)
        for a in t:
            loss, letter = near.get(a, (np.zeros(1), np.array([ord(a)], dtype=np.uint32)))
            step = (loss == 0) | (loss < room - 1e-9)
            loss, letter = loss[step], letter[step]
            # every string so far with every letter, as far as the loss allows
            i, j = np.nonzero(lost[:, None] + loss[None, :] <= room + 1e-9)
            text, lost = np.concatenate([text[i], letter[j][:, None]], axis=1), lost[i] + loss[j]
        other = (text != np.array([ord(a) for a in t], dtype=np.uint32)).any(axis=1)
        text, lost = text[other], lost[other]
        order = np.lexsort((*text.T[::-1], lost.round(12))) if len(text) else np.zeros(0, dtype=np.int64)
        return np.ascontiguousarray(text[order]).view(f"U{len(t)}")[:, 0].tolist(), 1 - lost[order] / total

    @F.arrow_udf("array<struct<mutated:string,similarity:double>>")
    def similar(t: pa.Array) -> pa.Array:
        done = [None if x is None or not x else grown(x) for x in t.to_pylist()]
        sizes = [0 if d is None else len(d[0]) for d in done]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32(), mask=np.array([*(d is None for d in done), False]))
        names, values = [x for d in done if d for x in d[0]], np.concatenate([np.zeros(0), *(d[1] for d in done if d)])
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(names, type=pa.string()), pa.array(values)], fields=list(kind)))

    return similar(F.col(token) if isinstance(token, str) else token)


#: Letters for which alternatives are looked up (fixed value).
ALTERNATIVE_LETTERS = "ABCDEFGHIKLMNPQRSTVWYZ"


def alternatives(matrix: dict) -> dict[tuple[str, str], list[tuple[str, float]]]:
    """For each substitution orig -> mut, the other letters that score with orig at
    least as well, with the score gained, best first, then in the alphabet's order."""
    out = {}
    for o in ALTERNATIVE_LETTERS:
        for m in ALTERNATIVE_LETTERS:
            if o != m and (o, m) in matrix:
                found = [(a, float(matrix[o, a] - matrix[o, m])) for a in ALTERNATIVE_LETTERS if a not in (o, m) and matrix.get((o, a), -1e9) >= matrix[o, m]]
                out[o, m] = sorted(found, key=lambda x: -x[1])
    return out


def first_alternatives(v: DataFrame, matrix: dict, *, block_tokens: int = 2_000) -> DataFrame:
    """``config_id, token, mutation, alternative, score``: for each mutated unit of a
    vocabulary the first mutation of its parent (in order of token id, of the unit's
    length, not the unit itself) that has an alternative. That is a unit of the vocabulary
    outside the family, merged later than the mutation, that differs from it by an
    alternative wherever the mutation differs from the token and equals it elsewhere; the
    best sum of gains, then the name, decides. Units of one configuration and length meet
    in a task, the tokens asked for in blocks of about ``block_tokens``."""
    letters = {x: i for i, x in enumerate(sorted({x for k in matrix for x in k} | set(ALTERNATIVE_LETTERS)))}
    gains = {}
    for (o, m), found in alternatives(matrix).items():
        row = np.full(len(letters), np.nan)
        for c, g in found:
            row[letters[c]] = g
        gains[o, m] = row

    def run(asked: pa.Table, units: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = sorted(zip(*(units[c].to_pylist() for c in ("unit", "unit_parent", "unit_order", "unit_id"))))
        names = [r[0] for r in rows]
        order = np.array([-np.inf if r[2] is None else r[2] for r in rows], dtype=float)
        family = np.array([r[1] or "" for r in rows], dtype=object)
        text = np.array([list(n) for n in names], dtype="U1").reshape(len(names), -1) if names else np.zeros((0, 0), dtype="U1")
        code = np.full(text.shape, len(letters))
        for x, k in letters.items():
            code[text == x] = k
        place = {n: i for i, n in enumerate(names)}
        letter_of = {i: x for x, i in letters.items()}
        choices = {k: [letter_of[i] for i in np.flatnonzero(~np.isnan(g))] for k, g in gains.items()}
        pool: dict = {}
        for r in sorted(rows, key=lambda r: r[3]):
            if r[1] is not None:
                pool.setdefault(r[1], []).append((r[0], r[2]))
        for token, parent in zip(asked["token"].to_pylist(), asked["parent"].to_pylist()):
            for mutation, after in pool.get(parent, ()):
                if mutation == token or after is None:
                    continue
                steps = [(o,) if o == m else choices.get((o, m), ()) for o, m in zip(token, mutation)]
                if math.prod(map(len, steps)) <= len(names):
                    # the few strings that would do are looked up
                    at = sorted(place[x] for x in map("".join, product(*steps)) if x in place and order[place[x]] > after)
                else:
                    at = np.flatnonzero(order > after)
                    for i, (o, m) in enumerate(zip(token, mutation)):
                        at = at[text[at, i] == o] if o == m else at[~np.isnan(np.append(gains[o, m], np.nan)[code[at, i]])]
                at = [a for a in at if family[a] != parent and names[a] not in (token, parent)]
                if at:
                    score = [sum(gains[o, m][code[a, i]] for i, (o, m) in enumerate(zip(token, mutation)) if o != m) for a in at]
                    best = max(range(len(at)), key=lambda k: (score[k], -k))  # noqa: B023
                    out.append((asked["config_id"][0].as_py(), token, mutation, names[at[best]], float(score[best])))
                    break
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(list(c), type=pa.float64() if k == 4 else pa.string()) for k, c in enumerate(cols)], names=["config_id", "token", "mutation", "alternative", "score"])

    n = F.length("token").alias("n")
    asked = v.filter("parent IS NOT NULL").select("config_id", n, "token", "parent")
    blocks = asked.groupBy("config_id", "n").agg(F.ceil(F.count("*") / block_tokens).cast("int").alias("blocks"))
    asked = asked.join(blocks, ["config_id", "n"]).withColumn("block", F.pmod(F.xxhash64("token"), "blocks").cast("int")).drop("blocks")
    # aliased, so that the two sides of the cogroup name different columns
    units = v.select(F.col("config_id").alias("config_id"), n, F.col("token").alias("unit"), F.col("parent").alias("unit_parent"), F.col("merge_order").alias("unit_order"), F.col("token_id").alias("unit_id"))
    units = units.join(blocks, ["config_id", "n"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ("config_id", "n", "block")
    return asked.groupBy(*key).cogroup(units.groupBy(*key)).applyInArrow(run, "config_id string, token string, mutation string, alternative string, score double")
