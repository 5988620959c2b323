"""Column functions, agreement measures and corpus operators by hand."""

from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqweave.functions import sequences as S
from seqweave.operators import corpus as C
from seqweave.operators import masked as M
from seqweave.operators import segmentation as G
from seqweave.operators import topics as T
from seqweave.operators import variants as V
from seqweave.operators.ontology import closure, nearest_in, without_ancestors


def one(spark, schema, row, *cols):
    return tuple(spark.createDataFrame([row], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).collect()[0])


def test_sequence_functions(spark):
    got = one(spark, "s string, e string, n string, code string, i string", ("ABCDEFG", "", None, "K232E", "11-41_290-389"), S.kmers("s", 3), S.kmers("e", 3), S.kmers("n", 3), S.symbols("e"), S.letter_count("s", "A"), S.mutation_code("code"), S.mutation_code("s"), S.interval_list("i"), S.with_letter("s", F.lit(2), F.lit("x")), S.tokens_over(F.lit(0), "s", 2), M.masked(F.col("s"), F.lit(0)))
    assert got[:5] == (["ABC", "DEF", "G"], [], None, [], 1)
    assert tuple(got[5]) == ("K", 231, "E") and got[6] is None
    assert [tuple(x) for x in got[7]] == [(11, 41), (290, 389)] and got[8] == "ABxDEFG" and got[9] == ["A", "AB"] and got[10] == "?BCDEFG"
    text = 'COILED 3..63; /evidence="E1"; COILED 256..290; /note="n; x"; /evidence="E2"'
    got = one(spark, "t string", (text,), S.features("t", "COILED"))[0]
    assert [tuple(x) for x in got] == [(3, 63, None, "E1"), (256, 290, "n; x", "E2")]
    got = one(spark, "c string", ("hf_blosum62_mutbpe_0.7_3_12_0.05_800",), S.config_parts("c"))[0]
    assert (got["v_size"], got["freq_cutoff"], got["sim_cutoff"], got["is_bpe"]) == (800, 0.05, 0.7, False)
    got = one(spark, "a string, b string, c string", ("ABCD", "AXCY", "ZXCQ"), S.differing_positions(F.col("a"), F.col("b"), F.col("c")), S.offsets(F.array(F.lit("AB"), F.lit("CDE"))))
    assert got[0] == [1, 3] and [tuple(x) for x in got[1]] == [("AB", 0, 2), ("CDE", 2, 5)]


def test_agreement_by_hand(spark):
    a, b = F.col("a"), F.col("b")
    got = one(spark, "a array<string>, b array<string>", (["AB", "CD"], ["A", "BCD"]), G.boundary_dice(a, b), G.boundary_accuracy(a, b), G.pair_indices(a, b), G.kway_dice(a, b, a))
    assert round(got[0], 6) == 0.666667 and got[1] == 0.6
    x = got[2]
    assert (x["tp"], x["fp"], x["fn"], x["tn"]) == (1, 1, 2, 2) and x["rand"] == 0.5 and round(x["dice"], 9) == 0.4 and round(x["jaccard"], 9) == 0.25
    assert one(spark, "a array<string>, b array<string>", (["AB"], ["ABC"]), G.boundary_dice(a, b), G.pair_indices(a, b)) == (None, None)


@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 9)), min_size=1, max_size=5))
@settings(max_examples=6, deadline=None)
def test_pair_counts_equal_brute_force(spark, cases):
    rows = []
    for lens, seed in cases:
        n = sum(lens)
        other = [len(x) for x in "".join("|" if (i * 7 + seed) % 3 == 0 and i else "" for i in range(n)).split("|")]
        cut, b = 0, []
        for i in range(1, n):
            if (i * 7 + seed) % 3 == 0:
                b.append("x" * (i - cut))
                cut = i
        b.append("x" * (n - cut))
        rows.append((["x" * k for k in lens], b))
        del other
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for (ta, tb), r in zip(rows, df.select(G.pair_indices(F.col("a"), F.col("b")).alias("x")).collect()):
        ua, ub = ([i for i, t in enumerate(z) for _ in t] for z in (ta, tb))
        count = Counter((ua[i] == ua[j], ub[i] == ub[j]) for i, j in combinations(range(len(ua)), 2))
        assert (r["x"]["tp"], r["x"]["fp"], r["x"]["fn"], r["x"]["tn"]) == (count[True, True], count[True, False], count[False, True], count[False, False])


def test_corpus_operators(spark):
    df = spark.createDataFrame([("a", "ACX"), ("b", "XXA"), ("c", None), ("d", ""), ("e", "A" * 9)], "id string, sequence string")
    assert sorted(r["id"] for r in C.quality_filter(df, "sequence", max_len=8).collect()) == ["a"]
    assert {(r["left"], r["right"]): r["cnt"] for r in C.adjacent_pairs(spark.createDataFrame([("AAAA",), ("A",), ("",), (None,)], "sequence string")).collect()} == {("A", "A"): 3}
    rows = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (3, None, 3), (4, None, 4), (5, "t", 5), (6, "u", None)], "id int, key string, v int")
    ins, rej = C.insert_or_ignore(rows.filter("key = 't'"), rows, ["key"], ["id"], required=("v",))
    assert sorted(r["id"] for r in ins.collect()) == [1, 3, 4] and sorted(r["id"] for r in rej.collect()) == [2, 5, 6]


def test_ontology(spark):
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", None)], "child string, parent string")
    up = closure(e)
    assert {tuple(r) for r in up.collect()} == {("c", "b"), ("c", "a"), ("c", "d"), ("b", "a"), ("d", "a"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}
    slim = spark.createDataFrame([("a",), ("b",)], "term string")
    assert {tuple(r) for r in nearest_in(e, slim).collect()} == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "a")}
    rows = spark.createDataFrame([("p", "a"), ("p", "c"), ("q", "a")], "k string, t string")
    assert {tuple(r) for r in without_ancestors(rows, "k", "t", up).collect()} == {("p", "c"), ("q", "a")}


def test_graph_and_ranks(spark):
    edges = spark.createDataFrame([("p", "c1", "mutation"), ("p", "c2", "mutation")], "src string, dst string, kind string")
    units = spark.createDataFrame([("p",), ("c1",), ("c2",)], "unit string")
    m = {(r["a"], r["b"]): round(r["value"], 9) for r in T.smoothing(T.unit_graph(edges), units).collect()}
    assert (m["p", "p"], m["c1", "p"], m["c2", "p"]) == (0.5, 0.25, 0.25) and (m["p", "c1"], m["c1", "c1"], m["c2", "c1"]) == (0.2, 0.5, 0.3)
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (5.0, 2.0), (9.0, 9.0), (None, 1.0), (float("nan"), 2.0)], "u double, e double")
    r = T.spearman(df, "u", "e").collect()[0]
    assert r["n"] == 4 and round(r["rho"], 6) == 0.632456
    assert abs(T.spearman_p(10, 0.5) - 0.1411) < 2e-4
    same = T.scaled(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect()
    assert [x["scaled"] for x in same] == [0.0, 0.0]
    assert [x["scaled"] for x in T.scaled(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v").orderBy("v").collect()] == [0.0, 0.5, 1.0]


def test_variants_and_softmax(spark):
    df = spark.createDataFrame([(f"p{i}", "ACDEFGHIKL"[: i % 11], i) for i in range(60)] + [("n", None, 0)], "k string, s string, mut int").drop("mut")
    rows = V.random_mutations(df, "k", "s").collect()
    assert len(rows) == sum(1 for i in range(60) if i % 11)
    for r in rows:
        assert r["orig"] == r["s"][r["pos"]] != r["mut"] and r["mutated"] == r["s"][: r["pos"]] + r["mut"] + r["s"][r["pos"] + 1 :]
    got = one(spark, "a array<string>", (["AB", "CDE"],), V.token_at(F.col("a"), F.lit(2)), V.token_at(F.col("a"), F.lit(9)), M.softmax(F.array(F.lit(0.0), F.lit(0.0))))
    assert got == ("CDE", None, [0.5, 0.5])
    base = one(spark, "o string, m string, a string", ("AAC", "ARD", "AND"), M.random_baseline(F.col("o"), F.col("m"), F.col("a"), F.lit("s")))[0]
    assert base[0] == "A" and base[1] not in "A" and base[2] == "D"


def test_replacements_are_scored_without_a_copy_for_each_configuration(spark):
    import random

    from pyspark.sql import functions as F

    from seqweave.operators import masked as M

    rng = random.Random(3)
    texts = ["".join(rng.choices("ACDE", k=rng.randrange(1, 40))) for _ in range(60)]
    p = spark.createDataFrame([(f"e{i}", s) for i, s in enumerate(texts)], "seq_id string, s string")
    tokens = p.select("seq_id", F.regexp_extract_all("s", F.lit(".{1,3}"), F.lit(0)).alias("tokens"))
    ways = [("ACD", "ECD", "DCD"), ("CCA", "DEA", "EDA"), ("DDE", "DDA", "DDC")]
    rows = [(f"c{k}", *w, 1.0) for k in range(5) for w in ways[k % 2 :]] + [("c9", "ACD", "AED", "AAD", 1.0)]
    r = spark.createDataFrame(rows, "config_id string, token string, mutation string, alternative string, score double")
    scores = M.neighbour_scores(p, "s")
    got = M.replacement_win_rates(tokens, r, scores)
    want = M.win_rates(M.replaced_sequences(tokens.crossJoin(r.select("config_id").distinct()), r), scores, "config_id")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 6
