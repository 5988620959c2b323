"""Trainers and encoders on hand-worked and random corpora."""

import os
import random

import pytest

from seqweave.operators.encoding import Encoder, encode, export
from seqweave.operators.substitution import class_matrix, mutations
from seqweave.operators.trainer import Rules, similar_strings, train, train_distributed, train_local, train_together, train_units

TOY = {("A", "A"): 4, ("A", "S"): 1, ("A", "G"): 0, ("S", "S"): 4, ("S", "T"): 1, ("S", "A"): 1, ("S", "N"): 1, ("G", "G"): 6, ("T", "T"): 5, ("N", "N"): 6}


def corpus(seed, letters="ABC", n=25, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randrange(most))) for _ in range(n)]


def test_worked_example():
    v = train_local(["ABABC", "ABC"], Rules("vocab_size", 6)).units
    assert {k: (x["frequency"], x["order"]) for k, x in v.items()} == {"A": (0, 0), "B": (0, 0), "C": (0, 0), "AB": (3, 1), "ABC": (2, 2), "ABABC": (1, 3)}
    assert train_local(["AAAA"], Rules("vocab_size", 2)).units["AA"]["frequency"] == 3
    assert list(train_local(["", "A"], Rules("vocab_size", 99)).units) == ["A"]


def test_stop_rules():
    c = corpus(1)
    assert all(x["frequency"] > 9 for x in train_local(c, Rules("freq_cutoff", 9)).units.values() if x["order"])
    some = train_local(c, Rules("freq_proportion", 0.5)).units
    first = max(x["frequency"] for x in some.values())
    assert all(x["frequency"] > 0.5 * first for x in some.values() if x["order"])
    with pytest.raises(ValueError):
        Rules("other", 1)


def naive(sequences, size):
    """Recount, merge, repeat."""
    seqs, units, n = [[*s] for s in sequences], sorted({c for s in sequences for c in s}), 0
    out = {u: 0 for u in units}
    while len(out) < size:
        count = {}
        for s in seqs:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + 1
        if not count:
            break
        (a, b), f = min(count.items(), key=lambda x: (-x[1], x[0]))
        n += 1
        out.setdefault(a + b, f)
        new = []
        for s in seqs:
            t, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                    t.append(a + b)
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            new.append(t)
        seqs = new
    return out, seqs


@pytest.mark.parametrize("seed", range(4))
def test_three_trainers_agree(spark, seed):
    letters = ("AB", "ABC", "ACDEFGHIKL", "ACDEFGHIKLMNPQRSTVWY")[seed]
    c = corpus(seed, letters, 40, 40)
    size = len(letters) + 14
    want, segmented = naive(c, size)
    v = train_local(c, Rules("vocab_size", size))
    assert {k: x["frequency"] for k, x in v.units.items()} == want
    df = spark.createDataFrame([(s,) for s in [*c, None, ""]], "s string").repartition(3)
    rows = train_distributed(df, "s", Rules("vocab_size", size), rewrite_every=5).collect()
    assert [(r["token"], r["frequency"]) for r in sorted(rows, key=lambda r: r["token_id"])] == list(want.items())
    if not v.extra:
        model = export([r.asDict() for r in rows])
        enc = encode(df, "s", model).collect()
        own = encode(df, "s", model, native=True).collect()
        key = lambda r: (r["s"] is None, r["s"] or "", str(r["encoding"]))
        assert sorted(enc, key=key) == sorted(own, key=key)
        assert sorted([t["token"] for t in r["encoding"]] for r in enc if r["s"]) == sorted(t for t in segmented if t)


def test_mutated_trainers_agree(spark):
    c = corpus(7, "ASTPGDE", 60, 40)
    rules = Rules("vocab_size", 60, mutated=True, matrix=class_matrix(), mutation_cutoff=0.6, min_mutation_freq=0.1)
    v = train_local(c, rules)
    kids = {k: x for k, x in v.units.items() if "parent" in x}
    assert kids and all(len(k) == len(x["parent"]) and x["similarity"] >= 0.6 and v.units[x["parent"]]["is_parent"] for k, x in kids.items())
    df = spark.createDataFrame([(s,) for s in c], "s string")
    got = sorted((tuple(r)[1:] for r in train_distributed(df, "s", rules).collect()))
    assert got == sorted(r[1:] for r in v.rows("x"))
    plain = train_local(c, Rules("vocab_size", 40)).rows("c")
    assert train_local(c, Rules("vocab_size", 40, mutated=True, matrix=class_matrix(), mutation_cutoff=1.1)).rows("c") == plain
    both = train_units(df, "s", {"a": Rules("vocab_size", 40), "b": rules}).collect()
    assert sorted(r["token"] for r in both if r["config_id"] == "a") == sorted(r[2] for r in plain)
    with pytest.raises(ValueError):
        train_units(df, "s", {"a": rules}, most_chars=3)


@pytest.mark.parametrize("seed", range(3))
def test_trainer_of_tasks_that_run_together_agrees(spark, seed):
    c = corpus(seed, ("A", "ASTPGDE", "ACDEFGHIKLMNPQRSTVWY")[seed], 60, 40)
    rules = Rules("vocab_size", 60, mutated=seed > 0, matrix=class_matrix(), mutation_cutoff=0.6, min_mutation_freq=0.1, max_mutation_len=4)
    v = train_local(c, rules)
    df = spark.createDataFrame([(s,) for s in [*c, None, ""]], "s string")
    for chunks in (1, 3):
        got = sorted(tuple(r) for r in train_together(df, "s", rules, config="x", chunks=chunks).collect())
        assert got == sorted(v.rows("x"))
    few = spark.createDataFrame([("ABABC",), ("ABC",)], "s string")  # and tasks without a sequence
    assert [r["token"] for r in train_together(few, "s", Rules("vocab_size", 6), chunks=6).orderBy("token_id").collect()] == ["A", "B", "C", "AB", "ABC", "ABABC"]


def test_a_large_corpus_takes_no_job_for_each_merge(spark):
    c = corpus(5, "ASTPGDE", 60, 40)
    rules = {"x": Rules("vocab_size", 60, mutated=True, matrix=class_matrix(), mutation_cutoff=0.6, min_mutation_freq=0.1, max_mutation_len=4)}
    df = spark.createDataFrame([(s,) for s in c], "s string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("large corpus", "")
    got = train(df, "s", rules, most_chars=100).collect()
    jobs = len(tracker.getJobIdsForGroup("large corpus"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in got) == sorted(train_local(c, rules["x"]).rows("x"))
    assert jobs < 12


def test_mutations_of_a_token(spark):
    want = {("AS", "AA"): 0.625, ("AS", "AN"): 0.625, ("AS", "AT"): 0.625, ("AS", "SS"): 0.625}
    assert {("AS", m): s for m, s in similar_strings("AS", TOY, 0.5)} == want  # GS, exactly 0.5 by one letter, is out
    rows = spark.createDataFrame([("AS",), ("XX",), (None,), ("AXA",), ("AUS",)], "t string").select("t", mutations("t", TOY, 0.5).alias("m")).collect()
    for r in rows:
        expect = similar_strings(r["t"], TOY, 0.5) if r["t"] else []
        assert [(x["mutated"], round(x["similarity"], 9)) for x in r["m"] or []] == [(m, round(s, 9)) for m, s in expect]


def test_encoder_by_rank():
    vocab = ["A", "B", "C", "AB", "BC", "ABC", "AA"]
    model = {"model": {"vocab": {v: i for i, v in enumerate(vocab)}, "merges": [["B", "C"], ["A", "B"], ["A", "BC"], ["A", "A"]]}}
    e = Encoder(model)
    assert [e.tokens(x) for x in ("ABC", "AAAA", "AAA", "AZB", "")] == [["ABC"], ["AA", "AA"], ["AA", "A"], ["AB"], []]


def test_registered_runs_learn_a_whole_vocabulary(spark):
    from seqweave.plans import model_queries as Q

    folder = "/root/testdata/sf0.001"
    c = [r["s"] for r in Q._corpus(spark, folder).collect()]
    for name, kind in (("train_default", "plain"), ("train_mutated", "family")):
        rules = Q._RULES[kind]
        assert rules.stop_parameter >= 800 and rules.mutation_cutoff >= 0.8 and rules.min_mutation_len >= 3
        rows = sorted(Q.QUERIES[name](spark, folder).collect(), key=lambda r: r["token_id"])
        assert len(rows) >= 800
        assert [tuple(r) for r in rows] == train_local(c, rules).rows(kind)


def test_encoding_takes_a_batch_in_blocks():
    import pyarrow as pa

    from seqweave.operators.encoding import _blocks

    texts = ["AB" * 3, None, "A" * 20, "", "C" * 4, "D" * 4, "E"]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, type=pa.string())], names=["i", "s"])
    got = [x.column(1).to_pylist() for x in _blocks(b, 1, 8)]
    assert [s for x in got for s in x] == texts
    assert all(len(x) == 1 or sum(len(s or "") for s in x) <= 8 for x in got) and len(got) == 4


@pytest.mark.parametrize("seed", range(3))
def test_learning_in_one_task_takes_few_bytes_a_letter(seed):
    import tracemalloc

    from seqweave.operators.trainer import train_alone

    letters = ("A", "ASTPGDE", "ACDEFGHIKLMNPQRSTVWY")[seed]
    rules = Rules("vocab_size", 60, mutated=seed > 0, matrix=class_matrix(), mutation_cutoff=0.6, min_mutation_freq=0.1, max_mutation_len=4)
    for c in (corpus(seed, letters, 60, 40), [], [""], ["A"]):
        assert train_alone(c, rules).rows("x") == train_local(c, rules).rows("x")
    c = corpus(seed, letters, 4_000, 100)
    tracemalloc.start()
    train_alone(c, rules)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 4.5 MB are the table of letters; sets of places took 200 bytes a letter and more
    assert most < 6e6 + 60 * sum(map(len, c))


def test_comparing_cuts_in_the_task_agrees_with_tokenisations(spark):
    from seqweave.operators import variants as V
    from seqweave.operators.encoding import cuts_compared
    from pyspark.sql import functions as F

    rng = random.Random(3)
    c = corpus(3, "ABC", 80, 30)
    model = export([dict(token_id=i, token=u, merge_order=x["order"], pair=x.get("pair")) for i, (u, x) in enumerate(train_local(c, Rules("vocab_size", 14)).units.items())])
    rows = [(s, s[: (p := rng.randrange(len(s)))] + rng.choice("ABCZ") + s[p + 1 :], p) for s in c if s]
    rows += [(None, "AB", 0), ("AB", None, 1), ("", "", 0), ("ABC", "AB", 9), ("AB", "ABC", None), ("ZZ", "A", 0), ("AB", "AB", -1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, m string, pos int")
    both = encode(encode(df, "s", model, "a"), "m", model, "b").withColumns({"x": F.col("a.token"), "y": F.col("b.token")})
    want = V.judged(both, "x", "y", "pos", lambda a, b: F.lit(False)).select("i", "pos", "same", "ori_token", "mut_token").orderBy("i").collect()
    assert {r["same"] for r in want} == {True, False, None}
    for native in (False, True):
        got = cuts_compared(df, "s", "m", "pos", model, native)
        assert got.columns == ["i", "pos", "same", "ori_token", "mut_token"]
        assert got.orderBy("i").collect() == want


def test_variants_are_encoded_once(spark):
    from pyspark.sql import functions as F

    from seqweave.operators import variants as V
    from seqweave.operators.genealogy import families
    from seqweave.plans import model_queries as Q

    folder = "/root/testdata/sf0.001"
    df = Q.variant_siblings(spark, folder)
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    v = Q._family(spark, folder)
    m = Q._mutated(spark, folder).withColumn("config_id", F.lit("family"))
    both = encode(encode(m, "s", Q._model(v), "a"), "mutated", Q._model(v), "b").withColumns({"x": F.col("a.token"), "y": F.col("b.token")})
    judged = V.judged(both, "x", "y", "pos", lambda a, b: F.lit(False)).drop("is_sibling")
    assert df.collect() == V.sibling_rates(V.with_siblings(judged, families(v)), "config_id").collect()


def test_tasks_that_run_together_do_not_wait_for_receipts(monkeypatch):
    import socket
    import threading

    from seqweave.operators import trainer as T

    n, said, meet, ends = 3, {}, threading.Barrier(3), []

    class Task:
        def __init__(self, i):
            self.i = i

        def getTaskInfos(self):
            return [type("Info", (), {"address": "127.0.0.1:1"})] * n

        def partitionId(self):
            return self.i

        def allGather(self, m):
            said[self.i] = m
            meet.wait()
            return [said[i] for i in range(n)]

    class Listener(T.Listener):
        def accept(self):
            ends.append(super().accept())
            return ends[-1]

    def client(*a, dial=T.Client, **k):
        ends.append(dial(*a, **k))
        return ends[-1]

    monkeypatch.setattr(T, "Listener", Listener)
    monkeypatch.setattr(T, "Client", client)
    got, delays = {}, []

    def run(i):
        with T._gathering(Task(i)) as gather:
            got[i] = [sorted(gather(bytes([i]) * 9_000)) for _ in range(5)]
            meet.wait()
            if not i:
                for e in ends:
                    with socket.socket(fileno=os.dup(e.fileno())) as s:
                        delays.append(not s.getsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY))
            meet.wait()

    each = [threading.Thread(target=run, args=(i,)) for i in range(n)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert got == {i: [[bytes([k]) * 9_000 for k in range(n)]] * 5 for i in range(n)}
    assert delays == [False] * 4  # both ends of two connections; a message in two parts took 40 ms


def test_encoding_takes_one_thread_of_a_task():
    import subprocess
    import sys

    text = """
import json, os
from seqweave.operators.encoding import _Cutter
model = {"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": {"A": 0, "B": 1, "AB": 2}, "merges": [["A", "B"]]}}
cutter = _Cutter(json.dumps(model), False)
assert cutter.library is not None
before = len(os.listdir("/proc/self/task"))
assert cutter.cut(["ABAB", "BA"] * 500)[1].tolist() == [2, 2, 1, 0] * 500
print(len(os.listdir("/proc/self/task")) - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    done = subprocess.run([sys.executable, "-c", text], env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "0", done
