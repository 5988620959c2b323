import random
from collections import Counter
from itertools import combinations

from seqweave.llm.cooccurrence import PairTable

SCHEMA = "basket string, item string, bucket int"


def expect(rows):
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).update({i} - {None})
    pairs = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return pairs, Counter(i for s in baskets.values() for i in s), len(baskets)


def test_signed_changes_equal_a_recount(spark):
    rng = random.Random(4)
    make = lambda n: [("hot" if rng.random() < 0.3 else f"b{rng.randrange(12)}", "top" if rng.random() < 0.3 else f"i{rng.randrange(25)}") for _ in range(n)]
    table, held = PairTable(spark, bucket_rows=40, chunk=4, compact=3), set()
    steps = [(make(80), None), (make(40), make(60)), ([], make(20)), (make(30), None), ([], None)]
    for k, (add, rem) in enumerate(steps):
        df = lambda rows: spark.createDataFrame([(*r, 1) for r in rows * 2] + [(None, "x", 1), ("b1", None, 1)], SCHEMA)
        changed = table.update(df(add), None if rem is None else df(rem))
        new = (held | set(add) | {("b1", None)}) - (set() if rem is None else {*rem, ("b1", None)})
        assert {r["item"] for r in changed.collect()} == {i for _, i in held ^ new} - {None}
        held = new
        table.rescore(changed)
        if k == 2:
            table = PairTable.reopen(spark, table.manifest())
        pairs, items, n = expect(held)
        assert {(r["a"], r["b"]): r["joint"] for r in table.pairs().collect()} == dict(pairs)
        assert {r["item"]: r["n"] for r in table.items().collect()} == dict(items)
        assert table.baskets == n
        assert {(r["basket"], r["item"]) for r in table.contents().collect()} == {x for x in held if x[1]}
        stored, fresh = ({tuple(r) for r in t.select("a", "b", "joint", "n_a", "n_b", "n_baskets").collect()} for t in (table.scores(), table.scores(spark.createDataFrame([(i,) for i in items], "item string"))))
        assert stored == fresh and len(stored) == len(pairs)
    assert table.state["buckets"] > 2 and len(table.state["own"]) <= 3
    some = table.scores(spark.createDataFrame([("top",)], "item string")).collect()
    assert {(r["a"], r["b"]) for r in some} == {p for p in pairs if "top" in p}
    assert all(abs(r["lift"] - r["joint"] * n / r["n_a"] / r["n_b"]) < 1e-9 for r in some)


def test_empty_table(spark):
    table = PairTable(spark)
    table.rescore(table.update(spark.createDataFrame([], SCHEMA)))
    assert table.scores().count() == 0 and table.baskets == 0


def test_scores_stored_late_are_whole(spark):
    table = PairTable(spark)
    for b, i in (("1", "x"), ("1", "y"), ("2", "z"), ("2", "w")):
        touched = table.update(spark.createDataFrame([(b, i, 0)], SCHEMA))
    table.rescore(touched)
    assert {(r["a"], r["b"]) for r in table.scores().collect()} == {("x", "y"), ("w", "z")}
