"""The operators of the general problems against brute force on small inputs."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from seqweave.functions.ids import canonical_accession, canonical_go
from seqweave.operators.heavy_keys import per_key_totals
from seqweave.operators.hierarchy import descendants, forest_paths, ring_members
from seqweave.operators.intervals import islands_and_gaps
from seqweave.operators.references import orphan_references

T0 = datetime(2024, 1, 1)


def test_canonical_ids(spark):
    rows = [(" uniprotkb:a1b2-3 ", " go_0001"), ("P1", "GO:0001 "), (None, None), ("", ""), ("A-B", "go:12"), ("X:Y:z9-12", "other")]
    df = spark.createDataFrame(rows, "a string, g string").select(canonical_accession("a"), canonical_go("g"))
    assert [tuple(r) for r in df.collect()] == [("A1B2", "GO:0001"), ("P1", "GO:0001"), (None, None), ("", ""), ("A-B", "GO:12"), ("Z9", "OTHER")]


def test_orphans_with_a_hot_key(spark):
    rng = random.Random(1)
    day = lambda n: T0 + timedelta(days=n)
    parents = [(f"k{i}", day(rng.randrange(20)), day(rng.randrange(20, 40)) if rng.random() < 0.3 else None, i) for i in range(50)]
    parents += parents[:5] + [("k1", day(0), None, 9), (None, None, None, 1), ("long" * 40, None, None, 2)]
    refs = [(i, "k7" if i % 3 == 0 else rng.choice(["long" * 40, "long" * 40 + "x", None, f"k{rng.randrange(60)}"]), day(rng.randrange(45)) if rng.random() < 0.95 else None, "range") for i in range(900)]
    first, gone = defaultdict(lambda: None), defaultdict(lambda: None)
    low = lambda a, b: b if a is None else a if b is None else min(a, b)
    for k, f, g, _ in parents:
        first[k], gone[k] = low(first.get(k), f), low(gone.get(k), g)
    want = {}
    for i, k, at, _ in refs:
        if k is None:
            continue
        if k not in first:
            want[i] = "absent"
        elif at and gone[k] and at >= gone[k]:
            want[i] = "withdrawn"
        elif at and first[k] and at < first[k]:
            want[i] = "not_yet"
    r = spark.createDataFrame(refs, "id long, key string, at timestamp, range_id string")
    p = spark.createDataFrame(parents, "key string, first timestamp, gone timestamp, at long")
    spec = dict(ref_key="key", ref_time="at", parent_key="key", parent_first="first", parent_gone="gone", carry=["id", "range_id"])
    for block in (40, 10_000):
        got = orphan_references(r, p, block_rows=block, range_rows=7, **spec).collect()
        assert {x["id"]: x["reason"] for x in got} == want and len(got) == len(want) and {x["range_id"] for x in got} == {"range"}
    assert orphan_references(r.limit(0), p, **spec).count() == 0
    assert orphan_references(r, p.limit(0), **spec).filter("reason = 'absent'").count() == sum(k is not None for _, k, _, _ in refs)


def test_per_key_totals_in_a_tree(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else rng.choice([None, "", "x" * 5000, f"k{rng.randrange(300)}"]), rng.choice([None, 1.5, 2.0]), "a") for _ in range(4000)]
    n, s = Counter(k for k, _, _ in rows), Counter()
    for k, v, _ in rows:
        s[k] += v or 0
    df = spark.createDataFrame(rows, "block string, n double, keys string").repartition(9)
    for args in ({}, {"fan_in": 2, "blocks": 3, "flush_keys": 50}):
        got = {r["key_id"]: (r["n_rows"], r["total"]) for r in per_key_totals(df, "block", "n", **args).collect()}
        assert got == {k: (n[k], s[k]) for k in n if k is not None}
    assert per_key_totals(df.limit(0), "block").count() == 0


@pytest.mark.parametrize("width", [2, 7, 1000])
def test_forest_and_rings(spark, width):
    rng = random.Random(width)
    rows, want, pairs = [], {}, {}
    for g in ("a", "b"):
        up = {i: rng.choice([None, "gone", f"t{rng.randrange(60)}", f"t{max(0, i - rng.randrange(1, 9))}"]) for i in range(60)}
        two = {i: (f"t{rng.randrange(max(1, i))}", f"t{rng.randrange(60)}" if rng.random() < 0.15 else "gone") for i in range(60)}
        rows += [(g, i, f"t{i}", up[i], list(two[i]), 1) for i in up] * 2
        to = lambda x: int(x[1:]) if x and x != "gone" else None
        for i in up:
            seen, v = [i], to(up[i])
            while v is not None and v not in seen:
                seen.append(v)
                v = to(up[v])
            want[g, i] = ("tree", [f"t{x}" for x in reversed(seen)]) if v is None else ("ring" if v == i else "leads_to_ring", None)
            out, front = set(), [i]
            while front:
                for x in two[front.pop()]:
                    if x != "gone" and to(x) not in out:
                        out.add(to(x))
                        front.append(to(x))
            pairs[g, i] = i in out
    rows += [(None, 1, "t", None, None, 1), ("a", None, "t", None, None, 1), ("a", 99, None, None, None, 1)]
    df = spark.createDataFrame(rows, "g string, id int, name string, parent string, pair array<string>, target int")
    paths = forest_paths(df, "g", "id", "name", "parent", block_nodes=width)
    got = {(r["g"], r["id"]): (r["status"], r["path"]) for r in paths.collect()}
    assert got == want
    below = Counter((r["g"], r["ancestor"]) for r in descendants(paths).collect())
    assert below == Counter((g, a) for (g, _), (_, p) in want.items() if p for a in p[:-1])
    found = ring_members(df, "g", "id", "name", [df["pair"][0], df["pair"][1]], width=width, block_edges=10)
    assert {(r["g"], r["id"]) for r in found.collect()} == {k for k, v in pairs.items() if v}
    assert forest_paths(df.limit(0), "g", "id", "name", "parent").count() == 0
    assert ring_members(df.limit(0), "g", "id", "name", [df["parent"]]).count() == 0


def test_islands_and_gaps(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"e{rng.randrange(8)}", rng.choice([None, rng.randrange(-2, 400)]), None, "k") for _ in range(600)]
    rows = [(e, s, None if s is None or rng.random() < 0.05 else s + rng.randrange(-2, 6), k) for e, s, _, k in rows] + [(None, 1, 2, "k")]
    want = []
    for e in {r[0] for r in rows} - {None}:
        on = sorted({x for a, s, t, _ in rows if a == e and s is not None and t is not None and 1 <= s <= t for x in range(s, t + 1)})
        runs = []
        for x in on:
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        want += [(e, "covered", a, b) for a, b in runs] + [(e, "gap", p[1] + 1, q[0] - 1) for p, q in zip(runs, runs[1:])]
    df = spark.createDataFrame(rows, "e string, s int, t int, kind string")
    for width in (10, 16_384):
        got = [tuple(r) for r in islands_and_gaps(df, "e", "s", "t", min_start=1, range_width=width).collect()]
        assert sorted(got) == sorted(want)
    assert islands_and_gaps(df.limit(0), "e", "s", "t").count() == 0


def test_ranges_of_the_keys():
    import numpy as np
    import pyarrow as pa

    from seqweave.operators.references import Ranges, _fixed, _points

    rng = random.Random(5)
    keys = ["", "a", "a" * 64, "a" * 65, "a" * 66, "é", "é" * 33, "z\0", "z"]
    fixed = _fixed(pa.array(keys))
    assert len(set(fixed.tolist())) == len(keys) and fixed[1] == b"a" and fixed[4][0] == 255
    rows = [f"k{rng.randrange(4000):05d}" for _ in range(6000)] + ["k01000"] * 3000
    rng.shuffle(rows)
    drawn = [b for at in range(0, 9000, 3000) for b in _points(200)(iter([pa.RecordBatch.from_arrays([pa.array(rows[at : at + 3000])], names=["k"])]))]
    ranges = Ranges([x for b in drawn for x in b.column(0).to_pylist()], [x for b in drawn for x in b.column(1).to_pylist()], 900, 4, 700)
    of = ranges.of(_fixed(pa.array(sorted(rows))))
    assert (np.diff(of) >= 0).all() and len(ranges.bounds) >= 7
    load = np.bincount(of, minlength=len(ranges.blocks))
    assert (load / ranges.blocks < 1300).all() and ranges.blocks[ranges.of(_fixed(pa.array(["k01000"])))[0]] >= 4
    (dealt,) = ranges.deal(False)(iter([pa.RecordBatch.from_arrays([pa.array(rows)], names=["k"])]))
    assert np.bincount(dealt["home"].to_numpy()).max() < 1300
    (held,) = ranges.deal(True)(iter([pa.RecordBatch.from_arrays([pa.array(["k01000", "k03999"])], names=["k"])]))
    assert len(held) == sum(ranges.blocks[ranges.of(_fixed(pa.array(["k01000", "k03999"])))])
    assert Ranges([], [], 10, 3, 10).count == 1


def test_rings_across_blocks(spark):
    # rings of three blocks joined by chains, dead ends, a loop, and a way from one ring to another
    n, rng = 300, random.Random(11)
    ways = {i: [] for i in range(n)}
    for start, size in ((0, 40), (100, 90), (200, 7)):
        ring = rng.sample(range(start, start + 95), size)
        for x, y in zip(ring, ring[1:] + ring[:1]):
            ways[x].append(y)
    for _ in range(120):
        x, y = sorted(rng.sample(range(n), 2), reverse=True)
        ways[x].append(y)
    ways[299].append(299)

    def back(i):
        seen, front = set(), [i]
        while front:
            for y in ways[front.pop()]:
                if y not in seen:
                    seen.add(y)
                    front.append(y)
        return i in seen

    most = max(map(len, ways.values()))
    rows = [("g", i, f"t{i}", [f"t{y}" for y in w] + [None] * (most - len(w))) for i, w in ways.items()]
    df = spark.createDataFrame(rows, "g string, id long, name string, links array<string>")
    want = {i for i in ways if back(i)}
    for width, least in ((10, 0), (37, 20), (1000, 10)):
        got = ring_members(df, "g", "id", "name", [df["links"][k] for k in range(most)], width=width, block_edges=least)
        assert {r["id"] for r in got.collect()} == want
