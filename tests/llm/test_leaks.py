import random
import re

import numpy as np

from seqweave.llm import leaks
from seqweave.llm.leaks import leaked_items, words

ARGS = dict(doc_id="k", text="text", item_id="k", item_text="text")
SCHEMA = "k long, text string, longest int"


def test_words():
    assert words("Ab-c_d 1,5\nÄß x\x01y") == ["ab", "c", "d", "1", "5", "äß", "x", "y"]
    # marks, joiners and connectors only separate
    assert words("a\u0301b c\u200dd e\u203ff soft\u00adhyphen") == ["a", "b", "c", "d", "e", "f", "soft", "hyphen"]


def test_runs_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(3, 40)))) for i in range(12)]
    items += [(12, items[0][1]), (13, None), (14, "")]
    docs = []
    for i in range(60):
        src = words(rng.choice(items[:12])[1])
        a = rng.randrange(len(src))
        piece = src[a : a + rng.randrange(1, 20)]
        docs.append((i, " ".join(rng.choices(vocab, k=rng.randrange(8))) + ("-" if i % 2 else " ") + rng.choice([" ", ", ", "**\n"]).join(w.upper() for w in piece) + "! " + " ".join(rng.choices(vocab, k=5))))
    docs += [(60, None), (61, ""), (62, docs[0][1]), (63, "zz " * 5000 + docs[1][1])]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def longest(a, b):
        return max((n for n in range(1, min(len(a), len(b)) + 1) for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1))), default=0)

    want = {(d, i): longest(split(t), split(u)) for d, t in docs for i, u in items}
    d = spark.createDataFrame([(*r, 1) for r in docs], SCHEMA).repartition(3)
    e = spark.createDataFrame([(*r, 1) for r in items], SCHEMA)
    for chars in (100, 10**6):
        got = leaked_items(d, e, min_match=6, block_chars=chars, **ARGS).collect()
        assert {(r["doc_id"], r["item_id"]): r["longest"] for r in got} == {k: v for k, v in want.items() if v >= 6}
        assert all(r["longest"] <= r["tiled_words"] <= r["item_words"] for r in got)
    assert leaked_items(d.limit(0), e, **ARGS).count() == 0
    assert leaked_items(d, e.limit(0), **ARGS).count() == 0


def test_reordered_passages_are_tiled(spark):
    item = [f"x{i}" for i in range(40)]
    text = " ".join(item[20:40] + ["other"] + item[0:20])
    d, e = spark.createDataFrame([(1, text, 0)], SCHEMA), spark.createDataFrame([(7, " ".join(item), 0)], SCHEMA)
    row = leaked_items(d, e, min_match=5, min_coverage=0.9, **ARGS).collect()[0]
    assert (row["tiled_words"], row["n_tiles"], row["longest"], row["coverage"]) == (40, 2, 20, 1.0)


def test_shares_of_seeds(monkeypatch):
    monkeypatch.setattr(leaks, "_HITS", 10)
    where, n = np.array([1, 2, 7, 8, 20, 30, 31]), np.array([3, 3, 4, 20, 1, 2, 2])
    # documents end at 5, 15, 25; the second is beyond the limit by itself
    assert leaks._shares(where, n, np.array([5, 15, 25])) == [(0, 2), (2, 4), (4, 7)]
    assert leaks._shares(where[:0], n[:0], np.array([5])) == [] and leaks._shares(where, n, np.array([], dtype=int)) == [(0, 7)]
