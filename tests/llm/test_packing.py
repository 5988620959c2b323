import base64
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqweave.llm.packing import TokenCounter, best_fit_decreasing, lower_bound, pack, token_counts
from seqweave.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@given(st.lists(st.integers(0, 20), max_size=9))
@settings(max_examples=80, deadline=None)
def test_bound_and_packing(sizes):
    a = np.array(sizes, dtype=np.int64)
    where = best_fit_decreasing(a, 20)
    used = int(where.max()) + 1 if len(a) else 0
    assert all(a[where == b].sum() <= 20 for b in range(used))
    best = [len(sizes)]

    def search(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= 20:
                search(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        search(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    search(0, [])
    positive = a[a > 0]
    assert lower_bound(np.bincount(positive, minlength=21), 20) <= best[0] <= max(used, best[0])


def test_counts_equal_the_tokenizer(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    from seqweave.llm.packing import PATTERN

    real = tiktoken.Encoding("real", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "It's  GO:12 kinase-like, n'est-ce pas?\n\n  \t x", "ünïcödé 漢字 🙂🙂 12345", "a" * 9000, "x y " * 4000, "line\r\n\r\n  end  "]
    counter = TokenCounter(RANKS)
    assert [counter.count(t) for t in texts * 2] == [len(real.encode_ordinary(t)) for t in texts * 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string")
    assert {r["id"]: r["n_tokens"] for r in token_counts(df, "id", "text", RANKS).collect()} == {i: len(real.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_pack_covers_every_item_once(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 100, 100, rng.randrange(101), rng.randrange(400)])) for i in range(700)] + [(None, 5), (1, 5), (3, None)]
    df = spark.createDataFrame(sizes, "id long, n_tokens long")
    out, cert = pack(df, capacity=100, part_items=100)
    rows = out.collect()
    got, fill = {}, {}
    for r in rows:
        assert r["token_start"] == r["piece"] * 100 and 0 <= r["n_tokens"] <= 100
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
        if r["id"] not in (None, 1):
            got.setdefault(r["id"], []).append((r["piece"], r["n_tokens"]))
    assert max(fill.values()) <= 100
    for i, n in sizes[:700]:
        if i != 1 and i != 3:
            assert sorted(got[i]) == [(k, min(100, n - 100 * k)) for k in range(max(1, -(-n // 100)))]
    assert sum(r["n_tokens"] for r in rows) == sum(n or 0 for _, n in sizes)
    parts = cert.collect()
    assert all(p["containers"] >= p["lower_bound"] for p in parts)
    whole = next(p for p in parts if p["round"] == 0 and p["part"] == -1)
    assert whole["lower_bound"] <= len(fill) <= whole["containers"]
    final = next(p for p in parts if p["round"] == -1)
    assert (final["items"], final["containers"], final["unused"]) == (len(rows), len(fill), 100 * len(fill) - sum(fill.values())) and final["lower_bound"] == whole["lower_bound"]
    again = pack(df.repartition(7, "n_tokens"), capacity=100, part_items=100)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert [x.count() for x in pack(df.limit(0))] == [0, 0]
