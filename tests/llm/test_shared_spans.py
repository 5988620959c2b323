import random
from collections import defaultdict

import numpy as np
import pytest

from seqweave.llm.fmindex import FMIndex
from seqweave.llm.shared_spans import shared_spans


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrst", "aé漢🙂"])
def test_backward_search_counts(letters):
    rng = np.random.default_rng(1)
    docs = [rng.integers(1, len(letters) + 1, n) for n in (30, 9, 50, 14)]
    text = np.concatenate([np.append(d, 0) for d in docs])
    index = FMIndex(text, len(letters) + 1, 9)
    for d in docs:
        for length in range(1, 10):
            p = d[-length:]
            lo, hi = np.array([0]), np.array([len(text)])
            for c in p[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            want = sum(np.array_equal(text[i : i + length], p) for i in range(len(text)))
            assert hi[0] - lo[0] == want


def brute(rows, span):
    seqs = {(s, i): q for s, i, q in rows if s is not None and i is not None and q is not None}
    where = defaultdict(set)
    for r, q in seqs.items():
        for k in range(len(q) - span + 1):
            where[q[k : k + span]].add(r)
    out = set()
    for r, q in seqs.items():
        on = np.zeros(len(q) + 2, dtype=bool)
        for k in range(len(q) - span + 1):
            if len(where[q[k : k + span]]) > 1:
                on[k + 1 : k + span + 1] = True
        edge = np.flatnonzero(on[1:] != on[:-1])
        out |= {(*r, int(a) + 1, int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return out


@pytest.mark.parametrize("letters", ["AC", "ACDEFGHIKLMNPQRSTVWY", "aé漢🙂 "])
def test_spans_against_brute_force(spark, letters):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choices(letters, k=n))
    domain, rows = word(30), []
    for i in range(120):
        parts = [word(rng.randrange(25))]
        if rng.random() < 0.4:
            parts.append(domain[rng.randrange(5) : rng.randrange(20, 31)])
        if rng.random() < 0.2 and rows:
            parts.append((rng.choice(rows)[2] or "")[:60])
        if rng.random() < 0.1:
            parts.append(letters[0] * rng.randrange(150))
        rows.append((rng.choice(["p", "u"]), f"r{i}", "".join(parts)))
    own = word(25)
    rows += [("p", "self", own + word(9) + own), ("p", "none", None), (None, "x", "A" * 40), ("p", None, "A" * 40), ("p", "empty", ""), ("u", "same", word(200) + domain)]
    rows += rows[:30] + [("u", f"copy{i}", rows[3][2]) for i in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "src string, id string, seq string, rec int").repartition(5)
    small = {"chunk_chars": 300, "group_chars": 200, "shard_chars": 150, "send_chars": 900}
    for sizes in (small | {"hot": 1e-9}, small | {"hot": 1.5}, small, {}):
        got = shared_spans(df, "src", "id", "seq", span=14, anchor=4, **sizes).collect()
        assert {tuple(r) for r in got} == brute(rows, 14) and len(got) == len({tuple(r) for r in got})
    assert shared_spans(df.limit(0), "src", "id", "seq").count() == 0
