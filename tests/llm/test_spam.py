import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqweave.llm import spam
from seqweave.llm.spam import form, incoherent_documents


def test_forms():
    same = lambda *t: len({form(x) for x in t}) == 1
    assert same("Kit", "kit.", "(KIT)", "<b>kit</b>") and not same("kit", "kits")
    assert same("http://a.b/c", 'href="www.x.y">K2', "[x](https://q)") and same("#a", "#B_2")
    assert same("12", "3.5,", "-7") and same("AB12", "x-9") and same("-", "|", "»")


def test_stretches_stay_inside_their_document():
    at = spam._Places(np.array([3, 0, 30, 1]), 4)
    v = np.arange(34, dtype=float)
    got = at.mean(v)
    assert np.allclose(got[:3], 1.0) and got[33] == 33 and np.allclose(got[3:7], v[3:12].mean()) and np.isclose(got[20], 20)


def corpus(rng):
    noun = [f"{a}{b}" for a in ("gor", "tel", "mip", "vus", "lan") for b in ("ase", "in", "ol", "ate")]
    lines = ["the half life of {} was {} hours at {} degrees .", "no signal was seen for {} when {} was left out .", "members of the {} family share a motif of about {} residues .", "how {} takes part in {} remains open ."]
    line = lambda: rng.choice(lines).format(*(rng.choice(noun) if rng.random() < 0.6 else str(rng.randrange(99)) for _ in range(3)))
    prose = lambda n: " ".join(line() for _ in range(n))
    ware = ["serum", "cell line", "assay kit", "lysis buffer", "plasmid", "primer set", "antibody"]
    push = ["buy", "cheap", "order", "best", "online", "sale"]
    salad = lambda n: " ".join(rng.choice([rng.choice(ware), rng.choice(push), "Q12"]) for _ in range(n))
    listed = lambda n: ", ".join(f"R{rng.randrange(99)} {rng.choice(ware)} {rng.choice(push)}" for _ in range(n))
    links = lambda n: " ".join(f"http://a{rng.randrange(999)}.test/x" for _ in range(n))
    tags = lambda n: " ".join(f"#{rng.choice(noun)}" for _ in range(n))
    docs, bad = [], set()
    for i in range(900):
        kind = i % 18
        if kind == 0:
            text = rng.choice([salad, links, tags])(60)
        elif kind == 1:
            text = prose(1) + " " + rng.choice([listed, salad, links])(50)
        elif kind == 2:
            text = prose(12) + "\nKeywords: " + salad(8)
        elif kind == 3:
            text = prose(10) + " see http://a.test/b for more . " + prose(4)
        else:
            text = prose(rng.randrange(2, 15))
        if kind < 2:
            bad.add(i)
        docs.append((i, text, 0))
    return docs, bad


def test_marked_documents(spark):
    docs, bad = corpus(random.Random(8))
    docs += [(900, None, 0), (901, "", 0), (902, "  \n", 0), (903, "x", 0), (904, docs[0][1], 0), (905, "the half life of vusin was 3 hours at 4 degrees . " * 4000, 0)]
    df = spark.createDataFrame(docs, "k long, text string, n_words int").repartition(5)
    got = {r["doc_id"]: r for r in incoherent_documents(df, "k", "text").collect()}
    assert set(got) == {d[0] for d in docs} - {900}
    assert all(got[i]["n_words"] == len(t.split()) for i, t, _ in docs if t is not None)
    found = {i for i, r in got.items() if r["n_spam_words"] * 2 > r["n_words"]}
    bad |= {904}
    assert len(found & bad) >= 0.95 * len(bad) and len(found - bad) <= 0.05 * len(bad)
    assert got[901]["spam_share"] == 0 and (got[0]["n_spam_words"] == got[904]["n_spam_words"])
    assert incoherent_documents(df.limit(0), "k", "text").count() == 0


def test_results_do_not_depend_on_the_buckets(spark):
    docs, _ = corpus(random.Random(9))
    df = spark.createDataFrame(docs, "k long, text string, n_words int").repartition(5)
    few, many = ({tuple(r) for r in incoherent_documents(df, "k", "text", bucket_keys=b).collect()} for b in (1 << 12, 1 << 23))
    assert few == many and len(few) == len(docs)


def test_counts_are_exact():
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(spam._WORD, 1 << 63, 40).astype(np.uint64))
    f, lens = words[rng.integers(0, 40, 3000)], np.array([5, 0, 1, 2000, 994])
    vocab, codes = np.unique(f, return_inverse=True)
    row = {"chunk": 7, "lens": lens.tolist(), "forms": len(vocab), "vocab": spam._pack(vocab), "codes": spam._pack(codes.astype(np.uint32))}
    batch = pa.RecordBatch.from_pylist([row, row | {"chunk": 8}])
    asked = pa.Table.from_batches(spam._asking(3)([batch]))
    found = pa.concat_tables([spam._look_up(asked.filter(pc.equal(asked["bucket"], k))) for k in range(3)])
    c = spam._Chunk(vocab, codes, lens)
    got = dict(zip(c.asked()[0].tolist(), spam._answered(found.filter(pc.equal(found["chunk"], 7)), np.int64).tolist()))
    near = c.live(1)
    assert len(near) == 3000 - sum(n > 0 for n in lens)
    want = Counter(f.tolist()) + Counter(c.pairs(near, 1).tolist())
    assert all(n == 2 * want[k] for k, n in got.items()) and set(want) <= set(got)
