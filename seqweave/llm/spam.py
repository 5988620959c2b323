"""Keyword-stuffed pages and link lists, by the pointwise mutual information of words.

In prose a word goes with the next one, not with those after it. Word salad and
repeated collocations show in the words beyond: pairs two and three words apart
that stand next to each other elsewhere in the corpus, in whatever order. The
mean PMI of these pairs, normalised and cut at 0, is near nothing in prose, and
stays there however large the corpus is. Stretches above a threshold are the seeds.
A word's own PMI with the matter marked so far against that with the rest, learned
over all documents in a fixed number of passes, then marks the phrase lists, links
and tags made of the same words, and clears prose that happens to repeat itself.
Counts are exact: each chunk of documents sends the keys it has and those it asks
for to buckets of their hash, which add up and answer. Nothing is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.session import delete_path, new_path

# classes of forms; words are numbered by their hash from _WORD on
_NONE, _PUNCT, _NUMBER, _MARK, _CODE, _LINK, _TAG, _WORD = range(8)
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_MARKUP = regex.compile(r"<[^>]*>?")
_LINKED = regex.compile(r"https?:|www\.|href=", regex.I)


def form(token: str) -> int:
    """The number of a token's form: links, tags, markup, numbers and codes are
    classes, other tokens the 64-bit hash of their lower-case word without outer
    punctuation."""
    if _LINKED.search(token):
        return _LINK
    if token[0] == "#" and len(token) > 1 and token[1].isalnum():
        return _TAG
    word = _MARKUP.sub("", token) if "<" in token else token
    word = _EDGE.sub("", word).lower()
    if not word:
        return _MARK if "<" in token else _PUNCT
    if any(c.isdigit() for c in word):
        return _CODE if any(c.isalpha() for c in word) else _NUMBER
    return max(_WORD, int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


class _Forms(dict):
    """Forms of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        f = form(token)
        if len(token) <= 60:
            self[token] = f
        return f


_FORMS = _Forms()


def _batch(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Forms of all words of the texts, and the number of words of each."""
    split = [t.split() for t in texts]
    lens = np.array([len(s) for s in split], dtype=np.int64)
    get = _FORMS.__getitem__
    return np.fromiter((get(w) for s in split for w in s), dtype=np.uint64, count=int(lens.sum())), lens


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    return h


class _Chunk:
    """The words of some documents: ``vocab``, the forms they have in order, and ``codes``,
    the place in it of each word."""

    def __init__(self, vocab: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> None:
        self.vocab, self.codes, self.lens = vocab, codes, lens
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.worded = (vocab >= _CODE)[codes]  # numbers, punctuation and markup have no wording
        self.telling = ((vocab >= _LINK) | (vocab == _MARK))[codes]

    def live(self, d: int) -> np.ndarray:
        """Places of words with one ``d`` further on in the same document, both worded."""
        return np.flatnonzero((self.doc[:-d] == self.doc[d:]) & self.worded[:-d] & self.worded[d:]) if d < len(self.codes) else np.zeros(0, dtype=np.int64)

    def pairs(self, at: np.ndarray, d: int) -> np.ndarray:
        """64-bit keys of the words at these places and those ``d`` further on."""
        left, right = _mixed(self.vocab * np.uint64(0x9E3779B97F4A7C15)), _mixed(self.vocab + np.uint64(0x632BE59BD9B4E019))
        return _mixed(left[self.codes[at]] * np.uint64(3) + right[self.codes[at + d]])

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys whose counts the chunk needs, in order, and how often it has each: forms and
        pairs of neighbours; of pairs further apart it has none."""
        near, times = np.unique(self.pairs(self.live(1), 1), return_counts=True)
        keys = np.unique(np.concatenate([self.vocab, near, *(self.pairs(self.live(d), d) for d in range(2, _REACH + 1))]))
        own = np.zeros(len(keys), dtype=np.int64)
        own[np.searchsorted(keys, near)] = times
        own[np.searchsorted(keys, self.vocab)] = np.bincount(self.codes, minlength=len(self.vocab))
        return keys, own


class _Places:
    """The stretch of words around each word of a chunk."""

    def __init__(self, lens: np.ndarray, half: int) -> None:
        ends = np.cumsum(lens)
        first, last, n = np.repeat(ends - lens, lens), np.repeat(ends, lens), int(lens.sum())
        # at the edges of a document the stretch is moved inwards, not cut
        self.lo = np.maximum(first, np.minimum(np.arange(n) - half, last - 2 * half - 1))
        self.hi = np.minimum(last, self.lo + 2 * half + 1)

    def sums(self, v: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(v, dtype=float)])
        return sums[self.hi] - sums[self.lo]

    def mean(self, v: np.ndarray) -> np.ndarray:
        return self.sums(v) / (self.hi - self.lo)

    def weighted(self, v: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Mean over the words that are on; 0 where none is."""
        return self.sums(v * on) / np.maximum(self.sums(on), 1)


_REACH = 3  # how far apart words are still held against each other


def _salad(c: _Chunk, at: _Places, keys: np.ndarray, counts: np.ndarray, total: int, least: float) -> np.ndarray:
    """Which words stand in a stretch where the mean positive NPMI of words two and
    three apart is above ``least``; a pair must occur twice to count as known."""
    n = len(c.codes)
    one = np.log(np.maximum(counts[np.searchsorted(keys, c.vocab)], 1))[c.codes]
    score, pairs, whole = np.zeros(n), np.zeros(n), np.log(max(total, 2))
    for d in range(2, _REACH + 1):
        i = c.live(d)
        seen = counts[np.searchsorted(keys, c.pairs(i, d))]
        known = np.log(np.maximum(seen, 1))
        npmi = (known + whole - one[i] - one[i + d]) / np.maximum(whole - known, 1e-9)
        score[i] += np.where(seen > 1, np.clip(npmi, 0, 1), 0)
        pairs[i] += 1
    return (at.sums(score) > least * at.sums(pairs)) & (at.mean(pairs) > 0.5)


def _marks(c: _Chunk, at: _Places, salad: np.ndarray, weight: np.ndarray | None, lean: float) -> np.ndarray:
    """Which words stand in incoherent matter, as far as is known yet; ``weight`` is that of
    the chunk's vocabulary."""
    if weight is None:
        return salad
    mean = at.weighted(weight[c.codes], c.telling)
    # the words of prose in any order keep their own company and are not meant
    return (at.mean(c.telling) > 0.25) & ((mean > lean) | (salad & (mean > 0)))


# ---------------------------------------------------------------- on Spark


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).view(np.uint8), codec="zstd", asbytes=True) if len(a) else b""


def _open(raw: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), dtype=kind) if n else np.zeros(0, dtype=kind)


def _unpack(row: dict) -> _Chunk:
    lens = np.array(row["lens"], dtype=np.int64)
    return _Chunk(_open(row["vocab"], row["forms"], np.uint64), _open(row["codes"], int(lens.sum()), np.uint32), lens)


_HEAD = ["chunk", "lens", "forms", "vocab", "codes"]


def _to_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 33
    for b in batches:
        texts = b.column(1).to_pylist()
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (size < 2_000_000 or stop == start):
                size += len(texts[stop])
                stop += 1
            forms, lens = _batch(texts[start:stop])
            vocab, codes = np.unique(forms, return_inverse=True)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), a)
            ids = pa.concat_arrays([b.column(0).slice(start, stop - start)])
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), one(ids), one(pa.array(lens)), pa.array([len(vocab)], type=pa.int32()), pa.array([_pack(vocab)], type=pa.binary()), pa.array([_pack(codes.astype(np.uint32))], type=pa.binary())], names=["chunk", "ids", "lens", "forms", "vocab", "codes"])
            chunk, start = chunk + 1, stop


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(named)
    return pa.table([pa.array(list(c), type=kinds[k]) for c, (_, k) in zip(cols, named)], names=[n for n, _ in named])


def _dealt(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of keys in order: buckets are equal ranges of the hashes."""
    of = ((keys >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
    return [(int(of[x]), int(x), int(y)) for x, y in zip(cuts, [*cuts[1:], len(of)])]


def _added(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Equal keys once, in order, with the sums of their counts."""
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    # sums of whole numbers, exact in doubles up to 2^53
    return every, *(np.bincount(at, weights=np.concatenate(c), minlength=len(every)).astype(np.int64) for c in counts)


def _answered(answers: pa.Table, kind: type) -> np.ndarray:
    """The buckets' answers in the order of the keys that were asked."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, dtype=kind), *(_open(r["found"], r["n"], kind) for r in rows)])


_ASKED = "bucket int, chunk long, n int, keys binary, own binary"
_FOUND = "chunk long, bucket int, n int, found binary"
_TALLY = "bucket int, chunk long, n int, keys binary, own binary, marked binary, spam long"


def _asking(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                if row["forms"]:
                    keys, own = _unpack(row).asked()
                    yield from _rows(_ASKED, [(k, row["chunk"], y - x, _pack(keys[x:y]), _pack(own[x:y])) for k, x, y in _dealt(keys, buckets)]).to_batches()

    return run


def _look_up(asked: pa.Table) -> pa.Table:
    """Of one bucket: the counts over all chunks of what every chunk asks for."""
    rows = asked.to_pylist()
    asks = [_open(r["keys"], r["n"], np.uint64) for r in rows]
    own = [_open(r["own"], r["n"], np.int64) for r in rows]
    known, n = _added([k[c > 0] for k, c in zip(asks, own)], [c[c > 0] for c in own])
    out = []
    for r, keys in zip(rows, asks):
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = np.where(known[at] == keys, n[at], 0)
        else:
            found = np.zeros(len(keys), dtype=np.int64)
        out.append((r["chunk"], r["bucket"], r["n"], _pack(found)))
    return _rows(_FOUND, out)


def _weighed(a: float, e: float):
    """Of one bucket: each form's PMI with marked matter less that with the rest, for every
    chunk that has the form."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [_open(r["keys"], r["n"], np.uint64) for r in rows]
        known, ones, spam = _added(keys, *([_open(r[c], r["n"], np.int64) for r in rows] for c in ("own", "marked")))
        # two occurrences more of each form, shared out as the corpus is
        weight = (np.log((spam + 2 * a / (a + e)) / (ones - spam + 2 * e / (a + e))) - np.log(a / e)).astype(np.float32)
        return _rows(_FOUND, [(r["chunk"], r["bucket"], r["n"], _pack(weight[np.searchsorted(known, k)])) for r, k in zip(rows, keys)])

    return run


def incoherent_documents(docs: DataFrame, doc_id: str, text: str, *, bucket_keys: int = 1 << 23, half: int = 8, least: float = 0.1, lean: float = 0.5, rounds: int = 3) -> DataFrame:
    """``doc_id, n_words, n_spam_words, spam_share`` of every document with a text:
    how many of its words (split at white space) stand in keyword salad, phrase
    lists, bare links or tags.

    A stretch is ``half`` words to either side. It is a seed if the mean positive
    normalised PMI of its words two and three apart is above ``least``; in each of
    ``rounds`` passes over all documents it is marked if its words' mean PMI with
    matter marked before, less that with the rest, is above ``lean`` (0 is enough for a
    seed). All counts are exact, words and pairs told apart by 64-bit hashes;
    ``bucket_keys`` is about how many keys a task holds at once: a larger corpus has
    more buckets, and results do not depend on it.

    Defined cases: null texts give no row; texts without words have 0 words and a
    share of 0; equal texts get equal marks, each row its own result; texts of any
    length are read whole; an empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    src = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).filter("text IS NOT NULL")
    paths = {}

    def stored(df: DataFrame, name: str) -> DataFrame:
        paths[name] = new_path(spark, name)
        df.write.parquet(paths[name])
        return spark.read.schema(df.schema).parquet(paths[name])

    field = T.StructField
    head = [field("chunk", T.LongType()), field("ids", T.ArrayType(kind)), field("lens", T.ArrayType(T.LongType())), field("forms", T.IntegerType()), field("vocab", T.BinaryType()), field("codes", T.BinaryType())]
    forms = stored(src.mapInArrow(_to_forms, T.StructType(head)), "forms")
    total = forms.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda acc, x: acc + x))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a word asks for at most itself and the pairs within reach
    pair_buckets, form_buckets = (max(shuffles, -(-n // bucket_keys)) for n in ((_REACH + 1) * total, total))
    found = forms.select(_HEAD).mapInArrow(_asking(pair_buckets), _ASKED).groupBy("bucket").applyInArrow(_look_up, _FOUND)

    def seed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.select(_HEAD).to_pylist()[0]
        bits = b""
        if row["forms"]:
            c = _unpack(row)
            bits = _pack(np.packbits(_salad(c, _Places(c.lens, half), c.asked()[0], _answered(answers, np.int64), total, least)))
        return chunk.append_column("salad", pa.array([bits], type=pa.binary()))

    seeded = stored(forms.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(seed, T.StructType([*head, field("salad", T.BinaryType())])), "salad")
    delete_path(spark, paths["forms"])

    def over(chunks: DataFrame, weights: DataFrame | None, give, schema) -> DataFrame:
        """``give`` of each chunk with its marks under the weights known so far."""

        def marked(row: dict, answers: pa.Table | None):
            c = _unpack(row)
            if not row["forms"]:
                return c, np.zeros(0, dtype=bool)
            weight = None if answers is None else _answered(answers, np.float32)
            salad = np.unpackbits(_open(row["salad"], -(-len(c.codes) // 8), np.uint8), count=len(c.codes)).astype(bool)
            return c, _marks(c, _Places(c.lens, half), salad, weight, lean)

        def plain(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                for i, row in enumerate(t.select([*_HEAD, "salad"]).to_pylist()):
                    yield from give(t.slice(i, 1), row["chunk"], *marked(row, None)).to_batches()

        def joined(chunk: pa.Table, answers: pa.Table) -> pa.Table:
            row = chunk.select([*_HEAD, "salad"]).to_pylist()[0]
            return give(chunk, row["chunk"], *marked(row, answers))

        return chunks.mapInArrow(plain, schema) if weights is None else chunks.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(joined, schema)

    def tally(_: pa.Table, chunk: int, c: _Chunk, m: np.ndarray) -> pa.Table:
        own, spam = np.bincount(c.codes, minlength=len(c.vocab)), np.bincount(c.codes[m], minlength=len(c.vocab))
        return _rows(_TALLY, [(k, chunk, y - x, _pack(c.vocab[x:y]), _pack(own[x:y]), _pack(spam[x:y]), int(spam[x:y].sum())) for k, x, y in _dealt(c.vocab, form_buckets)])

    weights = None
    slim = seeded.select(*_HEAD, "salad")
    for number in range(rounds):
        tallies = stored(over(slim, weights, tally, _TALLY), f"tally-{number}")
        spam = tallies.agg(F.sum("spam")).first()[0] or 0
        weights = tallies.groupBy("bucket").applyInArrow(_weighed(spam + 1, total - spam + 1), _FOUND)
        if number:
            delete_path(spark, paths[f"tally-{number - 1}"])

    def result(chunk: pa.Table, _: int, c: _Chunk, m: np.ndarray) -> pa.Table:
        ends = np.concatenate([[0], np.cumsum(m)])
        last = np.cumsum(c.lens)
        n = ends[last] - ends[last - c.lens]
        return pa.table([pa.concat_arrays(chunk["ids"].chunks).flatten(), pa.array(c.lens), pa.array(n.astype(np.int64)), pa.array(n / np.maximum(c.lens, 1))], names=["doc_id", "n_words", "n_spam_words", "spam_share"])

    shape = T.StructType([field("doc_id", kind), field("n_words", T.LongType()), field("n_spam_words", T.LongType()), field("spam_share", T.DoubleType())])
    return over(seeded, weights, result, shape)
