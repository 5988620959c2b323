"""Long exact spans shared between records.

Records are kept in chunks. The smallest hash of the k-mers in a window names the
shard of that window, so equal windows meet in one shard whatever records hold
them. A chunk has each distinct stretch of windows of one shard once; the chunks of a
task send what they have for a task's worth of shards together. A shard
builds a compressed FM-index over the stretches whose anchor several records
have, streams them through it by backward search and answers the chunk with the
windows that different records hold; the chunk turns these into maximal spans.
A stretch common to a third of all records reaches its shard once per chunk; shards
that hold much more than others, measured first, are cut anew by longer k-mers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.llm.fmindex import FMIndex
from seqweave.session import written

_B = 0x9E3779B97F4A7C15
_MOST = 40  # windows of a stretch, at most
_CODEC = "zstd"


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).view(np.uint8), codec=_CODEC, asbytes=True)


def _unzip(b: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, size * np.dtype(kind).itemsize, codec=_CODEC), dtype=kind) if size else np.zeros(0, dtype=kind)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _grow(h: np.ndarray, have: int, g: np.ndarray, more: int) -> np.ndarray:
    """Hashes of have + more symbols from those of ``have`` and of ``more``."""
    n = len(g) - have
    out = h[:n] * np.uint64(pow(_B, more, 1 << 64))
    out += g[have : have + n]
    return out


def _hashes(x: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes modulo 2^64 of all k-mers and of all windows."""

    def to(n: int, known: dict[int, np.ndarray]) -> np.ndarray:
        if n not in known:
            a = n // 2
            known[n] = _grow(to(n - a, known), n - a, to(a, known), a)
        return known[n]

    base = {1: x.astype(np.uint64) + np.uint64(1)}
    small = to(k, base)
    return small, to(span, {1: base[1], k: small})


def _smallest(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    return v


def _spread(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Symbols shifted by one, with a 0 after each record."""
    out = np.zeros(len(flat) + len(lens), dtype=flat.dtype if flat.dtype.itemsize > 1 else np.uint8)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = flat + np.array(1, dtype=flat.dtype)
    return out


class _Homes:
    """Which group of shards a window belongs to: equal ranges of its anchor's hash. The
    windows of ``hot`` groups are dealt to ``extra`` further groups by a second, longer anchor."""

    def __init__(self, k: int, span: int, groups: int, hot: np.ndarray | None = None, extra: int = 0) -> None:
        self.k, self.span, self.groups, self.extra = k, span, groups, extra
        self.hot = np.zeros(0, dtype=np.int64) if hot is None else np.sort(hot)

    @staticmethod
    def _range(lead: np.ndarray, n: int) -> np.ndarray:
        return ((lead >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)

    def of(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows: hash, anchor's hash and group."""
        small, wide = _hashes(text, self.k, self.span)
        lead = _mixed(_smallest(_mixed(small), self.span - self.k + 1) * np.uint64(5) + np.uint64(7))
        home = self._range(lead, self.groups)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, home), len(self.hot) - 1)
            again = self.hot[at] == home
            if again.any():
                k2 = (self.k + self.span) // 2
                second = _smallest(_mixed(_hashes(text, k2, self.span)[0] + np.uint64(_B)), self.span - k2 + 1)
                lead = np.where(again, _mixed(lead * np.uint64(11) + second), lead)
                home = np.where(again, self.groups + self._range(lead, self.extra), home)
        return wide, lead, home


class _Stretches:
    """The stretches of a chunk: runs of windows with one anchor, at most _MOST
    windows each; ``rep`` are the distinct ones in order of group."""

    def __init__(self, text: np.ndarray, lens: np.ndarray, rec: np.ndarray, homes: _Homes) -> None:
        none, span = np.zeros(0, dtype=np.int64), homes.span
        self.text, self.start, self.windows, self.rep, self.inverse, self.group = text, none, none, none, none, none
        if len(text) < span:
            return
        wide, lead, home = homes.of(text)
        n = len(text) - span + 1
        ends = np.cumsum(lens + 1) - 1
        owner = np.zeros(n + 1, dtype=np.int32)
        np.add.at(owner, np.minimum(ends[ends < n] + 1, n), 1)
        owner = np.cumsum(owner[:n], dtype=np.int32)
        whole = np.arange(n) + span <= ends[owner]
        cut = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])]))
        size = np.diff(np.append(cut, n))
        keep = whole[cut]
        cut, size = cut[keep], size[keep]
        pieces = -(-size // _MOST)
        if len(pieces) and pieces.max() > 1:  # long runs of one anchor, as in repeats
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut, size = np.repeat(cut, pieces) + nth * _MOST, np.minimum(_MOST, np.repeat(size, pieces) - nth * _MOST)
        self.start, self.windows = cut, size
        if not len(cut):
            return
        self.rec = rec[owner[cut]]
        first, last = wide[cut], wide[cut + size - 1]
        key = _mixed(first * np.uint64(3) + _mixed(last) + size.astype(np.uint64))
        _, rep, inverse = np.unique(key, return_index=True, return_inverse=True)
        # equal keys are verified by the windows' hashes and text; what differs stands for itself
        r = rep[inverse]
        same = (first[r] == first) & (last[r] == last) & (size[r] == size)
        copies = np.flatnonzero(same & (r != np.arange(len(r))))
        reach = size[copies] + span - 1
        for j in range(int(reach.max(initial=0))):
            at = np.minimum(j, reach - 1)
            same[copies] &= text[cut[copies] + at] == text[cut[r[copies]] + at]
        odd = np.flatnonzero(~same)
        if len(odd):
            inverse[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        group = home[cut[rep]]
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.rep, self.group, self.inverse = rep[order], group[order], place[inverse]
        self.lead = (lead[cut[self.rep]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low, high = np.full(len(rep), np.iinfo(np.int64).max), np.full(len(rep), np.iinfo(np.int64).min)
        np.minimum.at(low, self.inverse, self.rec)
        np.maximum.at(high, self.inverse, self.rec)
        self.several = low != high
        self.low = low

    def parts(self) -> list[tuple[int, int, int]]:
        """(group, from, to) of the distinct stretches."""
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(self.group) != 0])) if len(self.rep) else []
        return [(int(self.group[x]), int(x), int(y)) for x, y in zip(cuts, [*cuts[1:], len(self.rep)])]


def _gather(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return text[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)]


def _distinct(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct stretches, in the given order, and which of them each one is. Equal
    hashes are verified letter by letter."""
    powers = np.cumprod(np.full(int(length.max()), _B, dtype=np.uint64))
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    key = np.add.reduceat((_gather(text, begin, length).astype(np.uint64) + np.uint64(1)) * powers[at], first)
    _, rep, inverse = np.unique(_mixed(key + length.astype(np.uint64)), return_index=True, return_inverse=True)
    r = rep[inverse]
    same = length[r] == length
    copies = np.flatnonzero(same & (r != np.arange(len(r))))
    for j in range(int(length[copies].max(initial=0))):
        k = np.minimum(j, length[copies] - 1)
        same[copies] &= text[begin[copies] + k] == text[begin[r[copies]] + k]
    odd = np.flatnonzero(~same)
    inverse[odd] = len(rep) + np.arange(len(odd))
    rep = np.concatenate([rep, odd])
    order = np.argsort(rep, kind="stable")  # the order given, which is by length
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return rep[order], place[inverse]


def _chunk_of(t: pa.Table, i: int, homes: _Homes) -> _Stretches:
    lens = np.array(t["lens"][i].values)
    kind = np.uint32 if t["wide"][i].as_py() else np.uint8
    flat = _unzip(t["body"][i].as_py(), int(lens.sum()), kind)
    return _Stretches(_spread(flat, lens), lens, np.array(t["recs"][i].values), homes)


def _chunks(chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal count
            texts = [x for b in held for x in b.column(3).to_pylist()]
            joined = "".join(texts)
            wide = not joined.isascii()
            flat = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32) if wide else np.frombuffer(joined.encode(), dtype=np.uint8)
            cols = [pa.concat_arrays([b.column(j) for b in held]) for j in range(3)]
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), a)
            lens = pa.array([len(x) for x in texts], type=pa.int64())
            count += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{count}"]), one(cols[0]), one(cols[1]), one(cols[2]), one(lens), pa.array([wide]), pa.array([len(joined)], type=pa.int64()), pa.array([_zip(flat)], type=pa.binary())], names=["chunk", "srcs", "ids", "recs", "lens", "wide", "chars", "body"])

        for b in batches:
            chars = np.array(b.column(4))
            begin = 0
            while begin < b.num_rows:
                room = chunk_chars - size
                fits = max(1 if not held else 0, int(np.searchsorted(np.cumsum(chars[begin:]), room, "right")))
                if fits:
                    held.append(b.slice(begin, fits))
                    size += int(chars[begin : begin + fits].sum())
                    begin += fits
                if begin < b.num_rows or size >= chunk_chars:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return run


_SENT = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("wide", T.BooleanType()), T.StructField("chunks", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("body", T.BinaryType()), T.StructField("rest", T.BinaryType())])


def _weigh(homes: _Homes):
    """``home, symbols``: how much each chunk has for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for i in range(len(t)):
                s = _chunk_of(t, i, homes)
                size = np.cumsum(np.append(0, s.windows[s.rep] + homes.span - 1))
                parts = s.parts()
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in parts], type=pa.int32()), pa.array([int(size[y] - size[x]) for _, x, y in parts], type=pa.int64())], names=["home", "symbols"])

    return run


def _send(homes: _Homes, most: int):
    """What the chunks of a task have for each group, in one row; after every ``most`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = homes.span
        held: dict[int, list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in _SENT.names}
            for g, pieces in sorted(held.items()):
                cols = list(zip(*pieces))
                text, low, lead, flags = (np.concatenate(c) for c in cols[3:])
                rest = np.concatenate([low.view(np.uint8), lead.view(np.uint8), flags])
                for c, v in zip(out, (g, len(low), text.dtype.itemsize > 1, cols[0], cols[1], cols[2], _zip(text), _zip(rest))):
                    out[c].append(v)
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(out.values(), kinds)], names=list(out))

        for b in batches:
            t = pa.Table.from_batches([b])
            for i in range(len(t)):
                s, name = _chunk_of(t, i, homes), t["chunk"][i].as_py()
                length = s.windows[s.rep] + span - 1
                for g, x, y in s.parts():
                    flags = (length[x:y] - span).astype(np.uint8) | (s.several[x:y].astype(np.uint8) << 7)
                    held.setdefault(g, []).append((name, x, y - x, _gather(s.text, s.start[s.rep[x:y]], length[x:y]), s.low[x:y], s.lead[x:y], flags))
                size += int(length.sum())
                if size >= most:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    return run


def _solve(text: np.ndarray, begin: np.ndarray, length: np.ndarray, rec: np.ndarray, several: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches, longest first: which of them have windows that different records hold, and
    the first and last of each run of these."""
    # copies sent by several chunks stand in the index once
    rep, inverse = _distinct(text, begin, length)
    low, high = np.full(len(rep), np.iinfo(np.int64).max), np.full(len(rep), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, rec)
    np.maximum.at(high, inverse, rec)
    more = low != high
    np.logical_or.at(more, inverse, several)
    size = length[rep]
    symbols, dense = np.unique(_gather(text, begin[rep], size), return_inverse=True)
    sigma = len(symbols) + 1
    index = FMIndex(_spread(dense.astype(np.uint8 if sigma < 256 else np.uint32), size), sigma, span)
    # which blocks of equal windows different records hold
    owner = np.repeat(np.arange(len(size)), size + 1)[index.order]
    starts = index.starts[:-1]
    shared = np.minimum.reduceat(low[owner], starts) != np.maximum.reduceat(low[owner], starts)
    shared |= np.logical_or.reduceat(more[owner], starts)
    found = np.zeros((len(size), _MOST + 2), dtype=bool)
    start = np.cumsum(size + 1) - size - 1
    for docs, window, block in index.block_matches(start, size):
        found[docs, window + 1] = shared[block]
    found = found[inverse]
    doc, at = np.nonzero(found[:, 1:] != found[:, :-1])
    return doc[::2], at[::2], at[1::2] - 1


def _answer(span: int, shard_chars: int):
    def run(t: pa.Table) -> pa.Table:
        rec, lead, length, several, texts, origin, place, names = [], [], [], [], [], [], [], []
        for i in range(len(t)):
            n = t["n"][i].as_py()
            rest = _unzip(t["rest"][i].as_py(), 13 * n, np.uint8)
            rec.append(rest[: 8 * n].view(np.int64))
            lead.append(rest[8 * n : 12 * n].copy().view(np.uint32))
            flags = rest[12 * n :]
            length.append((flags & 127).astype(np.int64) + span)
            several.append(flags >= 128)
            texts.append(_unzip(t["body"][i].as_py(), int(length[-1].sum()), np.uint32 if t["wide"][i].as_py() else np.uint8))
            starts, counts = np.array(t["starts"][i].values), np.array(t["counts"][i].values)
            origin.append(np.repeat(len(names) + np.arange(len(counts)), counts))
            place.append(np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(n))
            names += t["chunks"][i].as_py()
        rec, lead, length, several, text, origin, place = map(np.concatenate, (rec, lead, length, several, texts, origin, place))
        # anchors that only one record has cannot lie in a shared window
        order = np.argsort(lead, kind="stable")
        group = np.flatnonzero(np.concatenate([[True], lead[order][1:] != lead[order][:-1]]))
        many = (np.minimum.reduceat(rec[order], group) != np.maximum.reduceat(rec[order], group)) | np.logical_or.reduceat(several[order], group)
        kept = order[np.repeat(many, np.diff(np.append(group, len(order))))]
        begin = np.cumsum(length) - length
        # a group's shards: the same anchor is in the same one
        shards = max(1, -(-int(length[kept].sum()) // shard_chars))
        of = lead[kept] % np.uint32(shards)
        found = [np.zeros((4, 0), dtype=np.int64)]
        for k in range(shards):
            mine = kept[of == k] if shards > 1 else kept
            if len(mine):
                mine = mine[np.argsort(-length[mine], kind="stable")]  # longest first
                doc, a, e = _solve(text, begin[mine], length[mine], rec[mine], several[mine], span)
                found.append(np.stack([origin[mine][doc], place[mine][doc], a, e]))
        runs = np.concatenate(found, axis=1)
        runs = runs[:, np.argsort(runs[0], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(runs[0]) != 0])) if runs.shape[1] else []
        out: dict[str, list] = {"chunk": [], "n": [], "runs": []}
        for x, y in zip(cuts, [*cuts[1:], runs.shape[1]]):
            for c, v in zip(out.values(), (names[runs[0, x]], int(y - x), _zip(runs[1:, x:y].astype(np.int32)))):
                c.append(v)
        return pa.table({"chunk": pa.array(out["chunk"], type=pa.string()), "n": pa.array(out["n"], type=pa.int32()), "runs": pa.array(out["runs"], type=pa.binary())})

    return run


def _resolve(homes: _Homes):
    names = ["src", "id", "span_start", "span_end"]
    empty = pa.table({"src": pa.array([], type=pa.string()), "id": pa.array([], type=pa.string()), "span_start": pa.array([], type=pa.int64()), "span_end": pa.array([], type=pa.int64())})

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(chunks) or not len(answers):
            return empty
        s = _chunk_of(chunks, 0, homes)
        runs = [_unzip(answers["runs"][i].as_py(), 3 * answers["n"][i].as_py(), np.int32).reshape(3, -1) for i in range(len(answers))]
        which, a, e = np.concatenate(runs, axis=1)
        # every stretch with the same text as the one answered for
        by = np.argsort(s.inverse, kind="stable")
        sorted_ = s.inverse[by]
        lo, hi = np.searchsorted(sorted_, which, "left"), np.searchsorted(sorted_, which, "right")
        n = hi - lo
        each = by[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        begin, stop = s.start[each] + np.repeat(a, n), s.start[each] + np.repeat(e, n) + homes.span
        cover = np.zeros(len(s.text) + 1, dtype=np.int32)
        np.add.at(cover, begin, 1)
        np.add.at(cover, stop, -1)
        on = np.concatenate([[False], np.cumsum(cover) > 0, [False]])
        edge = np.flatnonzero(on[1:] != on[:-1])
        begin, stop = edge[::2], edge[1::2]
        lens = np.array(chunks["lens"][0].values)
        base = np.cumsum(lens + 1) - lens - 1
        of = np.searchsorted(base, begin, "right") - 1
        cols = [chunks["srcs"][0].values.take(pa.array(of)), chunks["ids"][0].values.take(pa.array(of)), pa.array(begin - base[of] + 1), pa.array(stop - base[of])]
        return pa.table(cols, names=names)

    return run


def shared_spans(records: DataFrame, src: str, record_id: str, sequence: str, *, span: int = 40, anchor: int = 10, chunk_chars: int = 1_500_000, group_chars: int = 4_000_000, shard_chars: int = 4_000_000, send_chars: int = 64_000_000, hot: float = 4.0) -> DataFrame:
    """``src, id, span_start, span_end``: the maximal runs of symbols that lie in a
    window of ``span`` symbols which a different record holds too; positions from 1,
    both ends included.

    A record is a distinct (``src``, ``record_id``). Defined cases: null ids or
    sequences are left out; sequences shorter than ``span`` share nothing; a
    repeat inside one record does not count, nor does a repeated row of the same
    record (its rows are taken to hold the same sequence); sequences are compared
    symbol by symbol, in any alphabet and of any length; an empty table gives no
    row; further columns are not read. Records are told apart by 64-bit hashes of
    their names. The table is written in chunks of about ``chunk_chars`` symbols; the number of
    groups of shards, each a task's work, follows its size by ``group_chars``. Groups of more than
    ``hot`` times the mean are cut anew, so at most a share 1 / ``hot`` of all groups is named to the
    tasks. ``shard_chars`` bounds an index and ``send_chars`` what waits to be sent; none of these
    changes the result.
    """
    src_rows = records.select(records[src].cast("string").alias("src"), records[record_id].cast("string").alias("id"), records[sequence].alias("seq")).filter("src IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL")
    rows = src_rows.select("src", "id", F.xxhash64("src", "id").alias("rec"), "seq", F.length("seq").alias("chars"))
    text = T.ArrayType(T.StringType())
    shape = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("srcs", text), T.StructField("ids", text), T.StructField("recs", T.ArrayType(T.LongType())), T.StructField("lens", T.ArrayType(T.LongType())), T.StructField("wide", T.BooleanType()), T.StructField("chars", T.LongType()), T.StructField("body", T.BinaryType())])
    chunks = written(rows.mapInArrow(_chunks(chunk_chars), shape), "chunks")
    total = chunks.agg(F.sum("chars")).first()[0] or 0
    shuffles = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(shuffles, -(-total // group_chars))
    homes = _Homes(anchor, span, groups)
    slim = chunks.select("chunk", "recs", "lens", "wide", "body")
    held = slim.mapInArrow(_weigh(homes), "home int, symbols long").groupBy("home").agg(F.sum("symbols").alias("symbols"))
    mean = (total * (1 + span / 8)) / groups
    large = held.filter(F.col("symbols") > hot * max(mean, group_chars)).collect()
    if large:
        homes = _Homes(anchor, span, groups, np.array([r["home"] for r in large], dtype=np.int64), sum(-(-r["symbols"] // group_chars) for r in large))
    every = groups + homes.extra  # a group is a partition
    sent = slim.mapInArrow(_send(homes, send_chars), _SENT)
    answers = sent.repartitionById(every, "home").groupBy("home").applyInArrow(_answer(span, shard_chars), "chunk string, n int, runs binary")
    # some chunks to a task, however few partitions the session has
    tasks = max(shuffles, -(-total // (4 * chunk_chars)))
    by_chunk = lambda df: df.repartition(tasks, "chunk").groupBy("chunk")
    found = by_chunk(chunks).cogroup(by_chunk(answers)).applyInArrow(_resolve(homes), "src string, id string, span_start long, span_end long")
    return found.distinct()
