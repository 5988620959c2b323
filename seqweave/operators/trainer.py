"""Learning unit vocabularies by merging the most frequent adjacent pair.

Three trainers with the same result: ``train_units`` learns in one process, for many
configurations side by side; ``train_together`` holds a chunk of the corpus in each of as
many tasks as run at once, which tell each other what a merge changed;
``train_distributed`` keeps the corpus in chunks of the shared folder, and counts and
merges in every chunk at once.

Ties go to the pair that sorts first by (left, right). Training ends, whatever the
stop rule says, when no pair is left. A pair that spells a unit already known
keeps the unit's first entry; its merge is made all the same and is listed in
``extra``. In ``mutated`` mode a new unit of 3 to 12 letters draws in its mutations:
each live pair that spells one and occurs more often than ``min_mutation_freq`` of
the parent's count is merged at once, most similar first.
"""

from __future__ import annotations

import ctypes
import heapq
import os
import pickle
import socket
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqweave.session import written


@dataclass
class Rules:
    """How to train: ``stop_type`` is ``vocab_size`` (below that many units), ``freq_cutoff``
    (best pair above that count) or ``freq_proportion`` (above that share of the first
    best pair's count). Checked before a pair is taken, so a family may overshoot."""

    stop_type: str = "vocab_size"
    stop_parameter: float = 800
    mutated: bool = False
    matrix: dict = field(default_factory=dict)
    mutation_cutoff: float = 0.8
    min_mutation_freq: float = 0.005
    min_mutation_len: int = 3
    max_mutation_len: int = 12

    def __post_init__(self) -> None:
        if self.stop_type not in ("vocab_size", "freq_cutoff", "freq_proportion"):
            raise ValueError(f"no such stop type: {self.stop_type}")
        if self.mutated and not self.matrix:
            raise ValueError("mutated training needs a matrix")


def similar_strings(unit: str, matrix: dict, cutoff: float) -> list[tuple[str, float]]:
    """All other strings of the unit's length with at least that similarity, most similar
    first, then by name (the rules of ``substitution.mutations``)."""
    own = {a: s for (a, b), s in matrix.items() if a == b and a != "X"}
    total = sum(own.get(a, 0) for a in unit)
    if not total:
        return []
    room, found = total * (1 - cutoff), [("", 0.0)]
    for a in unit:
        if a not in own:
            step = [(a, 0.0)]
        else:
            step = [(b, own[a] - s) for (x, b), s in matrix.items() if x == a and s >= -1e-4 and (s == own[a] or own[a] - s < room - 1e-9)]
        found = [(t + b, lost + loss) for t, lost in found for b, loss in step if lost + loss <= room + 1e-9]
    return sorted(((t, 1 - lost / total) for t, lost in found if t != unit), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """The units in order, and the rules that repeat a unit's spelling."""

    def __init__(self, alphabet: list[str]) -> None:
        self.units = {a: {"frequency": 0, "order": 0} for a in alphabet}
        self.extra, self.merges = [], 0

    def add(self, left: str, right: str, count: int, **more) -> str:
        self.merges += 1
        unit = left + right
        if unit in self.units:
            self.extra.append((left, right, self.merges))
        else:
            self.units[unit] = {"frequency": int(count), "order": self.merges, "pair": (left, right), **more}
        return unit

    def rows(self, config: str) -> list[tuple]:
        return [(config, i, u, x["frequency"], x["order"], list(x["pair"]) if "pair" in x else None, x.get("parent"), x.get("similarity"), x.get("is_parent")) for i, (u, x) in enumerate(self.units.items())]


VOCAB_SCHEMA = "config_id string, token_id int, token string, frequency long, merge_order int, pair array<string>, parent string, similarity double, is_parent boolean"


def _vocab_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 9
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.bool_()]
    return pa.table([pa.array(list(c), type=k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in VOCAB_SCHEMA.split(", ")])


def _learn(vocab: Vocabulary, rules: Rules, best: Callable, merge: Callable, spelled: Callable) -> Vocabulary:
    """The loop all trainers share: ``best()`` gives the leading (left, right, count) or
    None, ``spelled(unit)`` the live pairs that spell it, ``merge(left, right)`` merges."""
    first = None
    while (top := best()) is not None:
        left, right, count = top
        first = first or count
        if rules.stop_type == "vocab_size" and len(vocab.units) >= rules.stop_parameter:
            break
        if rules.stop_type == "freq_cutoff" and count <= rules.stop_parameter:
            break
        if rules.stop_type == "freq_proportion" and count <= first * rules.stop_parameter:
            break
        unit = vocab.add(left, right, count)
        merge(left, right)
        if rules.mutated and rules.min_mutation_len <= len(unit) <= rules.max_mutation_len:
            for other, similarity in similar_strings(unit, rules.matrix, rules.mutation_cutoff):
                for a, b in spelled(other):
                    n = dict(((x, y), c) for x, y, c in spelled(other, True)).get((a, b), 0)
                    if n > count * rules.min_mutation_freq:
                        vocab.add(a, b, n, parent=unit, similarity=similarity)
                        vocab.units[unit]["is_parent"] = True
                        merge(a, b)
    return vocab


# ---------------------------------------------------------------- in one process


class _Corpus:
    """Symbols in flat arrays with links to the neighbours, and where each pair stands."""

    def __init__(self, sequences: list[str]) -> None:
        self.symbol: list = []
        for s in sequences:
            self.symbol += [*s, None]
        n = len(self.symbol)
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.at: dict = {}
        for i in range(n - 1):
            if self.symbol[i] is not None and self.symbol[i + 1] is not None:
                self.at.setdefault((self.symbol[i], self.symbol[i + 1]), set()).add(i)
        self.queue = [(-len(v), p) for p, v in self.at.items()]
        heapq.heapify(self.queue)
        self.spelling: dict = {}
        for p in self.at:
            self.spelling.setdefault(p[0] + p[1], set()).add(p)

    def best(self):
        while self.queue:
            n, p = self.queue[0]
            if len(self.at.get(p, ())) == -n and n:
                return (*p, -n)
            heapq.heappop(self.queue)
        return None

    def spelled(self, unit: str, counts: bool = False) -> list:
        live = sorted(p for p in self.spelling.get(unit, ()) if self.at.get(p))
        return [(*p, len(self.at[p])) for p in live] if counts else live

    def merge(self, left: str, right: str) -> None:
        unit, symbol, after, before, moved = left + right, self.symbol, self.after, self.before, set()

        def drop(i: int, pair: tuple) -> None:
            self.at[pair].discard(i)
            moved.add(pair)

        def put(i: int, pair: tuple) -> None:
            if pair not in self.at:
                self.at[pair] = set()
                self.spelling.setdefault(pair[0] + pair[1], set()).add(pair)
            self.at[pair].add(i)
            moved.add(pair)

        for i in sorted(self.at[left, right]):
            if i not in self.at[left, right]:
                continue  # taken by the merge to the left
            j = after[i]
            h, k = before[i], after[j]
            drop(i, (left, right))
            if h >= 0 and symbol[h] is not None:
                drop(h, (symbol[h], left))
                put(h, (symbol[h], unit))
            if symbol[k] is not None:
                drop(j, (right, symbol[k]))
                put(i, (unit, symbol[k]))
            symbol[i], symbol[j] = unit, None
            after[i], before[k] = k, i
        for p in moved:
            if self.at[p]:
                heapq.heappush(self.queue, (-len(self.at[p]), p))
            else:
                del self.at[p]


def train_local(sequences: list[str], rules: Rules, alphabet: list[str] | None = None) -> Vocabulary:
    """Learn from a list of sequences; the alphabet is theirs, sorted, unless given."""
    corpus = _Corpus([s for s in sequences if s])
    vocab = Vocabulary(alphabet if alphabet is not None else sorted({c for s in sequences if s for c in s}))
    return _learn(vocab, rules, corpus.best, corpus.merge, corpus.spelled)


def train_units(df: DataFrame, seq: str, configs: dict[str, Rules], *, most_chars: int = 5_000_000) -> DataFrame:
    """One vocabulary per configuration, each in a task of its own. The corpus goes to
    every task, so its size is checked: above ``most_chars`` use ``train_distributed``."""
    spark = df.sparkSession
    src = df.select(df[seq].alias("s")).filter(F.length("s") > 0)
    size = src.agg(F.sum(F.length("s"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"{size} letters are too many for one task; use train_distributed")
    corpus = spark.sparkContext.broadcast([r["s"] for r in src.collect()])

    def run(key: tuple, _: pa.Table) -> pa.Table:
        vocab = train_alone(corpus.value, configs[key[0].as_py()])
        _memory_back()
        return _vocab_table(vocab.rows(key[0].as_py()))

    jobs = spark.createDataFrame([(c,) for c in configs], "config_id string").repartition(len(configs), "config_id")
    return jobs.groupBy("config_id").applyInArrow(run, VOCAB_SCHEMA)


# ---------------------------------------------------------------- in tasks that run together


def _numbered(texts: Iterable[list[str]]) -> tuple[np.ndarray, list[str]]:
    """All letters as numbers in one array, 0 before, between and after the texts, and the letters by number."""
    number, names, parts = np.zeros(0x110000, dtype=np.int32), [""], [np.zeros(1, dtype=np.int16)]
    for rows in texts:
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32)
        new = np.unique(codes[number[codes] == 0])
        number[new] = np.arange(len(names), len(names) + len(new))
        names += map(chr, new.tolist())
        ends = np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) + 1) - 1
        letter = np.ones(len(codes) + len(rows), dtype=bool)
        letter[ends] = False
        x = np.zeros(len(letter), dtype=np.int16 if len(names) < 1 << 15 else np.int32)
        x[letter] = number[codes]
        parts.append(x)
    return np.concatenate(parts), names


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, where each one's values begin and the last one's end, and the values
    by key, else in their order."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[cuts], np.append(cuts, len(keys)), values


class _Chunk:
    """A part of the corpus, and the pair counts of the whole. A unit's number stands in the first
    and in the last cell of its letters, 0 parts sequences; where each pair stands is
    kept, so that a merge looks at its own places alone. ``gather`` gives the messages
    that all chunks sent in this step, so all keep the same counts and choose the same pairs."""

    def __init__(self, texts: Iterable[list[str]], gather: Callable[[bytes], list[bytes]]) -> None:
        self.gather = gather
        x, own = _numbered(texts)
        self.letters = sorted({c for m in gather("".join(own).encode()) for c in m.decode()})
        self.names = ["", *self.letters]
        self.code = {c: i for i, c in enumerate(self.names) if i}
        self.x = np.array([0, *(self.code[c] for c in own[1:])], dtype=np.int16 if len(self.names) < 1 << 15 else np.int32)[x]
        #: places of the pairs of letters; of the pairs that a merge made, by unit: with those before and those after it
        self.at: dict[tuple[int, int], list] = {}
        self.made: dict[int, list] = {}
        size, count = len(self.names), {}
        for i in range(0, len(self.x) - 1, 1 << 22):
            a, b = self.x[i : i + (1 << 22)], self.x[i + 1 : i + 1 + (1 << 22)]
            a = a[: len(b)]
            at = np.flatnonzero((a > 0) & (b > 0))
            # keys of 16 bits are sorted by radix
            keys = (a[at].astype(np.int64) * size + b[at]).astype(np.uint16 if size < 256 else np.int64)
            keys, cuts, places = _groups(keys, (at + i).astype(np.int32))
            for k, j, end in zip(keys.tolist(), cuts.tolist(), cuts[1:].tolist()):
                self.at.setdefault(divmod(k, size), []).append(places[j:end])
                count[k] = count.get(k, 0) + end - j
        #: live pairs as (left << 32 | right), sorted, and how often each occurs in all chunks
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for m in gather(np.array([[*count], [*count.values()]], dtype=np.int64).tobytes()):
            k, n = np.frombuffer(m, dtype=np.int64).reshape(2, -1)
            self._change(k // size << 32 | k % size, n)

    def _change(self, keys: np.ndarray, by: np.ndarray) -> None:
        """Adds to the counts of pairs."""
        keys, cuts, by = _groups(keys, by)
        by = np.diff(np.concatenate([[0], np.cumsum(by)])[cuts])
        keys, by = keys[by != 0], by[by != 0]
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        self.n[at[there]] += by[there]
        if not there.all():
            self.keys, self.n = np.insert(self.keys, at[~there], keys[~there]), np.insert(self.n, at[~there], by[~there])

    def best(self):
        most = self.n.max(initial=0)
        if not most:
            return None
        lead = self.keys[self.n == most].tolist()
        return (*min((self.names[k >> 32], self.names[k & 0xFFFFFFFF]) for k in lead), int(most))

    def spelled(self, unit: str, counts: bool = False) -> list:
        live = []
        for i in range(1, len(unit)):
            if (a := self.code.get(unit[:i])) and (b := self.code.get(unit[i:])):
                k = a << 32 | b
                at = np.searchsorted(self.keys, k)
                if at < len(self.keys) and self.keys[at] == k and self.n[at]:
                    live.append((unit[:i], unit[i:], int(self.n[at])))
        return sorted(live) if counts else [r[:2] for r in sorted(live)]

    def _places(self, a: int, b: int) -> np.ndarray:
        """All places of a pair, each once, and some where it no longer stands."""
        found = [np.zeros(0, dtype=np.int32), *self.at.pop((a, b), [])]
        for side, unit, other in ((0, b, a), (1, a, b)):
            for keys, cuts, places in (m[side] for m in self.made.get(unit, ())):
                at = np.searchsorted(keys, other)
                if at < len(keys) and keys[at] == other:
                    found.append(places[cuts[at] : cuts[at + 1]])
        return np.concatenate(found)

    def merge(self, left: str, right: str) -> None:
        a, b, unit = self.code[left], self.code[right], left + right
        if unit not in self.code:
            self.code[unit] = len(self.names)
            self.names.append(unit)
        u, size, la, lb = self.code[unit], len(self.names), len(left), len(right)
        if u > np.iinfo(self.x.dtype).max:
            self.x = self.x.astype(np.int32)
        x, long = self.x, np.array([len(n) for n in self.names], dtype=np.int32)
        i = self._places(a, b)
        # a place whose left or right unit has been merged since is none any more
        i = i[x[i] == a]
        i = i[x[i + la] == b]
        if (i[1:] < i[:-1]).any():
            i = np.sort(i)
        if a == b:  # of a run of overlapping hits every second counts
            run = np.cumsum(np.concatenate([[0], np.diff(i) != la]))[: len(i)]
            head = i[np.concatenate([[True], np.diff(run) != 0])[: len(i)]]
            i = i[(i - head[run]) // la % 2 == 0]
        j, k = i + la, i + la + lb
        before, after = x[i - 1], x[k]
        joined = np.concatenate([[False], np.diff(i) == la + lb])[: len(i)]  # to the merge on the left
        x[j - 1] = x[j] = -1
        x[i] = x[k - 1] = u
        free = ~joined & (before > 0)
        told = np.concatenate([[len(i), joined.sum()], np.bincount(before[free], minlength=size), np.bincount(after[after > 0], minlength=size)])
        after, before, at = x[k], before[free], i[free]
        self.made.setdefault(u, []).append((_groups(before, at - long[before]), _groups(after[after > 0], i[after > 0])))
        some = np.flatnonzero(told)
        total = np.zeros(len(told), dtype=np.int64)
        for m in self.gather(np.array([some, told[some]], dtype=np.int32).tobytes()):
            which, n = np.frombuffer(m, dtype=np.int32).reshape(2, -1)
            total[which] += n
        merges, touching, before, after = int(total[0]), int(total[1]), total[2 : size + 2], total[size + 2 :].copy()
        old, new = np.flatnonzero(before), np.flatnonzero(after)
        keys, by = [[a << 32 | b], old << 32 | a, old << 32 | u, b << 32 | new], [[-merges], -before[old], before[old], -after[new]]
        after[a] -= touching
        after[u] += touching
        new = np.flatnonzero(after)
        self._change(np.concatenate([*keys, u << 32 | new]), np.concatenate([*by, after[new]]))
        if len(self.keys) > 2 * np.count_nonzero(self.n):
            self.keys, self.n = self.keys[self.n > 0], self.n[self.n > 0]


def _memory_back() -> None:
    """Gives freed memory back to the system. The worker process lives on beside later tasks, and the C
    library would keep most of a chunk's many arrays."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


@contextmanager
def _gathering(task: BarrierTaskContext) -> Iterator[Callable[[bytes], list[bytes]]]:
    """A function that gives what all tasks of a barrier stage sent in this step. The barrier's own
    takes a second for each call, so it tells only where the first task listens;
    messages go through that task."""
    infos, first = task.getTaskInfos(), task.partitionId() == 0
    if len(infos) == 1:
        yield lambda m: [m]
        return
    key = os.urandom(32)
    ear = Listener(("0.0.0.0", 0), backlog=len(infos), authkey=key) if first else None
    port, key = next(m for m in task.allGather(f"{ear.address[1]} {key.hex()}" if first else "") if m).split()
    if first:
        ends = [ear.accept() for _ in infos[1:]]
    else:
        ends = [Client((infos[0].address.rpartition(":")[0].strip("[]"), int(port)), authkey=bytes.fromhex(key))]
    for e in ends:  # else the second part of a message waits 40 ms for the receipt of the first
        with socket.socket(fileno=os.dup(e.fileno())) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def gather(m: bytes) -> list[bytes]:
        if not first:
            ends[0].send_bytes(m)
            return pickle.loads(ends[0].recv_bytes())
        every = [m, *(e.recv_bytes() for e in ends)]
        told = pickle.dumps(every)
        for e in ends:
            e.send_bytes(told)
        return every

    try:
        yield gather
    finally:
        for e in [*ends, *([ear] if first else [])]:
            e.close()


def slots(spark: SparkSession) -> int:
    """How many tasks of this application run at once; 0 where executors come and go."""
    sc = spark.sparkContext._jsc.sc()
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def train_together(df: DataFrame, seq: str, rules: Rules, *, config: str = "config", chunks: int | None = None) -> DataFrame:
    """The same vocabulary by tasks that run at the same time (barrier mode), each with a chunk of
    the corpus in memory, some fifteen bytes a letter. Every task takes the same steps; after
    a merge they exchange how often its pair stood beside each unit."""
    spark = df.sparkSession
    src = df.select(df[seq].alias("s")).filter(F.length("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        with _gathering(task) as gather:
            chunk = _Chunk((b.column(0).to_pylist() for b in batches), gather)
            vocab = _learn(Vocabulary(chunk.letters), rules, chunk.best, chunk.merge, chunk.spelled)
        del chunk
        _memory_back()
        if task.partitionId() == 0:
            yield from _vocab_table(vocab.rows(config)).to_batches()

    parts = src.repartition(chunks or max(1, slots(spark)))
    return written(parts.mapInArrow(run, VOCAB_SCHEMA, barrier=True), "learned")


def train_alone(sequences: list[str], rules: Rules) -> Vocabulary:
    """What ``train_local`` learns, by one chunk: some fifteen bytes a letter instead of some hundred."""
    chunk = _Chunk([[s for s in sequences if s]], lambda m: [m])
    return _learn(Vocabulary(chunk.letters), rules, chunk.best, chunk.merge, chunk.spelled)


# ---------------------------------------------------------------- in chunks


def _merged(x: np.ndarray, rules: list[tuple[int, int, int]]) -> np.ndarray:
    """Each (left, right, unit) merged left to right, in turn; 0 parts sequences."""
    for left, right, unit in rules:
        hit = np.flatnonzero((x[:-1] == left) & (x[1:] == right))
        if not len(hit):
            continue
        if left == right:  # of a run of overlapping hits every second counts
            run = np.cumsum(np.concatenate([[0], np.diff(hit) != 1]))
            head = hit[np.concatenate([[True], np.diff(run) != 0])]
            hit = hit[(hit - head[run]) % 2 == 0]
        x = x.copy()
        x[hit] = unit
        keep = np.ones(len(x), dtype=bool)
        keep[hit + 1] = False
        x = x[keep]
    return x


def _merged_together(x: np.ndarray, rules: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """The same for rules that share no unit, in one pass over the symbols."""
    after, unit = np.full(size, -1, dtype=x.dtype), np.zeros(size, dtype=x.dtype)
    for left, right, new in rules:
        after[left], unit[left] = right, new
    hit = np.flatnonzero(after[x[:-1]] == x[1:])
    if any(left == right for left, right, _ in rules):
        twin = x[hit] == x[hit + 1]
        same = hit[twin]
        if len(same):  # of a run of overlapping hits every second counts
            run = np.cumsum(np.concatenate([[0], np.diff(same) != 1]))
            head = same[np.concatenate([[True], np.diff(run) != 0])]
            hit = np.sort(np.concatenate([hit[~twin], same[(same - head[run]) % 2 == 0]]))
    if not len(hit):
        return x
    x = x.copy()
    x[hit] = unit[x[hit]]
    keep = np.ones(len(x), dtype=bool)
    keep[hit + 1] = False
    return x[keep]


def merged_symbols(df: DataFrame, seq: str, pairs: list[tuple[str, str]], out: str = "symbols") -> DataFrame:
    """Adds the symbols of each sequence after merging the pairs, one after the other, each
    left to right without overlaps; null for a null sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, names = {"": 0}, [""]

            def number(x: str) -> int:
                if x not in code:
                    code[x] = len(names)
                    names.append(x)
                return code[x]

            texts = b.column(b.schema.get_field_index(seq)).to_pylist()
            x = np.array([number(c) for s in texts for c in (*(s or ""), "")], dtype=np.int32)
            x = _merged(x, [(number(a), number(c), number(a + c)) for a, c in pairs])
            ends = np.flatnonzero(x == 0)
            offsets = np.concatenate([[0], ends - np.arange(len(ends))])
            mask = np.array([*(s is None for s in texts), False])
            cells = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32(), mask=mask), pa.array(names).take(pa.array(x[x > 0])))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def train_distributed(df: DataFrame, seq: str, rules: Rules, *, config: str = "config", rewrite_every: int = 12) -> DataFrame:
    """The same vocabulary with the corpus left where it is: each round counts the
    pairs of all chunks and merges; only pair counts reach the driver, at most one per
    pair of units. Several leading pairs are merged in one round, one pass over the symbols, where
    that provably gives what merging them in turn gives. Every ``rewrite_every`` rounds the
    chunks are written anew, which also cuts the lineage."""
    spark = df.sparkSession
    src = df.select(df[seq].alias("s")).filter(F.length("s") > 0)
    letters = sorted(r["c"] for r in src.select(F.explode(F.array_distinct(F.filter(F.split("s", ""), lambda c: c != ""))).alias("c")).distinct().collect())
    code = {c: i + 1 for i, c in enumerate(letters)}
    names = ["", *letters]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([code.get(c, 0) for s in b.column(0).to_pylist() for c in (*s, "")], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], type=pa.binary())], names=["x"])

    even = src.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    state = {"chunks": written(even.mapInArrow(load, "x binary"), "units"), "pending": [], "counts": None}

    def through(x: np.ndarray, rounds: list, size: int) -> np.ndarray:
        for together in rounds:
            x = _merged_together(x, together, size)
        return x

    def chunks_with(rules_: list) -> DataFrame:
        size = len(names)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([through(np.frombuffer(x.as_py(), dtype=np.int32), rules_, size).tobytes() for x in b.column(0)], type=pa.binary())], names=["x"])

        return state["chunks"].mapInArrow(apply, "x binary")

    def count() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left and right units of the live pairs, in order of both, and their counts."""
        if state["counts"] is None:
            todo, size = [list(r) for r in state["pending"]], len(names)

            def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for raw in b.column(0):
                        x = through(np.frombuffer(raw.as_py(), dtype=np.int32), todo, size)
                        both = (x[:-1] > 0) & (x[1:] > 0)
                        keys = x[:-1][both].astype(np.int64) * size + x[1:][both]
                        if size * size < 4 * len(keys):
                            n = np.bincount(keys)
                            key = np.flatnonzero(n)
                            n = n[key]
                        else:
                            key, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["k", "n"])

            t = state["chunks"].mapInArrow(pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
            k, n = t["k"].to_numpy(), t["n"].to_numpy()
            order = np.argsort(k)
            state["counts"] = k[order] // size, k[order] % size, n[order]
        return state["counts"]

    def merge(left: str, right: str) -> None:
        unit = left + right
        if unit not in code:
            code[unit] = len(names)
            names.append(unit)
        ahead = state.get("ahead", [])
        planned = bool(ahead) and ahead[0][:2] == (left, right)
        # the pairs that lead together share no unit, so they make one round
        if not (planned and state.get("same")):
            state["pending"].append([])
        state["pending"][-1].append((code[left], code[right], code[unit]))
        state["ahead"] = ahead[1:] if planned else []
        state["same"] = planned
        if not state["ahead"]:
            state["counts"] = None
        if len(state["pending"]) >= rewrite_every and not state["ahead"]:
            state["chunks"], state["pending"] = written(chunks_with(state["pending"]), "units"), []

    def best():
        if state.get("ahead"):
            return state["ahead"][0]
        left, right, n = count()
        if not len(n):
            return None
        # the leading pairs, and all that are as frequent as the last of them
        lead = np.flatnonzero(n >= np.partition(n, -min(64, len(n)))[-min(64, len(n))])
        ranked = sorted(((names[left[i]], names[right[i]], int(n[i])) for i in lead), key=lambda r: (-r[2], r[0], r[1]))[:64]
        ahead, used = [ranked[0]], {ranked[0][0], ranked[0][1]}
        # the next pair stays next if it shares no unit with those before it, and
        # occurs more often than any pair that could meet one of their units; a unit
        # that may draw in mutations comes last, as these are looked up in new counts
        met = np.zeros(len(names), dtype=bool)
        free = np.ones(len(n), dtype=bool)

        def take(a: str, b: str) -> None:
            met[[code[a], code[b]]] = True
            if a != b:
                free[(left == code[a]) & (right == code[b])] = False

        take(*ranked[0][:2])
        for a, b, m in ranked[1:]:
            touched = int(n[(met[left] | met[right]) & free].max(initial=0))
            if draws(ahead[-1][0] + ahead[-1][1]) or a in used or b in used or m <= touched or a + b in code or any(r[0] + r[1] == a + b for r in ahead):
                break
            ahead.append((a, b, m))
            used |= {a, b}
            take(a, b)
        state["ahead"], state["same"] = ahead, False
        return ahead[0]

    def draws(unit: str) -> bool:
        return rules.mutated and rules.min_mutation_len <= len(unit) <= rules.max_mutation_len and bool(similar_strings(unit, rules.matrix, rules.mutation_cutoff))

    def spelled(unit: str, counts: bool = False) -> list:
        left, right, n = count()
        key, live = left * len(names) + right, []
        for i in range(1, len(unit)):
            if unit[:i] in code and unit[i:] in code:
                k = code[unit[:i]] * len(names) + code[unit[i:]]
                at = np.searchsorted(key, k)
                if at < len(key) and key[at] == k:
                    live.append((unit[:i], unit[i:], int(n[at])))
        return sorted(live) if counts else [r[:2] for r in sorted(live)]

    vocab = _learn(Vocabulary(letters), rules, best, merge, spelled)
    return spark.createDataFrame(vocab.rows(config), VOCAB_SCHEMA)


def train(df: DataFrame, seq: str, configs: dict[str, Rules], *, most_chars: int = 5_000_000, most_together: int = 40_000_000) -> DataFrame:
    """One vocabulary per configuration by the trainer that suits the corpus' size; all give
    the same. Up to ``most_chars`` it is learned in one task, up to ``most_together`` letters for each
    task that can run at once by these together, beyond that, and where executors come
    and go, from chunks in the shared folder."""
    size = df.agg(F.sum(F.length(seq))).first()[0] or 0
    if size <= most_chars:
        return written(train_units(df, seq, configs, most_chars=most_chars), "learned")
    learn = train_together if size <= most_together * slots(df.sparkSession) else train_distributed
    each = [learn(df, seq, rules, config=name) for name, rules in configs.items()]
    return reduce(DataFrame.unionByName, each)
