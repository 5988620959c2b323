"""Encoding sequences with a learned vocabulary, and exporting it."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENCODED = "array<struct<token:string,start:int,end:int>>"


def export(rows: list) -> dict:
    """A vocabulary (rows with token_id, token, merge_order, pair) in the JSON model
    format of public tokenizers: ids by position, a merge per unit that has a pair."""
    rows = sorted(rows, key=lambda r: r["token_id"])
    merged = sorted((r for r in rows if len(r["token"]) != 1 and r["pair"]), key=lambda r: r["merge_order"])
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {r["token"]: i for i, r in enumerate(rows)}, "merges": [list(r["pair"]) for r in merged]}
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}


class Encoder:
    """Merges by rank: the earliest learned pair first, from left to right. Letters
    outside the vocabulary are dropped, and offsets run over what is left."""

    def __init__(self, model: dict) -> None:
        self.vocab, self.rank = model["model"]["vocab"], {}
        for i, (a, b) in enumerate(model["model"]["merges"]):
            self.rank.setdefault((a, b), i)

    def tokens(self, seq: str) -> list[str]:
        import heapq

        sym = [c for c in seq if c in self.vocab]
        n, rank = len(sym), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(rank[p], i) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in rank]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or rank.get((sym[i], sym[j])) != r:
                continue
            sym[i] += sym[j]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(queue, (q, i))
            h = before[i]
            if h >= 0 and (q := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(queue, (q, h))
        return [s for s, a in zip(sym, alive) if a]


def _blocks(b: pa.RecordBatch, at: int, letters: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many letters, or of one longer sequence: encodings take a
    hundred times the memory of their letters."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + letters, side="right")))
        yield b.slice(i, j - i)
        i = j


class _Cutter:
    """Cuts sequences into units: by the installed tokenizer library, or the own encoder. Units are
    numbers until ``names`` spells them, as text takes most of the time else."""

    def __init__(self, text: str, native: bool) -> None:
        self.own, self.library = Encoder(json.loads(text)), None
        if not native:
            # tasks share the cores out; a thread for each core keeps memory of its own
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            try:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(text)
            except ImportError:
                pass
        self.code = dict(self.own.vocab if self.library is None else self.library.get_vocab())
        spelled = {i: t for t, i in self.code.items()}
        self.spelled = [spelled.get(i, "") for i in range(max(spelled, default=-1) + 1)]

    def _number(self, token: str) -> int:
        if token not in self.code:  # a merge may spell what the vocabulary lacks
            self.code[token] = len(self.spelled)
            self.spelled.append(token)
        return self.code[token]

    def cut(self, seqs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each sequence's units begin among all units, the units, where each starts and where it
        ends in its sequence; a null sequence has none."""
        if self.library is not None:
            found = [e.ids for e in self.library.encode_batch([s or "" for s in seqs], add_special_tokens=False)]
        else:
            found = [[self._number(t) for t in self.own.tokens(s or "")] for s in seqs]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        first = np.concatenate([[0], np.cumsum(counts)])
        units = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=first[-1])
        long = np.fromiter(map(len, self.spelled), dtype=np.int64, count=len(self.spelled))[units]
        ends = np.cumsum(long)
        ends -= np.repeat(np.concatenate([[0], ends])[first[:-1]], counts)
        return first, units, ends - long, ends

    def names(self, units: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        return pa.array(self.spelled, type=pa.string()).take(pa.array(units, mask=missing))


def _sent(df: DataFrame, model: dict):
    text = json.dumps(model)
    if len(text) > 64_000_000:
        raise ValueError("the vocabulary is too large to send to every task")
    return df.sparkSession.sparkContext.broadcast(text)


def encode(df: DataFrame, seq: str, model: dict, out: str = "encoding", native: bool = False) -> DataFrame:
    """Adds the encoding of each sequence, an array of (token, start, end); null for a
    null sequence. Uses the installed tokenizer library, or the own encoder.
    The model is one vocabulary, some megabytes at most, and its size is checked."""
    sent = _sent(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(sent.value, native)
        kind = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in (x for b in batches for x in _blocks(b, b.schema.get_field_index(seq))):
            seqs = b.column(b.schema.get_field_index(seq)).to_pylist()
            first, units, starts, ends = cutter.cut(seqs)
            cell = pa.StructArray.from_arrays([cutter.names(units), pa.array(starts, type=pa.int32()), pa.array(ends, type=pa.int32())], fields=list(kind.value_type))
            offsets = pa.array(first, type=pa.int32(), mask=np.array([*(s is None for s in seqs), False]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, cell)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(ENCODED))]))


def cuts_compared(df: DataFrame, original: str, mutated: str, pos: str, model: dict, native: bool = False) -> DataFrame:
    """Encodes two sequences and puts in their place ``same`` (both are cut alike, null where one is
    null), ``ori_token`` and ``mut_token`` (the tokens that cover ``pos``, from 0; null where none
    does), as ``variants.judged`` does of two tokenisations; no tokenisation leaves the task."""
    sent = _sent(df, model)
    kept = [f for f in df.schema.fields if f.name not in (original, mutated)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(sent.value, native)
        for b in (y for b in batches for x in _blocks(b, b.schema.get_field_index(original)) for y in _blocks(x, x.schema.get_field_index(mutated))):
            place = b.column(b.schema.get_field_index(pos)).cast(pa.int64())
            nowhere = place.is_null().to_numpy(zero_copy_only=False)
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False)
            cuts, tokens, null = [], [], np.zeros(b.num_rows, dtype=bool)
            for name in (original, mutated):
                seqs = b.column(b.schema.get_field_index(name)).to_pylist()
                null |= np.array([s is None for s in seqs], dtype=bool)
                first, units, _, ends = cutter.cut(seqs)
                row = np.repeat(np.arange(len(seqs)), np.diff(first))
                # the units that end before the position
                at = first[:-1] + np.bincount(row[ends <= place[row]], minlength=len(seqs))
                missing = nowhere | (place < 0) | (at >= first[1:])
                tokens.append(cutter.names(units[np.where(missing, 0, at)] if len(units) else np.zeros(len(seqs), dtype=np.int64), missing))
                cuts.append((first, row, ends))
            (first, row, ends), (first2, _, ends2) = cuts
            same = np.diff(first) == np.diff(first2)
            other = first2[row] + np.arange(len(row)) - first[row]
            ok = same[row]
            same[row[ok][ends[ok] != ends2[other[ok]]]] = False
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(same, mask=null), *tokens], names=[*(f.name for f in kept), "same", "ori_token", "mut_token"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("same", T.BooleanType()), T.StructField("ori_token", T.StringType()), T.StructField("mut_token", T.StringType())]))
