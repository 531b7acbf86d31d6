"""Language-model scores from an Elias-Fano n-gram trie.

The first level holds the training words: their 64-bit hashes as an Elias-Fano sequence (a word's
id is its rank) with exact counts. The second holds what follows each word: monotone pointers into
one sequence of followers, stored relative to their context, with discounted log probabilities in
16 bits. A pair is found by a successor search for the follower's id above its context's base; a sieve
of one hashed bit a pair spares most searches for pairs that aren't there.

Words are built in shards of equal hash ranges. Pairs are built in the cells of a grid, a range of
contexts by a range of followers, so that a context that precedes a third of all words lies in many
files; ids go by hash, which spreads its followers evenly. Each shard or cell is built by one task from
partial counts that were summed per task before the shuffle and are summed again as they arrive, and
written once to the folder all executors share; scoring tasks map the files into memory and know which
of them exist, so a lost file is an error. Nothing but the files' sizes goes through the driver.

Probabilities interpolate absolute discounts with the base model of single words, which gives
unseen words the mass of a count of 0.1: they sum to one in every context. Every pair of the training
texts is stored, those seen once too.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut, shared_dir
from sluice.llm.common import fold, texts
from sluice.llm.eliasfano import EliasFano

DISCOUNT = 0.75
ADD = 0.1
#: Shards grow with the root of the documents, so neither one shard's pairs nor the shards that a
#: slice of text visits grow as fast as the corpus: ``SHARDS`` for every ``SHARD_DOCS`` under the root.
SHARDS, SHARD_DOCS = 6, 4000
#: No shard is built from more text than this on average.
SHARD_BYTES = 128 << 20
#: Shards of a level that a worker holds open before it closes the one opened first.
OPEN_SHARDS = 256
#: Bytes of text that are looked up together.
SLICE = 8 << 20
#: Bits of the sieve for each pair.
SIEVE_BITS = 16
#: Distinct words, or running pairs, that a task sums before it hands them on.
HELD_WORDS, HELD_PAIRS = 400_000, 4_000_000
#: Words whose ids a worker remembers before it starts anew.
MEMORY = 400_000
STEPS = 4000.0
#: No word holds white space, so this stands for the end of a text.
END = b"\n"


def digest(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which shuffle compression likes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Store:
    """Named arrays in one file each, in a folder that driver and executors share."""

    def __init__(self, uri: str):
        self.uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"

    def _place(self, name: str) -> tuple[pa.fs.FileSystem, str]:
        fs, path = pa.fs.FileSystem.from_uri(self.uri.replace("file:///", "file:/").replace("file:/", "file:///"))
        return fs, f"{path}/{name}"

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> int:
        """Write under another name, then rename: a second try or another task changes nothing."""
        fs, path = self._place(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        body = b""
        head = []
        for key, value in arrays.items():
            value = np.ascontiguousarray(value)
            head.append(f"{key} {value.dtype.str} {len(value)} {len(body)}")
            body += value.tobytes() + bytes(-value.nbytes % 64)
        lead = "\n".join(head).encode()
        lead = len(lead).to_bytes(8, "little") + lead
        lead += bytes(-len(lead) % 64)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(lead + body)
        fs.move(part, path)
        return len(lead) + len(body)

    def get(self, name: str) -> dict[str, np.ndarray]:
        """The arrays of a file, mapped into memory where the folder is mounted, else read."""
        fs, path = self._place(name)
        if isinstance(fs, pa.fs.LocalFileSystem):
            raw = np.memmap(path, np.uint8, mode="r").view(np.ndarray)
        else:
            with fs.open_input_file(path) as source:
                raw = np.frombuffer(source.readall(), np.uint8)
        size = int(raw[:8].view("<u8")[0])
        start = (8 + size + 63) // 64 * 64
        out = {}
        for line in bytes(raw[8 : 8 + size]).decode().split("\n"):
            key, kind, n, at = line.split(" ")
            out[key] = raw[start + int(at) : start + int(at) + int(n) * np.dtype(kind).itemsize].view(kind)
        return out


def _tagged(name: str, sequence: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": v for k, v in sequence.arrays().items()}


def _untagged(name: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano(*(arrays[f"{name}_{k}"] for k in ("head", "low", "high", "ones")))


def _make_room(shards: dict) -> None:
    while len(shards) >= OPEN_SHARDS:
        del shards[next(iter(shards))]


class Words:
    """The first level: ids and counts of words by their hashes. ``base`` are the shards' first ids."""

    def __init__(self, store: Store, base: np.ndarray):
        self.store, self.base, self.shards, self.open = store, base, len(base) - 1, {}

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unseen) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes, kind="stable")
        shard = self.shard_of(hashes[order])
        edge = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(edge[1:] > edge[:-1]):
            if self.base[s + 1] == self.base[s]:
                continue
            if s not in self.open:
                _make_room(self.open)
                arrays = self.store.get(f"words-{s}")
                self.open[s] = _untagged("hash", arrays), arrays["count"]
            sequence, count = self.open[s]
            some = order[edge[s] : edge[s + 1]]
            at, equal = sequence.successor(hashes[some])
            ids[some[equal]] = self.base[s] + at[equal]
            counts[some[equal]] = count[at[equal]]
        return ids, counts


class Reader:
    """Tokens of texts to ids and counts, with a bounded memory of words."""

    def __init__(self, words: Words):
        self.words = words
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = self.counts = np.zeros(0, np.int64)

    def read(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and counts of all tokens, ends included, and the tokens of each text."""
        split = [t.lower().split() for t in part]
        for tokens in split:
            tokens.append(END)
        flat = [w for tokens in split for w in tokens]
        if len(self.place) > MEMORY:
            self._forget()
        new = [w for w in dict.fromkeys(flat) if w not in self.place]
        if new:
            ids, counts = self.words.find(digest(new))
            self.place.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        return self.ids[at], self.counts[at], np.fromiter(map(len, split), np.int64, len(split))


def contexts(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token; ``begin`` before the first of a text."""
    out = np.r_[begin, ids[:-1]]
    out[np.r_[0, np.cumsum(sizes)[:-1]]] = begin
    return out


def _partial(cell: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of sorted keys as one row for each shard or cell."""
    order = np.argsort(cell, kind="stable")
    cell, keys, counts = cell[order], keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    parts = list(zip(first, [*first[1:], len(cell)]))
    return pa.record_batch([pa.array(cell[first].astype(np.int32)), pa.array([_planes(keys[a:b]) for a, b in parts], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in parts], pa.binary())], ["shard", "keys", "counts"])


_PARTIAL = "shard int, keys binary, counts binary"


def _gathered(rows: DataFrame, write: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``write(shard, keys, counts)`` of each shard's sums; a task holds the distinct keys of one shard and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for batch in batches:
            for shard, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if shard != now and now is not None:
                    yield write(now, *_summed(np.concatenate(keys), np.concatenate(counts)))
                    keys, counts = keys[:0], counts[:0]
                now = shard
                keys.append(_unplaned(k.as_py(), np.uint64))
                counts.append(_unplaned(c.as_py(), np.int64))
                if len(keys) > 1 and sum(map(len, keys[1:])) > max(HELD_PAIRS, len(keys[0])):
                    keys, counts = ([x] for x in _summed(np.concatenate(keys), np.concatenate(counts)))
        if now is not None:
            yield write(now, *_summed(np.concatenate(keys), np.concatenate(counts)))

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _count_words(docs: DataFrame, text_col: str, shards: int) -> DataFrame:
    def rows(total: Counter) -> pa.RecordBatch:
        keys, counts = _summed(digest(list(total)), np.fromiter(total.values(), np.int64, len(total)))
        return _partial(((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64), keys, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for _, part in texts(batch.column(0)):
                for text in part:
                    total.update(text.lower().split())
                total[END] += len(part)
                if len(total) > HELD_WORDS:
                    yield rows(total)
                    total = Counter()
        if total:
            yield rows(total)

    return docs.select(text_col).mapInArrow(run, _PARTIAL)


class Grid:
    """Cells of pairs: ``ranges`` of contexts, each as many word shards, by as many ranges of followers."""

    def __init__(self, base: np.ndarray):
        self.ranges = max(1, math.ceil(math.sqrt(len(base) - 1)))
        self.vocabulary = int(base[-1])
        # The begin of a text is the context after the last word.
        self.edges = np.r_[base[: -1 : self.ranges], self.vocabulary + 1]

    def range_of(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, context, side="right") - 1

    def cell_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.range_of(context) * self.ranges + word * self.ranges // max(1, self.vocabulary)

    def corner(self, cell: int) -> tuple[int, int]:
        """The first context and follower of a cell."""
        return int(self.edges[cell // self.ranges]), -(-(cell % self.ranges) * self.vocabulary // self.ranges)


def _count_pairs(docs: DataFrame, text_col: str, words) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level: Words = words.value
        reader, grid = Reader(level), Grid(level.base)
        held: list[np.ndarray] = []
        n = 0

        def rows() -> pa.RecordBatch:
            keys = np.concatenate(held)
            keys, counts = _summed(keys, np.ones(len(keys), np.int64))
            return _partial(grid.cell_of(*_halves(keys)), keys, counts)

        for batch in batches:
            for _, part in texts(batch.column(0), SLICE):
                ids, _, sizes = reader.read(part)
                before = contexts(ids, sizes, grid.vocabulary)
                held.append(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
                n += len(ids)
                if n > HELD_PAIRS:
                    yield rows()
                    held.clear()
                    n = 0
        if held:
            yield rows()

    return docs.select(text_col).mapInArrow(run, _PARTIAL)


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _write_words(store: Store):
    def run(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        store.put(f"words-{shard}", _tagged("hash", EliasFano.build(keys, 1 << 64)) | {"count": counts})
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], ["shard", "n", "tokens"])

    return run


def _counts_of(level: Words, grid: Grid, k: int, documents: int) -> np.ndarray:
    """How often each context of a range occurs."""
    shards = range(k * grid.ranges, min((k + 1) * grid.ranges, level.shards))
    own = [np.asarray(level.store.get(f"words-{s}")["count"]) for s in shards if level.base[s + 1] > level.base[s]]
    return np.concatenate([np.zeros(0, np.int64), *own, *([[documents]] if grid.edges[k + 1] > grid.vocabulary else [])])


def _write_pairs(store: Store, words, documents: int):
    def run(cell: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        level: Words = words.value
        grid = Grid(level.base)
        first, lowest = grid.corner(cell)
        context, word = _halves(keys)
        context, word = context - first, word - lowest
        own = _counts_of(level, grid, cell // grid.ranges, documents)
        share = (counts - DISCOUNT) / own[context]
        kinds = np.bincount(context, minlength=len(own))
        used = np.flatnonzero(kinds)
        # Followers relative to their context: each context's ids go on from the last value before it.
        pointer = np.searchsorted(context, np.arange(len(own) + 1))
        top = np.zeros(len(own), np.int64)
        top[used] = word[pointer[used + 1] - 1] + 1
        above = np.r_[0, np.cumsum(top)]
        follow = above[context] + word
        arrays = _tagged("pointer", EliasFano.build(pointer, len(keys) + 1)) | _tagged("above", EliasFano.build(above, int(above[-1]) + 1)) | _tagged("follow", EliasFano.build(follow, int(above[-1]) + 1))
        bits = max(6, (SIEVE_BITS * max(1, len(keys))).bit_length())
        sieve = np.zeros(1 << bits, np.uint8)
        sieve[sieve_place(keys, bits)] = 1
        store.put(f"pairs-{cell}", arrays | {"share": quantise(np.log10(share)), "sieve": np.packbits(sieve, bitorder="little")})
        return pa.record_batch([pa.array([cell], pa.int32()), pa.array([cell // grid.ranges], pa.int32()), pa.array([len(keys)]), pa.array([_planes(used)], pa.binary()), pa.array([_planes(kinds[used])], pa.binary())], ["cell", "shard", "n", "keys", "counts"])

    return run


def _write_rests(store: Store, words, documents: int):
    def run(k: int, contexts: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        level: Words = words.value
        own = _counts_of(level, Grid(level.base), k, documents)
        rest = np.ones(len(own))
        # Every occurrence of a context has one follower, and each kind of follower gives up the discount.
        rest[contexts.astype(np.int64)] = DISCOUNT * kinds / own[contexts.astype(np.int64)]
        store.put(f"rests-{k}", {"rest": quantise(np.log10(rest))})
        return pa.record_batch([pa.array([k], pa.int32())], ["shard"])

    return run


def sieve_place(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each pair of ids."""
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def quantise(logs: np.ndarray) -> np.ndarray:
    """Base-10 logs of 0 to -16 in 16 bits."""
    return np.clip(np.round(-logs * STEPS), 0, 65535).astype(np.uint16)


class Pairs:
    """The second level: log probabilities of a word after a context. ``cells`` and ``ranges`` are the files that exist."""

    def __init__(self, words: Words, cells: np.ndarray, ranges: np.ndarray):
        self.words, self.grid, self.cells, self.ranges, self.open = words, Grid(words.base), set(cells.tolist()), set(ranges.tolist()), {}

    def _file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.open:
            _make_room(self.open)
            self.open[name] = self.words.store.get(name)
        return self.open[name]

    def score(self, context: np.ndarray, word: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Base-10 logs; ``single`` are those of the words alone, ids of -1 are unseen."""
        out = single.copy()
        some = np.flatnonzero(context >= 0)
        keys = context[some].astype(np.uint64) << np.uint64(32) | (word[some] + 1).astype(np.uint64)
        keys, example, which = np.unique(keys, return_index=True, return_inverse=True)
        before, follow = _halves(keys)
        follow -= 1
        alone = single[some][example]
        share, rest = np.zeros(len(keys)), np.zeros(len(keys))
        grid = self.grid
        for k, a, b in _runs(grid.range_of(before)):
            if k in self.ranges:
                rest[a:b] = self._file(f"rests-{k}")["rest"][before[a:b] - grid.edges[k]] / -STEPS
        known = np.flatnonzero(follow >= 0)
        cell = grid.cell_of(before[known], follow[known])
        order = np.argsort(cell, kind="stable")
        for c, a, b in _runs(cell[order]):
            if c not in self.cells:
                continue
            file = self._file(f"pairs-{c}")
            here = known[order[a:b]]
            place = sieve_place(keys[here] - np.uint64(1), (8 * len(file["sieve"])).bit_length() - 1)
            here = here[np.flatnonzero(file["sieve"][place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)]
            pointer, above, sequence = (_untagged(name, file) for name in ("pointer", "above", "follow"))
            first, lowest = grid.corner(c)
            own, of = np.unique(before[here] - first, return_inverse=True)
            start, stop, floor = pointer.at(own)[of].astype(np.int64), pointer.at(own + 1)[of].astype(np.int64), above.at(own)[of]
            at, equal = sequence.successor(floor + (follow[here] - lowest).astype(np.uint64))
            hit = equal & (at >= start) & (at < stop)
            share[here[hit]] = 10 ** (file["share"][at[hit]] / -STEPS)
        out[some] = np.where(share > 0, np.log10(share + 10 ** (rest + alone)), rest + alone)[which]
        return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of a sorted array with the range of its places."""
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    for a, b in zip(first, [*first[1:], len(values)]):
        yield int(values[a]), int(a), int(b)


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Build the trie from all whole texts of ``docs``; returns what scoring needs.

    ``folder`` holds the levels, ``base`` the shards' first ids, ``cells`` and ``ranges`` the files of
    pairs, ``tokens`` and ``documents`` the training totals.
    """
    spark = docs.sparkSession
    documents, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    shards = max(4, math.ceil(SHARDS * math.sqrt(documents / SHARD_DOCS)), math.ceil(size / SHARD_BYTES))
    store = Store(f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}")
    counted = _gathered(_count_words(docs, text_col, shards), _write_words(store), "shard int, n long, tokens long").collect()
    sizes = np.zeros(shards, np.int64)
    for r in counted:
        sizes[r["shard"]] = r["n"]
    base, tokens = np.r_[0, np.cumsum(sizes)], sum(r["tokens"] for r in counted)
    if base[-1] >= 1 << 32:
        raise ValueError("ids of words have 32 bits")
    words = spark.sparkContext.broadcast(Words(store, base))
    written = cut(_gathered(_count_pairs(docs, text_col, words), _write_pairs(store, words, documents), "cell int, shard int, n long, keys binary, counts binary"))
    ranges = _gathered(written.select("shard", "keys", "counts"), _write_rests(store, words, documents), "shard int").collect()
    cells = written.select("cell").collect()
    return {"folder": store.uri, "base": base, "tokens": tokens, "documents": documents, "cells": np.array([r["cell"] for r in cells], np.int64), "ranges": np.array([r["shard"] for r in ranges], np.int64)}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Null texts are empty and have one token, the end. Scores are sums of base-10 logs. Repeated
    rows stay repeated; an empty table gives an empty result. Without training texts all words are
    unseen and both scores are those of the base model.
    """
    base, tokens = model["base"], model["tokens"]
    vocabulary = int(base[-1])
    shared = docs.sparkSession.sparkContext.broadcast((model["folder"], base, model["cells"], model["ranges"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, base, cells, ranges = shared.value
        words = Words(Store(folder), base)
        reader, pairs = Reader(words), Pairs(words, cells, ranges)
        for batch in batches:
            for start, part in texts(batch.column(1), SLICE):
                ids, counts, sizes = reader.read(part)
                single = np.log10((counts + ADD) / (tokens + ADD * (vocabulary + 1)))
                full = pairs.score(contexts(ids, sizes, vocabulary), ids, single)
                first = np.r_[0, np.cumsum(sizes)[:-1]]
                sums = [pa.array(np.add.reduceat(x, first)) for x in ((counts > 0).astype(np.int64), single, full)]
                yield pa.record_batch([batch.column(0).slice(start, len(part)), pa.array(sizes), sums[0], pa.array(np.full(len(part), tokens)), *sums[1:]], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Learn from all folds but 0 and score every document; ``held_out`` marks fold 0."""
    model = train(docs.where(fold(F.col(id_col), folds) != 0), text_col)
    return score(docs, model, id_col, text_col).select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
