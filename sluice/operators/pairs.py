"""Sums over the pairs of items that meet in a user's list, as helpers inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Ratings packed at a time, about; a user's list is never split.
PACKED = 1_000_000

#: Pairs sorted at a time; an item with more of them is summed by its partners' places.
SORTED_BITS = 18


def least_type(most: int) -> type:
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def packed(batch: int, counts: np.ndarray, at: np.ndarray, rating: np.ndarray, known: np.ndarray, blocks: int) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes, bytes]]:
    """Whole lists of users with two ratings or more, a row for each block: ratings a user, places, and coded ratings."""
    user = np.repeat(np.arange(len(counts)), counts)
    block = at % blocks
    for b in np.unique(block).tolist():
        mine = block == b
        n, place = np.bincount(user[mine], minlength=len(counts)), at[mine] // blocks
        values, code = np.unique(np.where(known[mine], rating[mine], 0.0), return_inverse=True)
        none = ~known[mine]
        # The last code stands for a rating that is null.
        values, code = np.append(values, 0.0), np.where(none, len(values), code)
        arrays = (a.astype(least_type(int(a.max(initial=0)))) for a in (n, place, code))
        yield b, batch, *((np.append(np.uint8(a.itemsize), a.view(np.uint8))).tobytes() for a in arrays), values.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]], offset=1)


def pack(blocks: int):
    """For ``mapInArrow`` over ``user, at, r`` sorted by user: rows of :func:`packed` with their types."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        made = 0

        def rows(table: pa.Table, last: bool) -> pa.Table:
            nonlocal made
            user, at, r = (table[c].combine_chunks() for c in ("user", "at", "r"))
            code = user.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            whole = len(code) if last else int(starts[-1])
            counts = np.diff(np.append(starts[starts < whole], whole))
            if (counts > 1).any():
                kept = np.flatnonzero(np.repeat(counts > 1, counts))
                known, rating = np.asarray(r.is_valid())[kept], np.asarray(r.fill_null(0.0))[kept]
                out.extend(packed(task + made, counts[counts > 1], at.to_numpy()[kept], rating, known, blocks))
                made += 1
            return table.slice(whole)

        out, waiting, come, most = [], [], 0, PACKED
        for batch in batches:
            waiting.append(batch)
            come += batch.num_rows
            if come >= most:
                held = rows(pa.Table.from_batches(waiting), False)
                # A list longer than all that is held is looked at again once as much has come.
                waiting, come, most = held.to_batches(), 0, max(PACKED, held.num_rows)
                yield from flushed(out)
        if any(b.num_rows for b in waiting):
            rows(pa.Table.from_batches(waiting), True)
            yield from flushed(out)

    def flushed(out):
        for row in out:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["block", "batch", "n", "place", "code", "kinds"])
        out.clear()

    return run


def side(parts: list[dict], batches: list[int]):
    """Ratings of one block as arrays: how many a user has, places, ratings, which are known, and the items' norms."""
    by = {p["batch"]: p for p in parts}
    n, place = (np.concatenate([unpacked(by[t].pop(c)) for t in batches]) for c in ("n", "place"))
    rating, known, a = np.empty(len(place)), np.empty(len(place), bool), 0
    for t in batches:
        values, code = np.frombuffer(by[t]["kinds"]), unpacked(by[t].pop("code"))
        rating[a : a + len(code)], known[a : a + len(code)] = values[code], code != len(values) - 1
        a += len(code)
    return n, place, rating, known, np.array(by[None]["norms"], float)


def ranked(item: np.ndarray, other: np.ndarray, score: np.ndarray, k: int):
    """Rows of each item's ``k`` best, and the row of its k-th: best first, NaN before all, null (-inf) last, ties to the smaller other."""
    if not len(item):
        return item, item
    # Cosines lie within 1, so whole billionths beside the item sort as one number; ties stay for the sort below.
    least = int(item.min())
    low = (2_000_000_000 - np.clip(score, -2, 2) * 1e9).astype(np.int64)
    both = np.sort(((item - least) << 32) | low)
    runs = np.flatnonzero(np.append(True, both[1:] >> 32 != both[:-1] >> 32))
    kth = both[np.minimum(runs + k, np.append(runs[1:], len(both))) - 1]
    names = kth >> 32
    at = np.zeros(int(names[-1]) + 1, np.int64) if names[-1] < 8 * len(item) + 1024 else None
    if at is None:
        run = np.searchsorted(names, item - least)
    else:
        at[names] = np.arange(len(names))
        run = at[item - least]
    near = np.flatnonzero(low <= kth[run] & ((1 << 32) - 1))
    order = near[np.lexsort((other[near], -score[near], item[near]))]
    first = np.append(True, item[order][1:] != item[order][:-1])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k], order[rank == k - 1]


def met(sides: list, least: int):
    """Pairs of an item of the first side and one of the last with ``least`` common users: places and scores.

    All pairs of an item of the first come at once. Scores are rounded to nine decimals; NaN is infinity and
    null minus infinity, as they sort. ``sides`` is emptied, as the first is held in another order.
    """
    same = len(sides) == 1
    (pn, px, pr, pk, pnorm), (qn, qy, qr, qk, qnorm) = sides[0], sides[-1]
    sides.clear()
    begins = np.cumsum(qn, dtype=np.int64) - qn
    user = np.repeat(np.arange(len(pn), dtype=np.int32), pn)
    use = np.flatnonzero(qn[user] > 0)
    use = use[np.argsort(px[use], kind="stable")]
    user, px, pr, pk = user[use], px[use], pr[use], pk[use]
    every = bool(pk.all() and qk.all())
    heads = np.append(np.flatnonzero(np.append(True, px[1:] != px[:-1])), len(px))
    total = np.append(0, np.cumsum(qn[user], dtype=np.int64))[heads]
    width, most = len(qnorm), 1 << SORTED_BITS

    def spread(a: int, b: int):
        n = qn[user[a:b]].astype(np.int64)
        e = np.repeat(np.arange(b - a), n)
        return e, (begins[user[a:b]] - (np.cumsum(n) - n))[e] + np.arange(len(e))

    def scored(x, y, dot, known):
        with np.errstate(all="ignore"):
            score = dot / (pnorm[x] * qnorm[y])
            score = np.copysign(np.floor(np.abs(score) * 1e9 + 0.5), score) / 1e9
        score = np.where(np.isnan(score), np.inf, score)
        score = score if known is None else np.where(known > 0, score, -np.inf)
        apart = x != y if same else slice(None)
        return x[apart], y[apart], score[apart]

    g = 0
    while g < len(heads) - 1:
        h = max(g + 1, int(np.searchsorted(total, total[g] + most, "right")) - 1)
        a, b = int(heads[g]), int(heads[h])
        if total[h] - total[g] <= most:
            e, at = spread(a, b)
            row = np.repeat(np.arange(h - g) * width, np.diff(heads[g : h + 1]))
            order = np.sort(((row[e] + qy[at]) << SORTED_BITS) | np.arange(len(e)))
            key = order >> SORTED_BITS
            runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            shared = np.diff(np.append(runs, len(key)))
            hit = shared >= least
            if hit.any():
                rows = order[np.repeat(hit, shared)] & (most - 1)
                e, at, pair, n = a + e[rows], at[rows], key[runs[hit]], shared[hit]
                starts = np.cumsum(n) - n
                known = None if every else np.add.reduceat((pk[e] & qk[at]).astype(np.int64), starts)
                yield scored(px[heads[g + pair // width]].astype(np.int64), pair % width, np.add.reduceat(pr[e] * qr[at], starts), known)
        else:
            shared, dot, known = np.zeros(width, np.int64), np.zeros(width), None if every else np.zeros(width)
            ends = np.cumsum(qn[user[a:b]], dtype=np.int64)
            c = a
            while c < b:
                done = ends[c - a - 1] if c > a else 0
                d = max(c + 1, a + int(np.searchsorted(ends, done + most, "right")))
                e, at = spread(c, d)
                shared += np.bincount(qy[at], minlength=width)
                dot += np.bincount(qy[at], weights=pr[c + e] * qr[at], minlength=width)
                if known is not None:
                    known += np.bincount(qy[at], weights=pk[c + e] & qk[at], minlength=width)
                c = d
            y = np.flatnonzero(shared >= max(least, 1))
            yield scored(np.full(len(y), px[a], np.int64), y, dot[y], None if known is None else known[y])
        g = h


def nearest(blocks: int, k: int, least: int):
    """For ``mapInArrow`` over the rows of cells, one cell to a task: ``item, other, score`` of the ``k`` best in the cell."""

    def run(batches):
        cells: dict[tuple, dict[int, list]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                cells.setdefault((row["lo"], row["hi"]), {}).setdefault(row["block"], []).append(row)
        while cells:
            (lo, hi), held = cells.popitem()
            common = sorted(set.intersection(*({r["batch"] for r in held.get(b, ()) if r["batch"] is not None} for b in (lo, hi))))
            if common:
                yield from best([side(held.pop(b), common) for b in sorted({lo, hi})], lo, hi)

    def best(sides, lo, hi):
        bar = np.full(len(sides[-1][4]), -np.inf)
        back, size = [], 0

        def least_back():
            x, y, s = (np.concatenate(c) for c in zip(*back))
            kept, last = ranked(y, x, s, k)
            bar[y[last]] = s[last]
            return x[kept], y[kept], s[kept]

        for x, y, s in met(sides, least):
            kept, _ = ranked(x, y, s, k)
            yield rows(x[kept] * blocks + lo, y[kept] * blocks + hi, s[kept])
            if lo != hi:
                fit = s >= bar[y]
                back.append((x[fit], y[fit], s[fit]))
                size += int(fit.sum())
                if size > (1 << 20) + k * len(bar):
                    back = [least_back()]
                    size = len(back[0][0])
        if back:
            x, y, s = least_back()
            yield rows(y * blocks + hi, x * blocks + lo, s)

    def rows(item, other, score):
        value = pa.array(np.where(np.isposinf(score), np.nan, score), pa.float64(), mask=np.isneginf(score), from_pandas=False)
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(other.astype(np.int64)), value], names=["at", "other_at", "score"])

    return run
