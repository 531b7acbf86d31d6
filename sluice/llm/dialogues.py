"""Prefix trie of conversations.

Turns are sorted over ranges, so that a conversation may lie in many tasks. Each task scans its turns
with numpy for the polynomial rolling fingerprint of every prefix, over two primes; what stands at
the ends of the tasks (one row each) is put together on the driver and given to the next scan.
Prefixes of one depth and fingerprint are a candidate group. The turns of each group are compared
with those of its representative, the member of the smallest id: a group whose members agree in
their last turn and in the fingerprint before it, at every depth, agrees turn by turn. Members that
differ are split off under a name of their own, which all longer prefixes inherit.

Sums over subtrees need no walk by level. The nodes that a conversation represents are the end of
its path, so a node's subtree holds what each of its members represents, less what its own
representative has above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import cut
from sluice.llm.common import few, labelled
from sluice.llm.mixing import words_in

MODULI = (2_147_483_647, 2_147_483_629)
_BASE = 1_000_003
#: Nodes of one representative that are summed together before such blocks are.
BLOCK = 4096
_KEY = ["depth", "fp", "chain"]


@dataclass(frozen=True)
class _State:
    """Where a scan stands: in which part of which conversation, after how many of its turns, at which prefix."""

    conv: object = None
    part: int = -1
    rows: int = 0
    depth: int = 0
    prints: tuple[int, ...] = (0, 0)


class _Scan:
    def __init__(self, moduli: tuple[int, ...]):
        self.moduli = moduli
        self.powers = [np.ones(1, np.int64) for _ in moduli]
        self.inverse = [np.ones(1, np.int64) for _ in moduli]

    def _reach(self, n: int) -> None:
        for k, p in enumerate(self.moduli):
            for table, base in ((self.powers, _BASE % p), (self.inverse, pow(_BASE, -1, p))):
                while len(table[k]) <= n:
                    table[k] = np.concatenate([table[k], table[k] * pow(base, len(table[k]), p) % p])

    def after(self, state: _State, more: _State) -> _State:
        """Where a scan from ``state`` stands after turns of the same conversation that lead from none to ``more``."""
        joined = tuple((f * pow(_BASE, more.depth, p) + g) % p for f, g, p in zip(state.prints, more.prints, self.moduli))
        return replace(more, depth=state.depth + more.depth, prints=joined)

    def turns(self, state: _State, conv: pa.Array, part: np.ndarray, skip: np.ndarray, turn: np.ndarray) -> tuple[_State, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next state; which turns count, and the depth, the fingerprint and the one before of these."""
        n = len(part)
        self._reach(n + 1)
        fresh = np.ones(n, bool)
        fresh[0] = conv[0].as_py() != state.conv
        fresh[1:] = pc.not_equal(conv.slice(1), conv.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins = fresh | np.r_[part[0] != state.part, part[1:] != part[:-1]]
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(begins, at, -1))
        place = at - start + np.where(start < 0, state.rows, 0)  # turns of the part before this one
        place[start < 0] -= 1
        kept = place >= skip
        run = np.cumsum(fresh)  # 0 for the conversation of the state
        rows = np.flatnonzero(kept)
        m, own = len(rows), run[rows]
        first = np.ones(m, bool)
        first[1:] = own[1:] != own[:-1]
        began = np.maximum.accumulate(np.where(first, np.arange(m), 0)) if m else np.empty(0, np.int64)
        old = own == 0
        depth = np.arange(m) - began + 1 + np.where(old, state.depth, 0)
        prints, before = [], []
        for k, p in enumerate(self.moduli):
            x = (turn[rows] if k == 0 else turn[rows] ^ (turn[rows] >> np.uint64(29))) % np.uint64(p - 1)
            total = np.cumsum((x.astype(np.int64) + 1) * self.inverse[k][:m] % p)
            own_part = (total - np.where(began > 0, total[began - 1], 0)) % p * self.powers[k][:m] % p
            led = np.where(old, state.prints[k] * self.powers[k][1 : m + 1] % p, 0)
            f = (own_part + led) % p
            prints.append(f)
            before.append(np.where(first, np.where(old, state.prints[k], 0), np.r_[np.int64(0), f[:-1]]) if m else f)
        last = conv[n - 1].as_py()
        if m and own[-1] == run[-1]:
            end = _State(last, int(part[-1]), int(place[-1] + 1), int(depth[-1]), tuple(int(f[-1]) for f in prints))
        elif run[-1] == 0:
            end = replace(state, part=int(part[-1]), rows=int(place[-1] + 1))
        else:
            end = _State(last, int(part[-1]), int(place[-1] + 1))
        return end, rows, depth, _joined(prints), _joined(before)


def _joined(prints: list[np.ndarray]) -> np.ndarray:
    return prints[0] << np.int64(31) | prints[1]


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)


def prefixes(turns: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``conv_id, depth, fp, prev_fp, role, text`` of every turn that counts.

    ``turns`` has ``conv_id, part, skip, turn, role, text``: a conversation is its parts in order, of
    each of which the first ``skip`` turns are left out. Turns go by ``turn`` (null first), ``role``,
    ``text``. ``conv_id, role, text`` aren't null. ``skip`` should be small: a task carries one state
    for each value up to it.
    """
    order = ["conv_id", "part", "turn", "role", "text"]
    held = cut(turns.select("conv_id", "part", "skip", F.xxhash64("role", "text").alias("hash"), "role", "text", "turn").repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "part", "skip", "hash", "role", "text", F.spark_partition_id().alias("pid")))
    id_type = turns.schema["conv_id"].dataType

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the task's turns lead from each number of turns of the part before them."""
        scan, lead, states, single, pid = _Scan(moduli), None, [], True, -1
        for batch in batches:
            if batch.num_rows:
                conv, part, skip, turn = _columns(batch)
                if lead is None:
                    pid = batch.column(6)[0].as_py()
                    lead = (conv[0], int(part[0]), int(skip[0]))
                    states = [_State(conv[0].as_py(), int(part[0]), k) for k in range(int(skip[0]) + 1)]
                found = [scan.turns(s, conv, part, skip, turn)[0] for s in states]
                single &= found[0].conv == lead[0].as_py()
                states = found if single else found[:1]
        if lead is not None:
            n = len(states)
            conv = pa.array([s.conv for s in states], lead[0].type)
            yield pa.record_batch(
                [pa.array([pid] * n), pa.array([lead[0].as_py()] * n, lead[0].type), pa.array([lead[1]] * n), pa.array([lead[2]] * n), pa.array([single] * n), conv, *(pa.array([int(getattr(s, c)) for s in states], pa.int64()) for c in ("part", "rows", "depth")), *(pa.array([s.prints[k] for s in states], pa.int64()) for k in (0, 1))],
                ["pid", "lead", "lead_part", "lead_skip", "single", "conv", "part", "rows", "depth", "f", "g"],
            )

    kind = id_type.simpleString()
    edges: dict[int, list] = {}
    for r in held.mapInArrow(ends, f"pid long, lead {kind}, lead_part long, lead_skip long, single boolean, conv {kind}, part long, rows long, depth long, f long, g long").collect():
        edges.setdefault(r["pid"], []).append(r)
    scan, state, given = _Scan(moduli), _State(), {}
    for pid in sorted(edges):
        given[pid] = state
        r = edges[pid][0]
        known = min(state.rows, r["lead_skip"]) if (state.conv, state.part) == (r["lead"], r["lead_part"]) else 0
        r = edges[pid][known if r["single"] else 0]
        more = _State(r["conv"], r["part"], r["rows"], r["depth"], (r["f"], r["g"]))
        state = scan.after(state, more) if r["single"] and state.conv == r["conv"] else more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, state = _Scan(moduli), None
        for batch in batches:
            if batch.num_rows:
                state = given[batch.column(6)[0].as_py()] if state is None else state
                state, rows, depth, fp, before = scan.turns(state, *_columns(batch))
                some = pa.array(rows)
                yield pa.record_batch([batch.column(0).take(some), pa.array(depth), pa.array(fp), pa.array(before), batch.column(4).take(some), batch.column(5).take(some)], ["conv_id", "depth", "fp", "prev_fp", "role", "text"])

    return held.mapInArrow(run, f"conv_id {kind}, depth long, fp long, prev_fp long, role string, text string")


def _split(found: DataFrame, collided: DataFrame) -> DataFrame:
    """``conv_id, low, high, chain, before``: the names that a conversation's prefixes bear from one depth to another.

    In a collided group the turns that differ from the representative's bear the smallest id that
    has them; a prefix bears all the names given up to its depth.
    """
    turn = ["depth", "fp", "prev_fp", "role", "text"]
    those = found.join(few(collided), ["depth", "fp"])
    named = those.groupBy(*turn).agg(F.min("conv_id").alias("label"))
    names = those.join(named, turn).where("label <> representative")
    chain = F.expr("transform(marks, m -> concat(m.depth, ':', m.label))")
    upto = lambda n: F.array_join(F.slice(F.col("texts"), F.lit(1), n), ";")
    return (
        names.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "label"))).alias("marks"))
        .withColumn("texts", chain)
        .select("conv_id", "marks", "texts", F.posexplode("marks").alias("i", "mark"))
        .select("conv_id", F.col("mark.depth").alias("low"), F.expr("coalesce(try_element_at(marks, i + 2).depth - 1, 9223372036854775807L)").alias("high"), upto(F.col("i") + 1).alias("chain"), upto(F.col("i")).alias("before"))
    )


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, fp, chain, ends_sha256``: SHA-256 of each node's ids, ascending and joined by commas.

    Ids are sorted and joined over ranges first; the digest of a node, which has to pass over them in
    order, then streams over such chunks in one task.
    """
    kind = ends.schema["conv_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3).cast(pa.string()).to_pylist()
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            if starts:
                joined = [",".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]
                at = pa.array(starts)
                yield pa.record_batch([*(batch.column(k).take(at) for k in range(4)), pa.array(joined)], [*_KEY, "conv_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names, kinds = [*_KEY, "ends_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            done = []
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.record_batch([pa.array([r[k] for r in done], kinds[k]) for k in range(4)], names)
        if key is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), kinds)], names)

    order = [*_KEY, "conv_id"]
    return (
        ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, f"depth long, fp long, chain string, conv_id {kind}, ids string")
        .repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(digests, "depth long, fp long, chain string, ends_sha256 string")
    )


def trie(turns: DataFrame, everyone: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """The nodes of the trie of conversations, one row for each distinct sequence of first turns.

    ``turns`` as in :func:`prefixes`; ``everyone`` has each ``conv_id`` once, those without turns too.
    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, each node's members
    but one times the words of its last text), ``ends_sha256`` (of the ids that end there). No
    conversations, no nodes.
    """
    found = prefixes(turns, moduli)
    words = words_in(F.col("text")).alias("words")
    root = everyone.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("prev_fp"), F.lit(0).cast("long").alias("words"))
    path = found.select("conv_id", "depth", "fp", "prev_fp", words).union(root)
    # Turns of a group that are alike, before the group's are compared.
    alike = found.groupBy("depth", "fp", "prev_fp", "role", "text").agg(F.min("conv_id").alias("first")).select("depth", "fp", "first")
    collided = cut(alike.groupBy("depth", "fp").agg(F.count("*").alias("n"), F.min("first").alias("representative")).where("n > 1").drop("n"))
    if collided.isEmpty():
        path = path.withColumns({"chain": F.lit(""), "prev_chain": F.lit("")})
    else:
        names = few(_split(found, collided).withColumnRenamed("conv_id", "named"))
        path = path.join(names, (F.col("conv_id") == F.col("named")) & F.col("depth").between(F.col("low"), F.col("high")), "left").select(
            "conv_id", "depth", "fp", "prev_fp", "words", F.coalesce("chain", F.lit("")).alias("chain"), F.coalesce(F.when(F.col("depth") == F.col("low"), F.col("before")).otherwise(F.col("chain")), F.lit("")).alias("prev_chain")
        )
    path = cut(path)
    nodes = cut(path.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("prev_fp").alias("prev_fp"), F.min("prev_chain").alias("prev_chain"), F.max("words").alias("words")))
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("prev_fp").alias("fp"), F.col("prev_chain").alias("chain"))
    children = nodes.where("depth > 0").groupBy(up.alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.withColumns({"key": F.struct(*_KEY), "up": up, "gain": (F.col("n_convs") - 1) * F.col("words")})
    nodes = cut(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    block = F.expr(f"depth div {BLOCK}")
    blocks = nodes.groupBy("conv_id", block.alias("block")).agg(F.sum("gain").alias("gains"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("earlier", F.coalesce(F.sum("gains").over(earlier), F.lit(0))))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = (
        nodes.select("key", "conv_id", "depth", "gain", block.alias("block"))
        .withColumn("inside", F.coalesce(F.sum("gain").over(inside), F.lit(0)))
        .join(blocks.select("conv_id", "block", "earlier"), ["conv_id", "block"])
        .select("key", (F.col("inside") + F.col("earlier")).alias("above"))
    )
    owned = blocks.groupBy("conv_id").agg(F.sum("gains").alias("gains"), F.sum("leaves").alias("leaves"))
    below = labelled(path, owned, "conv_id").groupBy(*_KEY).agg(F.coalesce(F.sum("gains"), F.lit(0)).alias("gains"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"))
    last = path.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("end")).select("end.*", "conv_id")
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return (
        labelled(nodes.select("key", "up", "conv_id", "depth", "n_convs", "n_children"), parents, "up")
        .join(above, "key")
        .join(below.select(F.struct(*_KEY).alias("key"), "gains", "leaves"), "key")
        .join(_digests(last).select(F.struct(*_KEY).alias("key"), "ends_sha256"), "key", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("gains") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    )


def forked(conversations: DataFrame, block: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations rebuilt as forks, for :func:`trie`.

    Conversation c has the first h turns of c - c % ``block`` and then its own after its first h,
    where h is the crc32 of c in decimal modulo ``most`` + 1. Rows without an id take no part; null
    roles and texts are empty; turns that tie go by role and text.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    everyone = cut(turns.select("conv_id").distinct())
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lent = turns.where(F.col("conv_id") % block == 0).withColumn("at", F.row_number().over(place)).where(F.col("at") <= most)
    heads = (
        everyone.select(F.col("conv_id").alias("own_id"), (F.col("conv_id") - F.col("conv_id") % block).alias("conv_id"), taken.alias("taken"))
        .join(lent, "conv_id")
        .where(F.col("at") <= F.col("taken"))
        .select(F.col("own_id").alias("conv_id"), F.lit(0).alias("part"), F.lit(0).alias("skip"), F.col("at").cast("long").alias("turn"), "role", "text")
    )
    own = turns.select("conv_id", F.lit(1).alias("part"), taken.alias("skip"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return heads.union(own), everyone


def forked_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of :func:`forked` conversations. An empty table gives no nodes; other columns are not read."""
    return trie(*forked(conversations))
