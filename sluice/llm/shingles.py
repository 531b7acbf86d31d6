"""Near-duplicates by word shingles: all pairs of texts whose shingle sets reach a Jaccard similarity.

Every distinct shingle set has a MinHash sketch cut into bands, and sets that agree in a band are
candidates. At a similarity of 0.8 a pair shares none of the 24 bands of five rows with a
probability of 0.00007. Each candidate is verified on the shingles themselves. A bucket first links
its members to its smallest one. Only where verified links leave it in several components does it
come together once more, in blocks of bounded size: members outside the block's largest component
are compared with all of other components, but for those that the number of shingles a set shares
with nothing else in the block rules out. Links alone leave a block, so every pair of a bucket is
joined, was compared or cannot be alike, and no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.graph import connected_components
from sluice.core.session import cut
from sluice.llm.common import as_bytes, few, labelled, texts

SEED = 42
WORDS = 5
LEAST = 0.8
BANDS = 24
ROWS = 5
#: Shingles that are hashed for all rows at a time.
CHUNK = 4096
#: Shingles of the members of a bucket that one block holds; larger buckets are dealt over pairs of parts.
BLOCK = 2_000_000
_RNG = np.random.default_rng(SEED)
_TIMES = (_RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist())], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """One signed 64-bit value a band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), CHUNK):
        np.minimum(least, (found[None, start : start + CHUNK] * _TIMES + _PLUS).min(1), out=least)
    raw = least.tobytes()
    size = ROWS * 8
    values = [xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)]
    return np.array(values, np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, whole`` (a hash of the whole shingle set) and ``bands`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, made = np.empty(batch.num_rows, np.uint64), []
            for start, part in texts(batch.column(1)):
                for k, text in enumerate(part, start):
                    found = shingles(text, words)
                    whole[k] = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                    made.append(bands(found))
            yield pa.record_batch([batch.column(0), pa.array(whole.view(np.int64)), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "whole", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, whole long, bands array<long>")


def verified(pairs: DataFrame, named: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs ``a, b`` whose texts in ``named`` (``node, text``) have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            held, known = None, np.empty(0, np.uint64)
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = left[k].as_py() or b"", right[k].as_py() or b""
                if x != held:
                    held, known = x, shingles(x, words)
                keep[k] = jaccard(known, shingles(y, words)) >= least
            mask = pa.array(keep)
            yield pa.record_batch([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    kind = named.schema["node"].dataType.simpleString()
    both = pairs.join(named.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").join(
        named.select(F.col("node").alias("a"), F.col("text").alias("left")), "a"
    )
    return both.select("a", "b", "left", "right").mapInArrow(run, f"a {kind}, b {kind}")


def shingle_sets(named: DataFrame, words: int) -> DataFrame:
    """``node, n, shingles`` (64-bit hashes, sorted) of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in texts(batch.column(1)):
                found = [shingles(t, words) for t in part]
                yield pa.record_batch([batch.column(0).slice(start, len(part)), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "n", "shingles"])

    return named.select("node", "text").mapInArrow(run, f"node {named.schema['node'].dataType.simpleString()}, n long, shingles binary")


def _block_links(labels: list[int], parts: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between members of a block whose labels differ, at least a forest of them."""
    _, label = np.unique(labels, return_inverse=True)
    if not label.any():
        return []
    crossing = parts.min() != parts.max()
    size = np.array([len(x) for x in sets])
    start = np.r_[0, np.cumsum(size)[:-1]]
    _, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.add.reduceat((count[flat] > 1).astype(np.int64), start)
    found: list[tuple[int, int]] = []
    strays = np.flatnonzero(label != np.bincount(label).argmax())
    waiting = np.zeros(len(sets), bool)
    waiting[strays] = True
    here = np.zeros(len(count), bool)
    for x in strays.tolist():
        waiting[x] = False
        # No overlap is larger than what either set shares with anything here.
        most = np.minimum(shared, shared[x])
        open_ = (label != label[x]) & ~waiting & (most / (size + size[x] - most) >= least)
        if crossing:
            open_ &= parts != parts[x]
        if not open_.any():
            continue
        here[flat[start[x] : start[x] + size[x]]] = True
        both = np.add.reduceat(here[flat], start, dtype=np.int64)
        here[flat[start[x] : start[x] + size[x]]] = False
        for y in np.flatnonzero(open_ & (both / (size + size[x] - both) >= least)).tolist():
            if label[x] != label[y]:
                found.append((x, y))
                label[label == label[y]] = label[x]
    return found


def block_links(blocks: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` within blocks ``value, block``; each row has its ``part, node, component, shingles``."""

    def links(rows: list) -> pa.RecordBatch:
        nodes = np.array([r[2] for r in rows], np.int64)
        found = np.array(_block_links([r[3] for r in rows], np.array([r[1] for r in rows]), [np.frombuffer(r[4], np.uint64) for r in rows], least), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(nodes[found[:, k]]) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if row[0] != at and rows:
                    yield links(rows)
                    rows = []
                at = row[0]
                rows.append(row)
        if rows:
            yield links(rows)

    dealt = blocks.select(F.xxhash64("value", "block").alias("key"), "part", "node", "component", "shingles")
    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: the smallest id that links of the similarity reach.

    An id stands for one text: rows that share an id need the same text. Null texts are empty, and
    texts without words are alike.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    made = cut(sketches(docs, id_col, text_col, words))
    # Sets are known by their hash; the smallest id with a set stands for its text.
    sets = made.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    buckets = cut(sets.select(F.col("whole").alias("node"), F.explode("bands").alias("value")))
    shared = buckets.groupBy("value").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1")
    stars = cut(buckets.join(shared, "value").where("a <> node").select("value", "a", F.col("node").alias("b")))
    ends = stars.select(F.col("b").alias("whole")).union(stars.select(F.col("a").alias("whole"))).distinct()
    firsts = sets.join(ends, "whole", "left_semi").select("whole", F.col("doc_id").alias("first_id"))
    named = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).join(few(firsts), "first_id")
    named = cut(named.select(F.col("whole").alias("node"), "text").dropDuplicates(["node"]))
    first = cut(verified(stars.select("a", "b").distinct(), named, words, least))
    linked = connected_components(first, "a", "b")
    members = stars.select("value", F.col("b").alias("node")).union(stars.select("value", "a").distinct())
    members = members.join(linked, "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    # A bucket of two was compared as a star; one of a single component needs no more links.
    open_ = members.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    apart = cut(members.join(open_.where("low <> high and members > 2").select("value"), "value"))
    whole = cut(shingle_sets(named.join(apart.select("node").distinct(), "node", "left_semi"), words))
    parts = apart.join(whole.select("node", "n"), "node").groupBy("value").agg(F.expr(f"1 + sum(n) div {block}").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = apart.join(parts, "value").select("value", "node", "component", "parts", part.alias("part"), other)
    # Every two parts meet in one block; with one part the block is the bucket.
    dealt = dealt.withColumn("block", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
    more = block_links(dealt.join(whole.select("node", "shingles"), "node"), least)
    linked = connected_components(first.union(more), "a", "b")
    reach = sets.select("whole", "doc_id").join(linked.withColumnRenamed("node", "whole"), "whole", "left").select("whole", "doc_id", F.coalesce("component", "whole").alias("component"))
    smallest = reach.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = cut(reach.join(smallest, "component").select("whole", "component_id"))
    return labelled(made.select("doc_id", "whole"), known, "whole").select("doc_id", "component_id")


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of the components that two partitions of the same ids give together."""
    left = one.select("doc_id", F.col("component_id").alias("a")).distinct()
    both = cut(left.join(other.select("doc_id", F.col("component_id").alias("b")).distinct(), "doc_id"))
    linked = connected_components(both.select("a", "b").distinct(), "a", "b")
    return labelled(both.select("doc_id", "a"), linked.withColumnRenamed("node", "a"), "a").select("doc_id", F.coalesce("component", "a").alias("component_id"))
