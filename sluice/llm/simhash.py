"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints at a distance of three or
less have a segment that differs in one bit at most, so they meet under one of the 32 one-wildcard
variants of that segment. Variants are equality-joined by a shuffle on the variant, every meeting is
verified on all 64 bits, and a bucket hands on a spanning forest of its links in place of all pairs:
the components stay the same and a bucket of n fingerprints gives fewer than n links.
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
from sluice.llm.common import few, labelled, texts

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text; zero for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [digest(joined[a:b], seed) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist())]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * seen > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed long with the fingerprint's bits) of every whole text; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty(batch.num_rows, np.uint64)
            for start, part in texts(batch.column(1)):
                found[start : start + len(part)] = [fingerprint(t, words) for t in part]
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """The 64 one-wildcard variants of every distinct fingerprint as ``variant, fp``.

    The variant is the wildcard's place (0 to 63, which names the segment too) above the segment
    with that bit cleared.
    """
    segment = F.when(F.col("place") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    clear = F.expr("~shiftleft(1L, cast(place % 32 as int))")
    return (
        prints.select("fp")
        .distinct()
        .select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
        .select(F.expr("shiftleft(cast(place as bigint), 32)").bitwiseOR(segment.bitwiseAND(clear)).alias("variant"), "fp")
    )


def _forest(bucket: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links within one bucket."""
    left, right, rest = [], [], bucket
    while len(rest) > 1:
        frontier, rest = [rest[:1]], rest[1:]
        while frontier and len(rest):
            for x in frontier.pop():
                near = np.bitwise_count(rest ^ x) <= most
                if near.any():
                    new, rest = rest[near], rest[~near]
                    left.append(np.full(len(new), x))
                    right.append(new)
                    frontier.append(new)
    return left, right


def _links(variant: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets, sorted by variant and then fingerprint."""
    starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    sizes = np.diff(np.r_[starts, len(variant)])
    place = (variant[starts] >> 32).astype(np.int64)
    # Equal segments meet under every wildcard; the first one serves them, so elsewhere both values of the bit must occur.
    bit = (fp >> (variant >> 32).astype(np.uint64)) & np.uint64(1)
    ones = np.add.reduceat(bit.astype(np.int64), starts)
    use = (sizes > 1) & ((place % 32 == 0) | ((ones > 0) & (ones < sizes)))
    two = starts[use & (sizes == 2)]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most]
    left, right = [fp[two]], [fp[two + 1]]
    for i in np.flatnonzero(use & (sizes > 2)):
        a, b = _forest(fp[starts[i] : starts[i] + sizes[i]], most)
        left += a
        right += b
    return np.concatenate(left), np.concatenate(right)


def near_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints whose components are those of all pairs within ``most`` bits."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find distances up to 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_v, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in _ended(batches):
            if batch is None:
                v, f, held_v, held_f = held_v, held_f, held_v[:0], held_f[:0]
            else:
                v = np.concatenate([held_v, batch.column(0).to_numpy()])
                f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
                whole = int(np.searchsorted(v, v[-1])) if len(v) else 0
                v, held_v, f, held_f = v[:whole], v[whole:], f[:whole], f[whole:]
            if len(v):
                a, b = _links(v, f, most)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
                yield pa.record_batch([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])

    return variants(prints).repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(run, "a long, b long")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links of ``most`` bits or fewer reach, the document's
    own included. Texts that are null, empty or without words have the fingerprint zero and link
    like any other. Repeated rows stay repeated; a null id stays null and never is the smallest.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    linked = connected_components(near_links(prints, most), "a", "b")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    reach = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    least = reach.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = cut(reach.join(least, "component").select("fp", "component_id"))
    return labelled(prints, known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, text, row`` of every row: the key orders rows by id, null ids last, and tells rows of one id and
    different texts apart."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    return docs.select(key.alias("key"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))


def firsts(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is their component's id in ``found``, each key once.

    Rows that stay as they are aren't moved as long as the others are few; repeated keys are
    grouped apart.
    """
    dropped = few(found.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct())
    repeated = few(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    kept = keyed.join(dropped, "key", "left_anti").select("key", "row")
    once = kept.join(repeated, "key", "left_anti").select("row.*")
    again = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.union(again.select("row.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """One row of each near-duplicate component, that of the smallest id.

    Rows are told apart by id and text: rows that share an id but no text are judged on their own,
    rows without an id take part and stay only where no row of the component has one. Of rows
    alike in id and text one stays.
    """
    keyed = row_keys(docs, id_col, text_col)
    return firsts(keyed, near_duplicates(keyed, "key", "text", words, most))
