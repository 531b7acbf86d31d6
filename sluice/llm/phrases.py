"""Collocations of words, mined by pivot partitioning.

A first pass counts words. The second rewrites texts into fragments: every occurrence of a word is
the pivot of the words around it that are more frequent than it, as far as a phrase can reach;
rarer words are blanks and end the fragment. A phrase's occurrence so lies in the one fragment of
its rarest word (the first, if that word recurs in it), fragments are routed by language and pivot,
and each task counts the phrases that its pivots own. Phrases never meet in a second shuffle.

Fragments hold at most ``2 * longest - 1`` words. Alike ones are summed for each slice of text
before they are shuffled, so a pivot that occurs in a third of all text sends few rows: no more
than a few words are as frequent as it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import cut
from sluice.llm.common import labelled, slices

#: Pieces end at these signs; words are what space and tab part.
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
#: Text that a worker splits at a time.
SLICE = 1 << 23
#: So many words at most have their count broadcast, 16 bytes each.
LISTED = 1_000_000
_SEED = 42


def _words(lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """The piece and the entry of every word of some texts, and the language and word of every entry."""
    low = pc.ascii_lower(pc.fill_null(text, ""))
    pieces = pc.split_pattern_regex(low, PIECE_ENDS)
    row = pc.list_parent_indices(pieces).to_numpy()
    split = pc.ascii_split_whitespace(pc.list_flatten(pieces))
    piece, found = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    held = pc.not_equal(found, "")
    piece, found = piece[held.to_numpy(zero_copy_only=False)], found.filter(held).dictionary_encode()
    langs = pc.fill_null(lang, "und").dictionary_encode()
    of = langs.indices.to_numpy()[row[piece]].astype(np.int64)
    kinds, entry = np.unique(of * max(1, len(found.dictionary)) + found.indices.to_numpy(), return_inverse=True)
    at = np.divmod(kinds, max(1, len(found.dictionary)))
    return piece, entry, langs.dictionary.take(pa.array(at[0])), found.dictionary.take(pa.array(at[1]))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        for a, b in slices(batch.column(1), SLICE):
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, word, f``: how often each lower-case word occurs in a language (``und`` if null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _sliced(batches):
            _, entry, langs, words = _words(lang, text)
            yield pa.record_batch([langs, words, pa.array(np.bincount(entry, minlength=len(words)))], ["lang", "word", "f"])

    found = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _key(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\x01"), word))


def frequent(counts: DataFrame, least: int, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted hashes and counts of the most frequent words, and whether these are all with ``least`` or more.

    If more than ``listed`` are that frequent, those that occur in the list are the ones above a
    power of two that keeps them fewer.
    """
    sizes = counts.where(F.col("f") >= least).groupBy(F.floor(F.log2("f")).alias("power")).agg(F.count("*").alias("n")).collect()
    powers = sorted(((r["power"], r["n"]) for r in sizes), reverse=True)
    total, floor = 0, None
    for power, n in powers:
        if total + n > listed:
            break
        total, floor = total + n, power
    complete = not powers or floor == powers[-1][0]
    if floor is None and not complete:
        return np.empty(0, np.int64), np.empty(0, np.int64), False
    kept = counts.where((F.col("f") >= least) & (F.floor(F.log2("f")) >= (floor or 0)))
    table = kept.groupBy(_key(F.col("lang"), F.col("word")).alias("key")).agg(F.max("f").alias("f")).toArrow()
    keys, f = table.column("key").to_numpy(), table.column("f").to_numpy()
    order = np.argsort(keys)
    return keys[order], f[order], complete


def _ranks(langs: pa.Array, words: pa.Array, keys: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rank of each entry, 0 for the most frequent, that orders any two words alike in every task; and its listed count or 0."""
    joined = pc.binary_join_element_wise(langs, words, "\x01").cast(pa.binary()).to_pylist()
    own = np.fromiter((xxhash.xxh64_intdigest(x, _SEED) for x in joined), np.uint64, len(joined)).view(np.int64)
    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
    known = np.where(keys[at] == own, f[at], 0) if len(keys) else np.zeros(len(own), np.int64)
    order = np.lexsort((own, -known))
    if len(np.unique(own)) < len(own):
        order = np.array(sorted(range(len(own)), key=lambda i: (-known[i], own[i], joined[i])), np.int64)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return rank, known


def _fragments(piece: np.ndarray, entry: np.ndarray, rank: np.ndarray, frequent_enough: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments as entries (columns from the leftmost word to the rightmost, -1 for none) and how often each occurs."""
    n, mine, fit = len(entry), rank[entry], frequent_enough[entry]
    reach, columns = longest - 1, {0: entry}
    for side in (-1, 1):
        still = fit.copy()
        for step in range(1, reach + 1):
            there = np.arange(n) + side * step
            inside = (there >= 0) & (there < n)
            there = np.clip(there, 0, max(0, n - 1))
            # An equal word on the left would be the first of its kind and own what reaches it.
            still &= inside & (piece[there] == piece) & fit[there] & ((mine[there] < mine) if side < 0 else (mine[there] <= mine))
            columns[side * step] = np.where(still, entry[there], -1)
    some = fit & ((columns[-1] >= 0) | (columns[1] >= 0))
    rows = np.stack([columns[k][some] for k in range(-reach, reach + 1)], 1)
    code = np.zeros(len(rows), np.int64)
    for k in range(rows.shape[1]):
        code = np.unique(code * (len(rank) + 1) + rows[:, k] + 1, return_inverse=True)[1]
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    return rows[first], times


def phrase_counts(docs: DataFrame, counts: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, listed: int = LISTED) -> DataFrame:
    """``lang, phrase, words, a``: phrases of 2 to ``longest`` (2 or more) words that occur ``least`` times or more in a language.

    ``counts`` has ``lang, word, f`` of the same texts. Words are ranked by their count, those that
    are not listed after all others by hash; the result doesn't depend on ``listed``.
    """
    keys, f, complete = frequent(counts, least, listed)
    shared = docs.sparkSession.sparkContext.broadcast((keys, f))
    names = [f"w{k}" for k in range(2 * longest - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _sliced(batches):
            piece, entry, langs, words = _words(lang, text)
            rank, known = _ranks(langs, words, *shared.value)
            rows, times = _fragments(piece, entry, rank, known > 0 if complete else np.ones(len(known), bool), longest)
            for at in range(0, len(rows), 100_000):
                part = rows[at : at + 100_000]
                each = [words.take(pa.array(part[:, k], mask=part[:, k] < 0)) for k in range(part.shape[1])]
                yield pa.record_batch([langs.take(pa.array(part[:, longest - 1])), *each, pa.array(times[at : at + 100_000])], ["lang", *names, "n"])

    fragments = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, " + ", ".join(f"{n} string" for n in names) + ", n long")
    pivot = longest - 1
    # Null where a word of the phrase is missing; a phrase holds the pivot, so the task of the pivot sees all its fragments.
    owned = [F.concat_ws(" ", *(F.col(n) for n in names[a : a + k])) for k in range(2, longest + 1) for a in range(pivot - k + 1, pivot + 1)]
    whole = [(a, k) for k in range(2, longest + 1) for a in range(pivot - k + 1, pivot + 1)]
    phrases = F.array(*(F.when(F.col(names[a]).isNotNull() & F.col(names[a + k - 1]).isNotNull(), F.struct(text.alias("phrase"), F.lit(k).alias("words"))) for (a, k), text in zip(whole, owned)))
    return (
        fragments.repartition("lang", names[pivot])
        .select("lang", F.col(names[pivot]).alias("pivot"), "n", F.explode(phrases).alias("p"))
        .where("p is not null")
        .groupBy("lang", "pivot", "p.phrase", "p.words")
        .agg(F.sum("n").alias("a"))
        .where(F.col("a") >= least)
        .select("lang", "phrase", "words", "a")
    )


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, listed: int = LISTED) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A to Z), cut into pieces at ``PIECE_ENDS`` and those into words at space
    and tab. A phrase of 2 to ``longest`` words that occurs ``a >= least`` times within pieces is
    scored by its weakest cut into two parts that occur ``l`` and ``r`` times:
    ``floor(1000000 * a * a / (l * r))`` in decimal arithmetic, exact for counts below 10^14 and an
    error beyond. A phrase inside a longer one that has ``inside`` per cent of its occurrences or
    more is dropped. Order: score and ``a`` descending, then phrase by UTF-8 bytes. ``n`` counts the
    words of the language.

    A null text is empty, a null language ``und``. Repeated rows count each time. Empty tables and
    languages without such a phrase give no rows. Other columns are not read.
    """
    counts = cut(word_counts(docs, lang_col, text_col))
    found = cut(phrase_counts(docs, counts, lang_col, text_col, longest, least, listed))
    key = lambda phrase: F.struct("lang", phrase.alias("phrase"))
    word = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(word, start, size), " ")
    cuts = [F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), (part(1, F.lit(k)) if left else part(k + 1, F.col("words") - k)).alias("part"))) for k in range(1, longest) for left in (True, False)]
    parts = found.select(key(F.col("phrase")).alias("whole"), "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("whole", "a", "c.k", "c.left", F.struct("whole.lang", F.col("c.part").alias("phrase")).alias("key"))
    known = counts.where(F.col("f") >= least).select(key(F.col("word")).alias("key"), "f").union(found.where(F.col("words") < longest).select(key(F.col("phrase")).alias("key"), F.col("a").alias("f")))
    sides = [F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}") for k in range(1, longest) for left in (True, False)]
    score = lambda k: F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l{k} as decimal(14,0)) * cast(r{k} as decimal(14,0)))")
    weakest = F.array_min(F.array_compact(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)))))
    scored = labelled(parts, known, "key").groupBy("whole", "a").agg(*sides).select("whole", "a", weakest.alias("w"))
    within = [F.when((F.col("words") > k) & (F.col("words") >= k + s - 1), part(s, F.lit(k))) for k in range(2, longest) for s in range(1, longest - k + 2)]
    held = found.select("lang", "a", F.explode(F.array_compact(F.array(*within, F.lit(None).cast("string")))).alias("phrase"))
    longer = held.groupBy(key(F.col("phrase")).alias("whole")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, "whole", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("whole.lang", "whole.phrase", "a", "w.l", "w.r", "w.score").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
