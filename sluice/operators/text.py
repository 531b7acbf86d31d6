"""Text: tokens, TF-IDF search, chunks, near-duplicates, guardrails, ranking metrics, sentiment, costs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.graph import connected_components
from sluice.core.session import SMALL_ROWS, counted_small, cut, shared_dir
from sluice.functions.privacy import PII, SECRETS

WORD = r"[a-z0-9]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` reads it in a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n, total``: words of each text, counted before they leave their row."""
    w = df.select(F.col(key).alias("key"), words(F.col(text)).alias("w"))
    return w.select("key", F.size("w").alias("total"), F.explode("w").alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"), F.max("total").alias("total"))


def bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, total, terms`` (``term, n``) of every key's words, counted before they leave their row and written once.

    Only rows of a key that has several are brought together, after their terms are added up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.list_flatten(batch.column(1)).dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            found, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(found, np.arange(len(sizes) + 1) * kinds).astype(np.int32)
            terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(found % kinds)), pa.array(n)], ["term", "n"])
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), terms)], ["key", "total", "terms"])

    spark, home = df.sparkSession, f"{shared_dir(df.sparkSession)}/terms-{uuid.uuid4().hex}"
    kind = df.schema[key].dataType.simpleString()
    df.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).mapInArrow(count, f"key {kind}, total long, terms array<struct<term: string, n: bigint>>").write.parquet(home)
    rows = spark.read.parquet(home)
    repeated = counted_small(rows.groupBy(F.col("key").alias("again")).agg(F.count("*").alias("rows")).where("rows > 1").select("again"))
    if repeated.isEmpty():
        return rows
    same = rows["key"].eqNullSafe(repeated["again"])
    met = rows.join(repeated, same, "left_semi").select("key", F.explode("terms").alias("t")).groupBy("key", "t.term").agg(F.sum("t.n").alias("n"))
    return rows.join(repeated, same, "left_anti").unionByName(met.groupBy("key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("term", "n")).alias("terms")))


def norms(counted: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """``key, norm`` of the TF-IDF weights of :func:`bags`: share in the text times ln((1 + N) / (1 + df)) + 1.

    ``df`` is ``term, df``. The terms in most texts are broadcast, as many as may be; occurrences of the
    others alone meet their frequency by a shuffle.
    """
    steps = {r["step"]: r["terms"] for r in df.groupBy(F.floor(F.log2("df")).alias("step")).agg(F.count("*").alias("terms")).collect()}
    least, held = 1 + max(steps, default=0), 0
    while least > 0 and held + steps.get(least - 1, 0) <= SMALL_ROWS:
        least, held = least - 1, held + steps.get(least - 1, 0)
    known = df.select("term", _idf(n_docs).alias("idf"), F.floor(F.log2("df")).alias("step"))
    often = F.broadcast(cut(known.where(F.col("step") >= least).drop("step")))
    each = counted.where("key is not null").select("key", "total", F.explode("terms").alias("t")).select("key", F.col("t.term").alias("term"), (F.col("t.n") / F.col("total")).alias("share"))
    squares = each.join(often, "term")
    if least > 0:
        squares = squares.unionByName(each.join(often, "term", "left_anti").join(known.where(F.col("step") < least).drop("step").hint("merge"), "term"))
    return squares.groupBy("key").agg(F.sqrt(F.sum((F.col("share") * F.col("idf")) ** 2)).alias("norm"))


def _idf(n_docs: int) -> Column:
    return F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1


#: Numbers of a table of terms by queries, and products at a time in a task.
_ASKED = 1 << 22
#: Pairs that a task holds before it leaves those that others have beaten.
_HELD = 100_000


def _leading(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among a query's first ``k`` once scores are rounded to nine digits, and the least score for that."""
    by = np.lexsort((key, -score, query))
    q, s = query[by], score[by]
    place = np.arange(len(by))
    start = np.searchsorted(q, np.arange(n))
    least = np.zeros(n)
    enough = np.diff(np.r_[start, len(q)]) >= k
    least[enough] = s[start[enough] + k - 1] - 1.01e-9
    # Of equal scores the k smallest keys.
    new = np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])][: len(q)]
    run = np.maximum.accumulate(np.where(new, place, 0))
    return by[(s >= least[q]) & (place - run < k)], least


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int) -> DataFrame:
    """``query, rank, key, score``: the ``k`` documents of greatest cosine per query, ties to the smaller key.

    Words are counted once. A text keeps its terms that queries ask for, and a task hands on the pairs
    that may lead of those it has; queries go to the tasks by blocks of bounded size.
    """
    spark = docs.sparkSession
    counted, n = bags(docs, key, text), docs.count()
    df = cut(counted.select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.count("*").alias("df")))
    asked = term_counts(queries, query_key, query_text).join(df, "term").select(F.col("key").alias("query"), "term", (F.col("n") * _idf(n)).alias("q"), _idf(n).alias("idf"))
    asked = cut(asked.withColumn("q", F.col("q") / F.sqrt(F.sum(F.col("q") ** 2).over(Window.partitionBy("query"))) * F.col("idf")))
    size = asked.agg(F.count_distinct("term") * F.count_distinct("query")).first()[0]
    blocks = 1 + size // _ASKED
    lengths = norms(counted, df, n)
    kind, query_kind = counted.schema["key"].dataType.simpleString(), asked.schema["query"].dataType.simpleString()

    def block(part: DataFrame) -> DataFrame:
        own = part.select("query", "term", "q").toArrow().combine_chunks()
        names, terms = pc.unique(own["query"]), pc.unique(own["term"])
        table = np.zeros((len(terms), len(names)))
        table[pc.index_in(own["term"], terms).to_numpy(), pc.index_in(own["query"], names).to_numpy()] = own["q"].to_numpy()
        shared = spark.sparkContext.broadcast((names, terms, table))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column(2).flatten()
                at = pc.index_in(held.field(0), shared.value[1])
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
                use = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                at, times, row = at.take(pa.array(use)).to_numpy(), held.field(1).to_numpy()[use], row[use]
                by = np.lexsort((at, row))
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                out = pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(at[by].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(times[by].astype(np.int64)))], ["key", "total", "at", "n"])
                yield out.filter(pc.greater(pc.list_value_length(out.column(2)), 0))

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, _, table = shared.value
            least = np.zeros(len(names))
            query, score, keys = [np.empty(0, np.int64)], [np.empty(0)], []

            def settle() -> None:
                nonlocal query, score, keys, least
                q, s, held = np.concatenate(query), np.concatenate(score), pa.concat_arrays(keys)
                kept, least = _leading(q, s, pc.rank(held, "ascending", tiebreaker="dense").to_numpy().astype(np.int64), k, len(names))
                query, score, keys = [q[kept]], [s[kept]], [held.take(pa.array(kept))]

            for batch in batches:
                sizes = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
                at, weight = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy() / np.repeat(batch.column(1).to_numpy(), sizes)
                norm, starts = batch.column(4).to_numpy(), np.r_[0, np.cumsum(sizes)]
                first, most = 0, max(1, _ASKED // max(1, len(names)))
                while first < batch.num_rows:
                    last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
                    a, b = starts[first], starts[last]
                    dots = np.add.reduceat(table[at[a:b]] * weight[a:b, None], starts[first:last] - a) / norm[first:last, None]
                    row, q = np.nonzero((dots > 0) & (dots >= least))
                    query.append(q)
                    score.append(dots[row, q])
                    keys.append(batch.column(0).take(pa.array(row + first)))
                    if sum(map(len, query)) > _HELD:
                        settle()
                    first = last
            if keys:
                settle()
                yield pa.record_batch([names.take(pa.array(query[0])), keys[0], pa.array(score[0])], ["query", "key", "score"])

        kept = counted.mapInArrow(keep, f"key {kind}, total long, at array<int>, n array<bigint>").join(lengths, "key")
        return kept.select("key", "total", "at", "n", "norm").mapInArrow(lead, f"query {query_kind}, key {kind}, score double")

    found = block(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == 0))
    for i in range(1, blocks):
        found = found.union(block(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    scores = found.select("query", "key", F.round("score", 9).alias("score"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def chunk_words(text: Column, size: int, overlap: int) -> Column:
    """An array of chunks of ``size`` words that share ``overlap``; a short last one is kept."""
    step = max(1, size - min(overlap, size - 1))
    split = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")

    def cut(w: Column) -> Column:
        last = F.greatest(F.size(w) - F.lit(min(overlap, size - 1)) - 1, F.lit(0))
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.floor(last / step).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))

    return let(split, cut)


def chunk_chars(text: Column, size: int, overlap: int) -> Column:
    """Chunks of ``size`` characters, each starting ``size - overlap`` after the one before."""
    step = size - overlap
    n = F.length(text)
    count = F.greatest(F.ceil((n - F.lit(overlap)) / step), F.when(n > 0, 1).otherwise(0)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, group, copies``: rows whose text, with case and white space evened out, another row has."""
    even = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    hashed = df.select(F.col(key).alias("key"), F.sha2(even, 256).alias("h"))
    groups = hashed.groupBy("h").agg(F.count("*").alias("copies"), F.min("key").alias("group")).where("copies > 1")
    return hashed.join(groups, "h").select("key", "group", "copies")


def shared_shingles(df: DataFrame, key: str, text: str, n: int = 5, least: float = 0.8) -> DataFrame:
    """``key, component``: texts chained by word-shingle similarity of ``least`` or more.

    Texts of one shingle set are one representative. Each orders its distinct shingles by rarity and
    posts the prefix of which two similar texts must share one; candidates are equi-joined on those
    and verified with the whole sets, so nothing is lost. A text of fewer words is one shingle.
    """
    each = lambda w: F.when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(n)), " "))))
    sets = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(let(words(F.col(text), r"[^\s]+"), each))).alias("set"))
    sets = sets.withColumn("sig", F.xxhash64("set"))
    firsts = sets.groupBy("sig").agg(F.min("key").alias("rep"), F.first("set").alias("set"))
    freq = firsts.select(F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    ranked = firsts.select("rep", F.size("set").alias("m"), F.explode("set").alias("g")).join(freq, "g")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "g"))
    prefix = ranked.withColumn("at", place).where(F.col("at") <= F.col("m") - F.ceil(F.col("m") * least) + 1).where("df > 1")
    a, b = prefix.select(F.col("rep").alias("a"), "g", F.col("m").alias("ma")), prefix.select(F.col("rep").alias("b"), "g", F.col("m").alias("mb"))
    pairs = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.col("ma") >= least * F.col("mb")) & (F.col("mb") >= least * F.col("ma"))).select("a", "b").distinct()
    whole = firsts.select("rep", "set")
    checked = pairs.join(whole.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(whole.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    links = checked.where(same >= least * (F.size("sa") + F.size("sb") - same)).select("a", "b")
    found = connected_components(links, "a", "b")
    return sets.select("key", "sig").join(firsts.select("sig", "rep"), "sig").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))


def containment(df: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, n: int = 8) -> DataFrame:
    """``key, item, share``: which share of an item's word n-grams a text holds, where any."""

    def grams(frame: DataFrame, k: str, t: str) -> DataFrame:
        each = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))).otherwise(F.array().cast("array<bigint>"))
        return frame.select(F.col(k).alias("k"), F.explode(F.array_distinct(let(words(F.col(t)), each))).alias("g"))

    # Few items: their n-grams go to the texts', which stay where they are but for the hits.
    own = counted_small(grams(items, item_key, item_text))
    sizes = own.groupBy("k").agg(F.count("*").alias("m"))
    hits = grams(df, key, text).withColumnRenamed("k", "key").join(own.withColumnRenamed("k", "item"), "g").groupBy("key", "item").agg(F.count("*").alias("n"))
    return hits.join(sizes, hits["item"] == sizes["k"]).select("key", "item", F.round(F.col("n") / F.col("m"), 6).alias("share"))


# Phrases that try to override instructions, words of toxicity, and sentiment lexicons.
INJECTION = ("ignore previous instructions", "ignore all previous", "disregard the above", "you are now", "developer mode", "reveal your system prompt", "print your instructions", "act as dan")
POSITIVE = ("good", "great", "excellent", "love", "easy", "fast", "helpful", "amazing", "best", "happy")
NEGATIVE = ("bad", "slow", "terrible", "hate", "hard", "broken", "awful", "worst", "confusing", "poor")
NEGATORS = ("not", "no", "never", "hardly")


def guardrails(text: Column, max_chars: int = 4000, blocked: tuple[str, ...] = ()) -> Column:
    """``struct(action, reasons, text)``: rules in order, each on the text the one before left; the
    strongest action wins; secrets block and are redacted all the same."""
    lower = F.lower(text)
    reasons, out = [F.when(F.length(text) > max_chars, "length"), F.when(_any(lower, INJECTION), "injection")], text
    if blocked:
        reasons.append(F.when(_any(lower, blocked), "blocklist"))
    rules = [("pii", PII[name], f"[{name.upper().replace(' ', '_')}]") for name in ("Email", "SSN", "Credit Card")] + [("secret", pattern, f"[{name.upper()}]") for name, pattern in SECRETS.items()]

    def redact(left: list, out: Column, pii: Column, secret: Column) -> Column:
        """The rules left, each tried once on the text so far: what it changes, it found."""
        if not left:
            return verdict(out, pii, secret)
        (kind, pattern, mark), *others = left
        after = let(F.struct(F.regexp_replace(out, pattern, mark).alias("text"), out.alias("before")), lambda v: F.struct(v["text"].alias("text"), (v["text"] != v["before"]).alias("hit")))
        return let(after, lambda v: redact(others, v["text"], pii | v["hit"] if kind == "pii" else pii, secret | v["hit"] if kind == "secret" else secret))

    def verdict(out: Column, pii: Column, secret: Column) -> Column:
        found = F.filter(F.array(*reasons, F.when(pii, "pii"), F.when(secret, "secret")), lambda r: r.isNotNull())
        return let(found, lambda f: F.struct(F.when(F.size(F.filter(f, lambda r: r != "pii")) > 0, "BLOCK").when(pii, "REDACT").otherwise("ALLOW").alias("action"), f.alias("reasons"), out.alias("text")))

    return redact(rules, out, F.lit(False), F.lit(False))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def sentiment(text: Column) -> Column:
    """Lexicon sum with negation: a negator among the two words before flips a word's sign."""
    sign = lambda x: F.when(x.isin(*POSITIVE), 1).when(x.isin(*NEGATIVE), -1).otherwise(0)

    def total(w: Column) -> Column:
        before = lambda i, k: F.coalesce(F.when(i > k, F.try_element_at(w, i - k).isin(*NEGATORS)), F.lit(False))
        scored = F.transform(w, lambda x, i: F.when(before(i + 1, 1) | before(i + 1, 2), -sign(x)).otherwise(sign(x)))
        return F.aggregate(scored, F.lit(0), lambda a, b: a + b)

    return let(words(text, "[a-z']+"), total)


def rank_metrics(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``query, hit, recall, precision, mrr, ndcg`` at ``k`` of results (query, rank, key) against gold (query, key).

    Precision divides by what was retrieved, as many as there are.
    """
    top = results.where(F.col("rank") <= k).join(gold.withColumn("good", F.lit(1)), ["query", "key"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    got = top.groupBy("query").agg(F.sum("good").alias("hits"), F.count("*").alias("retrieved"), F.max(F.when(F.col("good") == 1, 1 / F.col("rank"))).alias("mrr"), F.sum(F.col("good") / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = gold.groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = wanted.join(got, "query", "left").na.fill(0, ["hits", "retrieved", "mrr", "dcg"])
    return out.select("query", (F.col("hits") > 0).cast("int").alias("hit"), (F.col("hits") / F.col("n")).alias("recall"), F.when(F.col("retrieved") > 0, F.col("hits") / F.col("retrieved")).otherwise(0.0).alias("precision"), "mrr", (F.col("dcg") / ideal).alias("ndcg"))


def token_costs(calls: DataFrame, prices: DataFrame, model: str, prompt: str, answer: str) -> DataFrame:
    """Calls with ``tokens_in, tokens_out, cost``: a token is four characters, rounded up; prices are per 1000."""
    t = lambda c: F.ceil(F.length(F.coalesce(F.col(c), F.lit(""))) / 4).cast("long")
    out = calls.withColumn("tokens_in", t(prompt)).withColumn("tokens_out", t(answer)).join(F.broadcast(prices), model, "left")
    return out.withColumn("cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1000)


def keyword_recall(output: Column, expected: Column) -> Column:
    """Share of expected keywords that stand in the output, in any case; 1 where none is expected."""
    n = F.size(expected)
    return F.when(n > 0, F.size(F.filter(expected, lambda w: F.contains(F.lower(output), F.lower(w)))) / n).otherwise(1.0)


#: Rows of a block that one task holds of each of two parts.
CACHE_PART = 16_384
#: Scores that a task has at a time, and candidates whose exact score it takes at a time.
_SCORES = 1 << 22
_EXACT = 1 << 17
#: Scores are rounded to six digits; what a product by blocks is off by is far below a hundredth of that.
_NEAR = 1.01e-6


def _records(group: np.ndarray, order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rows whose key is smaller than the keys of all rows before them in their group, by ``order`` and then ``key``."""
    by = np.lexsort((key, order, group))
    # A later group's values are below those of all groups before it, so the smallest so far starts anew.
    value = key[by] - group[by].astype(np.int64) * (int(key.max()) + 1 if len(key) else 1)
    return by[np.r_[True, value[1:] < np.minimum.accumulate(value)[:-1]][: len(by)]]


def _cache_fronts(v: np.ndarray, at: np.ndarray, key: np.ndarray, asking: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, source, score`` of the asked rows that may be the best of those before each asking row.

    Rows are places in ``v``; ``at`` and ``key`` are ranks. A row is left out only if one before the same
    rows, of a smaller key and as good a score, is there.
    """
    # Of equal vectors a later one counts only if its key is smaller.
    _, same = np.unique(np.ascontiguousarray(v[asked]).view(np.dtype((np.void, 8 * v.shape[1]))).ravel(), return_inverse=True)
    asked = asked[_records(same, at[asked], key[asked])]
    asked = asked[np.argsort(at[asked], kind="stable")]
    asking = asking[np.argsort(at[asking], kind="stable")]
    before = np.searchsorted(at[asked], at[asking])
    asking, before, others = asking[before > 0], before[before > 0], np.ascontiguousarray(v[asked].T)
    odd = np.isnan(v).any()
    start = 0
    while start < len(asking):
        stop = start + min(4096, max(1, _SCORES // int(before[min(len(before), start + 4096) - 1])))
        rows, own = asking[start:stop], before[start:stop]
        scores = v[rows] @ others[:, : own[-1]]
        if odd:  # the greatest of all, as in Spark
            scores[np.isnan(scores)] = np.inf
        low = int(own[0])
        scores[:, low:][np.arange(low, own[-1])[None, :] >= own[:, None]] = -np.inf
        best = scores.max(1)
        i, j = np.nonzero(scores >= np.where(np.isinf(best), best, best - _NEAR)[:, None])
        for k in range(0, len(i), _EXACT):
            a, b = rows[i[k : k + _EXACT]], asked[j[k : k + _EXACT]]
            exact = np.zeros(len(a))
            for c in range(v.shape[1]):  # in the order of components
                exact += v[a, c] * v[b, c]
            front = _records(a, -np.where(np.isnan(exact), np.inf, exact), key[b])
            yield a[front], b[front], exact[front]
        start = stop


def semantic_cache(df: DataFrame, key: str, order: str, vector: str, by: list[str], threshold: float, part: int = CACHE_PART) -> DataFrame:
    """``key, hit, source, score``: the most similar earlier row of the same block at or above the threshold.

    Vectors are compared by cosine with earlier rows of ``by`` only, ties to the smaller key. A block is
    dealt over parts of about ``part`` rows, and every two parts meet in a task of their own that hands on
    the few sources of each row that may be the best; no pairs are emitted. The products still grow with
    the square of a block. Vectors of several lengths or with nulls don't compare.
    """
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    unit = let(norm, lambda n: F.transform(vector, lambda x: x / n))
    whole = F.col("v").isNotNull() & F.col("at").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0)
    rows = df.select(*by, F.col(key).alias("key"), F.col(order).alias("at"), unit.cast("array<double>").alias("v"))
    full = rows.where(" and ".join(f"`{c}` is not null" for c in by) or "true").where(whole).withColumn("dim_", F.size("v"))
    of_block = [*by, "dim_"]
    parts = counted_small(full.groupBy(*of_block).agg(F.expr(f"1 + (count(*) - 1) div {part}").alias("parts_")))
    tasks = parts.agg(F.sum(F.expr("parts_ * (parts_ + 1)"))).first()[0] or 1
    mine = F.pmod(F.xxhash64("key", "at"), F.col("parts_")).alias("mine_")
    dealt = full.join(parts, of_block).select(*of_block, "key", "at", "v", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_") - 1)).alias("other_"))
    pair = [F.least("mine_", "other_").alias("low_"), F.greatest("mine_", "other_").alias("high_")]
    dealt = dealt.select(*of_block, *pair, "mine_", "key", "at", "v").repartition(min(tasks, 20_000), *of_block, "low_", "high_")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        v = pc.list_flatten(rows["v"]).to_numpy().reshape(rows.num_rows, -1)
        at, place = (pc.rank(rows[c].combine_chunks(), "ascending", tiebreaker="dense").to_numpy().astype(np.int64) for c in ("at", "key"))
        mine = rows["mine_"].to_numpy()
        one, two = np.flatnonzero(mine == mine.min()), np.flatnonzero(mine != mine.min())
        if rows["low_"][0] == rows["high_"][0]:
            sides = [(one, one)]
        else:
            sides = [(one, two), (two, one)] if len(two) else []
        found = [x for a, b in sides for x in _cache_fronts(v, at, place, a, b)]
        row, source, score = (np.concatenate([x[k] for x in found]) if found else np.empty(0, t) for k, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"key": rows["key"].take(pa.array(row)), "source": rows["key"].take(pa.array(source)), "score": pa.array(score)})

    kind = rows.schema["key"].dataType.simpleString()
    fronts = dealt.groupBy(*of_block, "low_", "high_").applyInArrow(compare, f"key {kind}, source {kind}, score double")
    alone = rows.select("key", F.lit(None).cast(kind).alias("source"), F.lit(None).cast("double").alias("score"))
    pairs = alone.union(fronts.select("key", "source", F.round("score", 6).alias("score")))
    best = pairs.groupBy("key").agg(F.max_by(F.struct("source", "score"), F.struct("score", -F.col("source"))).alias("m"))
    hit = F.coalesce(F.col("m.score") >= threshold, F.lit(False))
    return best.select("key", hit.alias("hit"), F.when(hit, F.col("m.source")).alias("source"), F.when(hit, F.col("m.score")).alias("score"))
