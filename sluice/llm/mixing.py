"""Mixing sources to target weights by entropy balancing, on DataFrame functions only.

Among all document rates whose words meet each source's target, those nearest to one copy each in
the Kullback-Leibler sense are ``min(2, exp(lambda * size))`` with one multiplier per source. The
multipliers are the root of the convex dual's gradient. Newton iterations run over the table of
distinct (source, size) pairs with their counts, never over documents; a bracket keeps every step
safe where the limit of two copies bends the curve. Rates depend on source and size only, so the
rounding into copies is a running sum over that table: a source's words miss the target by about
its longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Rates are rounded to this many parts so that running sums are exact integers.
PARTS = 1_000_000
#: Documents of one source and size that are ranked together; more are dealt over several ranks.
GROUP = 1024


def words_in(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat over the sources by code point, null last. The targets share ``share`` times all
    words by weight; one above ``limit`` times its source stops there and the excess is shared anew
    by weight until none is above. That water level is found in one pass: sources are ordered by
    the level at which they fill up, and the full ones are a prefix of that order.
    """
    everything = Window.partitionBy(F.lit(0))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(place) - 1) % len(weights)
    weight = F.coalesce(*[F.when(k == i, F.lit(float(w))) for i, w in enumerate(weights)])
    level = Window.partitionBy(F.lit(0)).orderBy("full_at", F.col("source").isNull(), "source")
    up_to = level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("full_at", limit * F.col("source_size") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything) * share)
        .withColumn("filled", limit * F.sum("source_size").over(up_to))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.sum("weight").over(up_to))
        # The level if this source and all before it are full; it is truly full if its own mark isn't above the level before it.
        .withColumn("before", F.col("open_weight") + F.col("weight"))
        .withColumn("level", (F.col("all_words") - F.col("filled") + limit * F.col("source_size")) / F.col("before"))
        .withColumn("full", F.col("full_at") <= F.col("level"))
        .withColumn("left_words", F.col("all_words") - F.sum(F.when(F.col("full"), limit * F.col("source_size")).otherwise(0)).over(everything))
        .withColumn("left_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(F.col("full"), (limit * F.col("source_size")).cast("double"))
            .otherwise(F.col("left_words") * F.col("weight") / F.col("left_weight"))
            .alias("target"),
        )
    )


def multipliers(table: DataFrame, targets: DataFrame, limit: int = LIMIT, rounds: int = 40, near: float = 1e-9) -> DataFrame:
    """``source, target, source_size, mean, multiplier`` by safeguarded Newton iterations.

    ``table`` has ``source, size, n`` with positive sizes. Sizes enter as multiples of the source's
    word-weighted mean. Multipliers that don't settle in ``rounds`` are an error. Each round sends one row per source and partition through a shuffle.
    """
    shape = table.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("mean"), F.min("size").alias("least")
    )
    ratio = F.col("target") / F.col("source_size")
    at_least = F.col("least") / F.col("mean")
    start = (
        targets.where(F.col("target") < limit * F.col("source_size"))
        .join(shape, targets["source"].eqNullSafe(shape["source"]))
        .select(targets["source"], "source_size", "target", "mean", F.when(ratio < 1, F.log(ratio)).otherwise(0.0).alias("at"), F.when(ratio < 1, F.log(ratio) / at_least).otherwise(0.0).alias("low"), F.when(ratio < 1, F.log(ratio)).otherwise(F.log(F.lit(float(limit))) / at_least).alias("high"))
    )
    state = cut(start.coalesce(1))
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(limit)), F.exp(F.col("at") * x))
        words = F.col("n") * F.col("size")
        s = state.alias("s")
        sums = (
            table.alias("t")
            .join(s, F.col("t.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < limit, words * rate * x).otherwise(0.0)).alias("slope"))
        )
        got, slope = F.col("got"), F.col("slope")
        low = F.when(got < F.col("target"), F.col("at")).otherwise(F.col("low"))
        high = F.when(got > F.col("target"), F.col("at")).otherwise(F.col("high"))
        step = F.col("at") + F.when(slope > 0, (F.col("target") - got) / slope).otherwise(F.lit(None))
        safe = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        settled = F.abs(got - F.col("target")) <= near * F.col("target")
        state = cut(
            s.join(sums, F.col("s.source").eqNullSafe(sums["source"]))
            .select("s.source", "source_size", "target", "mean", F.when(settled, F.col("at")).otherwise(safe).alias("at"), F.when(settled, F.col("low")).otherwise(low).alias("low"), F.when(settled, F.col("high")).otherwise(high).alias("high"), settled.alias("settled"))
            .coalesce(1)
        )
        if state.where("not settled").isEmpty():
            return state.select("source", "source_size", "target", "mean", F.round("at", 10).alias("multiplier"))
    raise RuntimeError(f"multipliers did not settle in {rounds} rounds")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, carry: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` for every document.

    ``taken`` is copies times size. Documents without words take part with no words. Repeated rows
    and rows that share an id or have none are documents of their own. The choice among documents
    of equal source and size goes by a hash of id and text, so reruns agree. ``carry`` is a column
    of the document that the result has as ``carried``. An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), F.abs(F.hash(F.xxhash64(id_col, text_col)) % 1_048_576).alias("deal"), *([] if carry is None else [carry.alias("carried")]))
    more = [] if carry is None else ["carried"]
    if carry is None:
        sized = cut(sized)
    table = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = cut(source_targets(table.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, limit))
    tilted = multipliers(table.where("size > 0"), targets, limit).alias("m")
    rate = F.least(F.lit(float(limit)), F.exp(F.col("multiplier") * F.col("t.size") / F.col("mean")))
    rated = (
        table.alias("t")
        .join(targets.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source")))
        .join(tilted, F.col("t.source").eqNullSafe(F.col("m.source")), "left")
        .select("t.source", "t.size", "n", "g.source_size", "g.target", F.coalesce(F.when(F.col("g.target") >= limit * F.col("g.source_size"), float(limit)).otherwise(rate), F.lit(1.0)).alias("rate"))
        .withColumn("parts", F.round(F.col("rate") * PARTS).cast("long"))
        .withColumn("deals", F.expr(f"1 + n div {GROUP}"))
    )
    rated = cut(rated)
    dealt = F.col("deal") % F.col("deals")
    keyed = sized.alias("d").join(
        rated.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size"))
    ).select("doc_id", "d.source", "d.size", "source_size", "target", "rate", "parts", "deal", F.when(F.col("deals") > 1, dealt).otherwise(0).alias("part"), *more)
    # Only groups that are dealt over several ranks need their parts counted.
    parts = keyed.groupBy("source", "size", "part", "parts").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "size", "part", F.coalesce(F.sum(F.col("m") * (F.col("parts") % PARTS)).over(before), F.lit(0)).alias("passed"))
    rank = F.row_number().over(Window.partitionBy("k.source", "k.size", "k.part").orderBy("deal", "doc_id"))
    end = F.col("passed") + F.col("at") * F.col("extra") + PARTS // 2
    return (
        keyed.alias("k")
        .join(offsets.alias("o"), F.col("k.source").eqNullSafe(F.col("o.source")) & (F.col("k.size") == F.col("o.size")) & (F.col("k.part") == F.col("o.part")))
        .withColumn("at", rank)
        .withColumn("extra", F.col("parts") % PARTS)
        .select("doc_id", F.col("k.size").alias("size"), "source_size", "target", "rate", (F.expr(f"parts div {PARTS}") + F.floor(end / PARTS) - F.floor((end - F.col("extra")) / PARTS)).cast("long").alias("copies"), *more)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", *more)
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents in the mix, each row as often as it is taken, with the columns of ``docs``.

    Every row is taken for itself: rows that share an id, and rows without one, have copies of their own.
    """
    taken = mix(docs, id_col, carry=F.struct(*docs.columns), **options).where("copies > 0")
    return taken.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")
