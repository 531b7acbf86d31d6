"""Lookups, pages, levels and shares over tables of any size."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import cut


def bitemporal(facts: DataFrame, versions: DataFrame, key: str, at: str, known: Column, values: list[str]) -> DataFrame:
    """Facts with the version that was valid at ``at`` as it was known at ``known`` (null where none was).

    ``versions`` have the key, ``valid_from`` and ``recorded_at``. Of versions valid by then and
    recorded by then the latest valid one counts, and of its records the last. Equal facts are looked
    up once and given back as often as they occur. Both sides meet on the key only, so a key with many
    versions should have few facts or the other way round.
    """
    from_ = versions.select(key, "valid_from", "recorded_at", *values)
    once = facts.groupBy(*facts.columns).agg(F.count("*").alias("times_"))
    rows = once.select(F.struct(*facts.columns).alias("fact_"), key, at, "times_", known.alias("known_"))
    fits = (F.col("valid_from") <= F.col(at)) & (F.col("recorded_at") <= F.col("known_"))
    last = F.max(F.when(fits, F.struct("valid_from", "recorded_at", *values))).alias("v")
    found = rows.join(from_, key, "left").groupBy("fact_", "times_").agg(last)
    again = found.withColumn("time_", F.explode(F.sequence(F.lit(1).cast("long"), "times_")))
    return again.select("fact_.*", *[F.col(f"v.{c}").alias(c) for c in values])


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows in the order of unique keys, those beyond ``after``; costs the same for every page."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after):
            beyond = beyond | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        df = df.where(beyond)
    return df.orderBy(*order).limit(size)


def offset_page(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (0 on) by counting rows off: every page sorts all before it."""
    return df.orderBy(*order).offset(page * size).limit(size)


def once(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column of texts, byte by byte.

    Spark drops a plain ``distinct`` below aggregates that don't mind repeated rows, and those sort every
    row by text; the count that is asked for here keeps the grouping, which hashes.
    """
    exact = F.collate(F.col(column), "UTF8_BINARY").alias(column)
    return df.groupBy(exact).agg(F.count("*").alias("times_")).where("times_ > 0").select(column)


def distinct_under(df: DataFrame, column: str, collations: list[str]) -> DataFrame:
    """``collation, n``: how many values of a column differ under each collation; values that are the same bytes are compared once."""
    return once(df, column).agg(*[F.count_distinct(F.collate(F.col(column), c)).alias(c) for c in collations]).unpivot([], collations, "collation", "n")


def reidentified(release: DataFrame, known: DataFrame, quasi: list[str], secret: str) -> DataFrame:
    """``released, unique_rows, matched, share``: an attack that joins a release with known people on quasi-identifiers.

    A row is re-identified where its quasi-identifiers are unique in the release and among the known.
    """
    one = release.groupBy(*quasi).agg(F.count("*").alias("n"), F.min(secret).alias(secret))
    other = known.groupBy(*quasi).agg(F.count("*").alias("m"))
    out = one.join(other, quasi, "left").agg(F.sum("n").alias("released"), F.count_if(F.col("n") == 1).alias("unique_rows"), F.count_if((F.col("n") == 1) & (F.col("m") == 1)).alias("matched"))
    return out.withColumn("share", F.col("matched") / F.col("released"))


def shapley(values: DataFrame, players: list[str]) -> DataFrame:
    """``player, share`` of a game ``mask, value`` (bit i: player i takes part) over all coalitions."""
    n = len(players)
    if n > 16:
        raise ValueError("a game of more than 16 players has too many coalitions")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - k - 1) / factorial(n)) for k in range(n)]), F.bit_count("mask").cast("int") + 1)
    each = values.select("mask", "value", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("player")) for i, p in enumerate(players)])).alias("p"))
    without = each.where(F.expr("(mask & shiftleft(1, p.i)) = 0")).withColumn("with_", F.expr("mask | shiftleft(1, p.i)"))
    more = values.select(F.col("mask").alias("with_"), F.col("value").alias("more_"))
    return without.join(more, "with_").groupBy(F.col("p.player").alias("player")).agg(F.sum(weight * (F.col("more_") - F.col("value"))).alias("share"))


def in_core(values: DataFrame, shares: DataFrame, players: list[str]) -> DataFrame:
    """``coalitions, blocking, in_core`` of cost shares: a coalition blocks where its shares exceed its own cost."""
    bits = F.array(*[F.struct(F.lit(p).alias("player"), F.lit(1 << i).alias("bit")) for i, p in enumerate(players)])
    paid = values.where("mask > 0").select("mask", "value", F.explode(bits).alias("p")).where(F.expr("(mask & p.bit) > 0")).select("mask", "value", "p.player")
    sums = paid.join(shares, "player").groupBy("mask", "value").agg(F.sum("share").alias("paid"))
    return sums.agg(F.count("*").alias("coalitions"), F.count_if(F.col("paid") > F.col("value") + 1e-9).alias("blocking")).withColumn("in_core", F.col("blocking") == 0)


def levels(edges: DataFrame, before: str, after: str, max_rounds: int = 200) -> DataFrame:
    """``node, level``: the longest path to each node of an acyclic graph; a cycle raises.

    A round hands levels on along all edges at once and is one join and one aggregation, so there
    are as many rounds as levels. Tables meet by shuffles: what a round broadcasts would go through the
    driver once for every round.
    """
    steps = cut(edges.select(F.col(before).alias("a"), F.col(after).alias("b")).distinct())
    now = cut(steps.select(F.col("a").alias("node")).union(steps.select(F.col("b").alias("node"))).distinct().withColumn("level", F.lit(0)))
    for _ in range(max_rounds):
        pushed = steps.hint("merge").join(now.select(F.col("node").alias("a"), (F.col("level") + 1).alias("next")), "a").groupBy(F.col("b").alias("node")).agg(F.max("next").alias("next"))
        after_ = cut(now.hint("merge").join(pushed, "node", "left").select("node", F.col("level").alias("old"), F.greatest("level", F.coalesce("next", F.lit(0))).alias("level")))
        done = after_.where("old <> level").isEmpty()
        now = after_.drop("old")
        if done:
            return now
    raise ValueError(f"levels did not settle in {max_rounds} rounds: the graph has a cycle or longer paths")


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """``path, kind, n``: the union of the paths of JSON texts with the kinds of value found there.

    Texts are read as variants and walked level by level, as many as there are; the elements of an
    array share one path. A level is one pass over the values of the level before. Texts that aren't
    JSON are left out.
    """
    at = df.select(F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    kinds = []
    while True:
        kind = F.regexp_extract(F.lower(F.schema_of_variant("v")), "^[a-z]+", 0)
        at = cut(at.withColumn("kind", F.when(kind == "bigint", "number").when(kind.isin("decimal", "double"), "number").otherwise(kind)))
        kinds.append(at.groupBy("path", "kind").agg(F.count("*").alias("n")))
        inner = at.where("kind in ('object', 'array')")
        if inner.isEmpty():
            break
        named = F.expr("transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> struct(concat(path, '.', e.key) as path, e.value as v))")
        listed = F.expr("transform(try_variant_get(v, '$', 'array<variant>'), e -> struct(concat(path, '[]') as path, e as v))")
        at = inner.select(F.explode(F.when(F.col("kind") == "object", named).otherwise(listed)).alias("e")).select("e.*")
    out = kinds[0]
    for more in kinds[1:]:
        out = out.union(more)
    return out.groupBy("path", "kind").agg(F.sum("n").alias("n"))


WIDE = r"[ᄀ-ᅟ⺀-〾ぁ-㏿㐀-䶿一-鿿ꀀ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"
NO_WIDTH = r"[̀-ͯ​-‏⃐-⃿︀-️︠-︯]"


def display_width(text: Column) -> Column:
    """Columns of a terminal that a text takes: wide characters two, marks and joiners none."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE)) - F.regexp_count(text, F.lit(NO_WIDTH))


def truncate(text: Column, columns: int, mark: str = "…") -> Column:
    """A text cut to so many columns, the mark included; no character is cut in two and marks stay with their letter."""
    chars = F.split(text, "")
    sizes = F.transform(chars, lambda c: F.when(c.rlike(WIDE), 2).when(c.rlike(NO_WIDTH), 0).otherwise(1))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))
    step = lambda a, s: F.struct((a["used"] + s).alias("used"), F.when(a["full"] | (a["used"] + s > columns - len(mark)), a["kept"]).otherwise(a["kept"] + 1).alias("kept"), (a["full"] | (a["used"] + s > columns - len(mark))).alias("full"))
    kept = F.aggregate(sizes, start, step)["kept"]
    return F.when(display_width(text) <= columns, text).otherwise(F.concat(F.array_join(F.slice(chars, F.lit(1), kept), ""), F.lit(mark)))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, for increments that hold several updates of one key."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("at_", F.row_number().over(last)).where("at_ = 1").drop("at_")
