"""Governance: personal data scans, k-anonymity, consent, retention, grants, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import privacy as P


def scan_pii(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """``column, kind, cells, matches``: where personal data stands, in one pass over the rows."""
    kinds = kinds or P.PII
    sums, rows = [], []
    for c in columns:
        for k, pattern in kinds.items():
            n = F.regexp_count(F.col(c).cast("string"), F.lit(pattern))
            i = len(rows)
            sums += [F.count_if(n > 0).alias(f"c{i}"), F.coalesce(F.sum(n), F.lit(0)).alias(f"m{i}")]
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("cells"), F.col(f"m{i}").alias("matches")))
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("cells > 0")


def _masker(kind: str):
    return lambda text, match: F.replace(text, match, P.mask_match(kind, match))


def mask_pii(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """The column with every match of the kinds, in order, replaced by its kind's mask."""
    text = F.col(column)
    for k in kinds:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(P.PII[k]), F.lit(0)))
        text = F.aggregate(found, text, _masker(k))
    return df.withColumn(column, text)


def apply_policy(df: DataFrame, policy: dict[str, dict], salt: bytes = b"") -> DataFrame:
    """A projection by column policy: keep, drop, nullify, mask, hash, tokenize or generalize."""
    out = []
    for c in df.columns:
        rule = policy.get(c, {"strategy": "keep"})
        kind = rule["strategy"]
        if kind == "drop":
            continue
        v = F.col(c)
        out.append({
            "keep": lambda: v, "nullify": lambda: F.lit(None).cast(df.schema[c].dataType),
            "mask": lambda: P.mask_email(v) if rule.get("keep_domain") else P.mask_keep_last(v, rule.get("keep_last", 4)),
            "hash": lambda: P.hash_value(v), "tokenize": lambda: P.token_value(v, salt),
            "generalize": lambda: {"age": lambda: P.age_band(v, rule["today"], rule.get("width", 10)), "zip": lambda: P.zip_prefix(v, rule.get("digits", 3)), "numeric": lambda: P.numeric_band(v, rule["width"])}[rule["as"]](),
        }[kind]().alias(c))
    return df.select(*out)


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """``k, classes, singletons, median_class`` over the classes of the quasi-identifiers, nulls included."""
    return df.groupBy(*quasi).agg(F.count("*").alias("n")).agg(F.min("n").alias("k"), F.count("*").alias("classes"), F.count_if(F.col("n") == 1).alias("singletons"), F.median("n").alias("median_class"))


def suppress_below(df: DataFrame, quasi: list[str], k: int) -> DataFrame:
    """Rows whose class has at least ``k`` members. Class sizes are joined back, so a large class isn't one task's."""
    sizes = df.groupBy(*quasi).agg(F.count("*").alias("class_size")).where(F.col("class_size") >= k)
    condition = reduce(lambda a, b: a & b, [df[q].eqNullSafe(sizes[q]) for q in quasi])
    return df.join(sizes, condition, "left_semi")


def generalization_ladder(df: DataFrame, levels: dict[str, list], k: int) -> DataFrame:
    """``level, k, classes, suppressed_rows, safe`` for each level's generalised columns."""
    parts = []
    for name, columns in levels.items():
        g = df.groupBy(*columns).agg(F.count("*").alias("n"))
        parts.append(g.agg(F.min("n").alias("k"), F.count("*").alias("classes"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("suppressed_rows")).select(F.lit(name).alias("level"), "k", "classes", "suppressed_rows", (F.col("k") >= k).alias("safe")))
    return reduce(DataFrame.unionByName, parts)


def audit_consent(consent: DataFrame, processing: DataFrame, as_of: str) -> DataFrame:
    """``activity_id, purpose, subject, finding`` of processing without a valid consent.

    The subject's latest consent for exactly that purpose counts. None is purpose-mismatch if the
    subject consented to another purpose, else no-consent; then withdrawn, then expired.
    """
    order = F.struct("timestamp", "status", "expiry")
    latest = consent.groupBy(F.col("subject_id").alias("subject"), "purpose").agg(F.max_by(F.struct("status", "expiry"), order).alias("c"))
    others = consent.select(F.col("subject_id").alias("subject")).distinct().withColumn("known", F.lit(True))
    asked = processing.select("activity_id", "purpose", F.explode(F.split("subjects_touched", ";")).alias("subject")).withColumn("subject", F.trim("subject")).where("subject <> ''")
    joined = asked.join(latest, ["subject", "purpose"], "left").join(others, "subject", "left")
    finding = (
        F.when(F.col("c").isNull() & F.col("known").isNotNull(), "purpose-mismatch").when(F.col("c").isNull(), "no-consent").when(F.col("c.status") == "withdrawn", "withdrawn")
        .when((F.col("c.status") == "expired") | (F.col("c.expiry") < F.lit(as_of).cast("date")), "expired")
    )
    return joined.withColumn("finding", finding).where("finding is not null").select("activity_id", "purpose", "subject", "finding")


def retention_plan(records: DataFrame, policies: DataFrame, as_of: str, warning_days: int = 30) -> DataFrame:
    """``record_id, data_class, age_days, verdict, action``: policies have data_class, max_days and action."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("created_date").cast("date"))
    joined = records.join(F.broadcast(policies), "data_class", "left").withColumn("age_days", age)
    verdict = F.when(F.col("max_days").isNull(), "no_policy").when(F.col("age_days") > F.col("max_days"), "past_retention").when(F.col("age_days") >= F.col("max_days") - warning_days, "approaching").otherwise("within_policy")
    return joined.withColumn("verdict", verdict).select("record_id", "data_class", "age_days", "verdict", F.when(F.col("verdict") == "past_retention", F.col("action")).otherwise("none").alias("action"))


# Roles, limits and conflicting pairs of the grant audit.
PRIVILEGED = ("data_admin", "dba", "security_admin", "platform_admin")
DISALLOWED_ON_RESTRICTED = ("contractor", "intern", "guest", "vendor")
STALE_DAYS, EXPOSURE_USERS = 90, 5


def audit_grants(grants: DataFrame, as_of: str, conflicts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``rule, user, dataset, severity``: over-privileged, stale, exposed, disallowed and conflicting grants."""
    restricted = F.col("sensitivity") == "restricted"
    writes = F.col("permission").isin("write", "admin")
    idle = F.datediff(F.lit(as_of).cast("date"), F.coalesce("last_used_date", "granted_date").cast("date"))
    row = lambda name, severity, cond: grants.where(cond).select(F.lit(name).alias("rule"), "user", "dataset", severity.alias("severity"))
    exposed = grants.where(restricted).groupBy("dataset").agg(F.count_distinct("user").alias("users")).where(F.col("users") > EXPOSURE_USERS)
    parts = [
        row("over-privileged", F.when(F.col("permission") == "admin", "high").otherwise("medium"), restricted & writes & ~F.col("role").isin(*PRIVILEGED)),
        row("stale", F.lit("medium"), idle >= STALE_DAYS),
        row("disallowed-role", F.lit("high"), restricted & F.col("role").isin(*DISALLOWED_ON_RESTRICTED)),
        exposed.select(F.lit("exposure").alias("rule"), F.lit(None).cast("string").alias("user"), "dataset", F.when(F.col("users") > 2 * EXPOSURE_USERS, "high").otherwise("medium").alias("severity")),
    ]
    if conflicts:
        roles = grants.groupBy("user").agg(F.collect_set("role").alias("roles"))
        for a, b in conflicts:
            both = F.array_contains("roles", a) & F.array_contains("roles", b)
            parts.append(roles.where(both).select(F.lit("conflicting-roles").alias("rule"), "user", F.lit(None).cast("string").alias("dataset"), F.lit("high").alias("severity")))
    return reduce(DataFrame.unionByName, parts)


def roll_up(spark, edges: DataFrame, postings: DataFrame, max_depth: int = 100) -> DataFrame:
    """``node, total``: postings summed into every ancestor of an edge table ``child, parent``.

    A recursive query walks up; a node already on the path ends its walk, so a cycle can't loop. A
    child under two parents counts under both. More than ``max_depth`` levels are an error.
    """
    edges.createOrReplaceTempView("sluice_edges")
    postings.groupBy("node").agg(F.sum("amount").alias("amount")).createOrReplaceTempView("sluice_postings")
    return spark.sql(f"""
        WITH RECURSIVE up(leaf, node, path) MAX RECURSION LEVEL {max_depth} AS (
          SELECT node, node, array(node) FROM sluice_postings
          UNION ALL SELECT u.leaf, e.parent, array_append(u.path, e.parent) FROM up u JOIN sluice_edges e ON u.node = e.child
          WHERE NOT array_contains(u.path, e.parent))
        SELECT u.node, sum(p.amount) AS total FROM up u JOIN sluice_postings p ON u.leaf = p.node GROUP BY u.node
    """)


def freshness(df: DataFrame, last: str, sla_hours: str, now: str) -> DataFrame:
    """Rows with ``age_hours`` and ``status``: Fresh to the limit, Warning to twice that, else Stale."""
    age = F.timestamp_diff("HOUR", F.col(last).cast("timestamp"), F.lit(now).cast("timestamp"))
    return df.withColumn("age_hours", age).withColumn("status", F.when(F.col("age_hours") <= F.col(sla_hours), "Fresh").when(F.col("age_hours") <= 2 * F.col(sla_hours), "Warning").otherwise("Stale"))


def pipeline_sla(runs: DataFrame, slas: DataFrame) -> DataFrame:
    """``pipeline, run_id, kind`` of every breach: FAILED (alone), LATE, SLOW, LOW_VOLUME.

    Limits per pipeline are landing_minutes (of the end's day), max_minutes and min_rows.
    """
    joined = runs.join(F.broadcast(slas), "pipeline")
    minutes = (F.unix_timestamp("ended") - F.unix_timestamp("started")) / 60
    landed = (F.unix_timestamp("ended") - F.unix_timestamp(F.date_trunc("day", "ended"))) / 60
    kinds = F.when(F.col("failed"), F.array(F.lit("FAILED"))).otherwise(F.filter(F.array(F.when(landed > F.col("landing_minutes"), "LATE"), F.when(minutes > F.col("max_minutes"), "SLOW"), F.when(F.col("row_count") < F.col("min_rows"), "LOW_VOLUME")), lambda k: k.isNotNull()))
    return joined.select("pipeline", "run_id", F.explode(kinds).alias("kind"))


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column, change, severity`` of two tables of ``column, type, nullable``.

    A removed column, a narrowed type and a lost nullability break; int to long to float to double widens.
    """
    rank = lambda t: F.when(t == "int", 1).when(t == "long", 2).when(t == "float", 3).when(t == "double", 4)
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col("b.column") == F.col("a.column"), "full_outer")
    widened = rank(F.col("a.type")) > rank(F.col("b.type"))
    change = (
        F.when(F.col("b.column").isNull() & F.col("a.nullable"), "added").when(F.col("b.column").isNull(), "added-required").when(F.col("a.column").isNull(), "removed")
        .when((F.col("a.type") != F.col("b.type")) & F.coalesce(widened, F.lit(False)), "widened").when(F.col("a.type") != F.col("b.type"), "retyped")
        .when(F.col("b.nullable") & ~F.col("a.nullable"), "now-required").when(~F.col("b.nullable") & F.col("a.nullable"), "now-nullable")
    )
    out = both.select(F.coalesce("a.column", "b.column").alias("column"), change.alias("change")).where("change is not null")
    return out.withColumn("severity", F.when(F.col("change").isin("removed", "retyped", "added-required", "now-required"), "breaking").when(F.col("change") == "now-nullable", "warning").otherwise("info"))


def resolve_identities(seeds: DataFrame, links: DataFrame, rounds: int = 3) -> DataFrame:
    """``kind, value, hop`` of identifiers reached from ``seeds`` (kind, value) over ``links``
    (kind_a, value_a, kind_b, value_b), nearest hop first; one equi-join a hop."""
    known = seeds.select("kind", "value").distinct().withColumn("hop", F.lit(0))
    both = links.select("kind_a", "value_a", "kind_b", "value_b").unionByName(links.select(F.col("kind_b").alias("kind_a"), F.col("value_b").alias("value_a"), F.col("kind_a").alias("kind_b"), F.col("value_a").alias("value_b")))
    for hop in range(1, rounds + 1):
        edge = known.where(F.col("hop") == hop - 1)
        found = edge.join(both, (F.col("kind") == F.col("kind_a")) & (F.col("value") == F.col("value_a"))).select(F.col("kind_b").alias("kind"), F.col("value_b").alias("value")).distinct()
        known = known.unionByName(found.withColumn("hop", F.lit(hop))).groupBy("kind", "value").agg(F.min("hop").alias("hop"))
    return known


def name_parts(df: DataFrame, column: str) -> DataFrame:
    """Rows with ``given`` and ``family``: "Family, Given" by the comma, else the last word is the family name."""
    v = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    comma = F.instr(v, ",") > 0
    given = F.when(comma, F.trim(F.substring_index(v, ",", -1))).when(F.instr(v, " ") > 0, F.regexp_extract(v, r"^(.*) \S+$", 1)).otherwise(v)
    family = F.when(comma, F.trim(F.substring_index(v, ",", 1))).when(F.instr(v, " ") > 0, F.substring_index(v, " ", -1)).otherwise("")
    return df.withColumn("given", given).withColumn("family", family)


def group_rates(df: DataFrame, group: str, selected, reference: str | None = None) -> DataFrame:
    """``group, n, rate, impact_ratio, four_fifths``: selection rates against the best group's."""
    g = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(selected.cast("double")).alias("rate"))
    base = F.max("rate" if reference is None else F.when(F.col("group") == reference, F.col("rate"))).over(Window.partitionBy(F.lit(0)))
    return g.withColumn("impact_ratio", F.col("rate") / base).withColumn("four_fifths", F.col("impact_ratio") >= 0.8)
