"""New rows of small classes, between a row and its neighbours in the class."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut

#: Rows of a class that are compared with one another; larger classes are cut into such blocks.
BLOCK = 4096


def smote(df: DataFrame, label: str, features: list[str], id_col: str, neighbours: int = 5, ratio: float = 1.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``label, <features>, source, neighbour``: rows that bring each class to ``ratio`` times the largest.

    Every new row lies on the way from a row of its class (``source``) to one of its ``neighbours``
    nearest (``neighbour``), at a place drawn by the seed and the row's id. Distances are Euclidean
    after each feature is divided by its deviation in the class. All rows of a class serve as sources equally
    often, but for the rest. Classes of more than ``block`` rows are cut along a random direction
    into blocks of about that size, and neighbours come from the block. Rows with a null label, id or
    feature take no part; a class of one row is repeated. Equal ids draw alike.
    """
    kept = df.where(" and ".join(f"`{c}` is not null" for c in [label, id_col, *features])).select(F.col(label).alias("label"), F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(f) for f in features])
    kept = cut(kept)
    classes = kept.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features], *[F.stddev_pop(f).alias(f"dev_{f}") for f in features])
    sizes = {r["label"]: r for r in classes.collect()}
    largest = max((r["n"] for r in sizes.values()), default=0)
    wanted = {c: max(0, math.floor(ratio * largest + 1e-9) - r["n"]) for c, r in sizes.items()}
    small = [c for c, m in wanted.items() if m]
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"label {kind['label']}, " + ", ".join(f"{f} double" for f in features) + f", source {kind['id']}, neighbour {kind['id']}"
    if not small:
        return df.sparkSession.createDataFrame([], schema)
    # A class's rows in order along one direction, cut at quantiles.
    direction = np.random.default_rng(seed).normal(size=len(features))
    scaled = [F.coalesce((F.col(f) - F.col(f"mean_{f}")) / F.when(F.col(f"dev_{f}") > 0, F.col(f"dev_{f}")), F.lit(0.0)) for f in features]
    along = kept.where(F.col("label").isin(small)).join(F.broadcast(classes), "label").select("label", "id", *features, sum(s * float(w) for s, w in zip(scaled, direction)).alias("along_"))
    parts = {c: math.ceil(sizes[c]["n"] / block) for c in small}
    edges = {}
    for c in (c for c in small if parts[c] > 1):
        edges[c] = along.where(F.col("label") == F.lit(c)).agg(F.percentile_approx("along_", [i / parts[c] for i in range(1, parts[c])], 10_000)).first()[0]
    place = F.lit(0)
    for c, e in edges.items():
        place = F.when(F.col("label") == F.lit(c), F.size(F.filter(F.array(*map(F.lit, e)), lambda x: x < F.col("along_")))).otherwise(place)
    dealt = cut(along.withColumn("block_", place).drop("along_"))
    # How many rows over the equal share each block makes: few blocks, counted.
    counts = sorted(((r["label"], r["block_"], r["n"]) for r in dealt.groupBy("label", "block_").agg(F.count("*").alias("n")).collect()), key=lambda r: (str(r[0]), r[1]))
    share, passed = {}, {}
    for c, b, n in counts:
        before, rest = passed.get(c, 0), wanted[c] % sizes[c]["n"]
        share[c, b] = (wanted[c] // sizes[c]["n"], (before + n) * rest // sizes[c]["n"] - before * rest // sizes[c]["n"])
        passed[c] = before + n
    deviations = {c: [sizes[c][f"dev_{f}"] or 1.0 for f in features] for c in small}

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", *features], kind="stable").reset_index(drop=True)
        whole, more = share[key[0], key[1]]
        x = part[features].to_numpy(float)
        near = _nearest(x / np.array(deviations[key[0]]), neighbours)
        out = []
        for i, own in enumerate(part["id"]):
            rng = np.random.default_rng([seed, _number(own), i])
            for _ in range(whole + (i < more)):
                j = int(rng.choice(near[i])) if len(near[i]) else i
                out.append((key[0], *(x[i] + rng.random() * (x[j] - x[i])), own, part["id"][j]))
        return pd.DataFrame(out, columns=["label", *features, "source", "neighbour"])

    return dealt.groupBy("label", "block_").applyInPandas(make, schema)


def _number(value: object) -> int:
    return int.from_bytes(str(value).encode()[-8:].rjust(8, b"\0"), "little")


def _nearest(x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the places of its ``k`` nearest others, some hundred rows at a time."""
    found = []
    squares = (x * x).sum(axis=1)
    for at in range(0, len(x), 256):
        far = squares[None, :] - 2 * x[at : at + 256] @ x.T
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        m = min(k, len(x) - 1)
        found += [np.argpartition(row, m - 1)[:m] if m else np.empty(0, int) for row in far]
    return found
