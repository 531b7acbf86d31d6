import random
from decimal import ROUND_HALF_EVEN, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sluice.operators import money


def by_hand(total, weights):
    units, whole = int(total * 100), sum(weights)
    ideal = [Fraction(units) * Fraction(w) / Fraction(whole) for w in weights]
    floors = [x.__floor__() for x in ideal]
    order = sorted(range(len(weights)), key=lambda i: (-(ideal[i] - floors[i]), i))
    for i in order[: units - sum(floors)]:
        floors[i] += 1
    return [Decimal(u) / 100 for u in floors]


def test_shares_add_up(spark):
    rng, rows, want = random.Random(1), [], {}
    for g in range(40):
        total = Decimal(rng.randint(-5000, 5_000_000)) / 100
        weights = [Decimal(rng.choice([0, 1, 1, 2, rng.randint(0, 99999)])) / rng.choice([1, 10, 1000]) for _ in range(rng.randint(1, 9))]
        weights[0] += 1
        for i, (w, s) in enumerate(zip(weights, by_hand(total, weights))):
            rows.append((g, i, total, w, "x"))
            want[g, i] = s
    df = spark.createDataFrame(rows, "g int, i int, total decimal(18,2), w decimal(18,4), share string").drop("share").repartition(5)
    got = {(r["g"], r["i"]): r["share"] for r in money.allocate(df, ["g"], "total", "w", ["i"]).collect()}
    assert got == want


@pytest.mark.parametrize("rows", [[(1, "1.00", "-1"), (2, "1.00", "2")], [(1, "1.00", "0")], [(1, "1.005", "1")], [(1, "1.00", "1"), (2, "2.00", "1")], [(1, None, "1")]])
def test_what_cannot_be_allocated(spark, rows):
    df = spark.createDataFrame([(i, t and Decimal(t), Decimal(w)) for i, t, w in rows], "i int, total decimal(18,3), w decimal(18,4)")
    with pytest.raises(Exception, match="cannot allocate"):
        money.allocate(df, [], "total", "w", ["i"]).collect()


def test_tax_levels_and_chains(spark):
    rng = random.Random(2)
    rows = [(g, Decimal(rng.randint(1, 9999)) / 100, Decimal("0.0825")) for g in range(20) for _ in range(7)]
    got = {r["g"]: r for r in money.tax_by_level(spark.createDataFrame([*rows, (3, None, Decimal("0.0825"))], "g int, net decimal(18,2), rate decimal(10,4)"), ["g"], "net", "rate").collect()}
    cent = lambda x: x.quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    for g in range(20):
        nets = [n for k, n, _ in rows if k == g]
        line, invoice = sum(cent(n * Decimal("0.0825")) for n in nets), cent(sum(nets) * Decimal("0.0825"))
        assert (got[g]["by_line"], got[g]["by_invoice"], got[g]["differs"]) == (line, invoice, line != invoice)
    assert any(r["differs"] for r in got.values())
    x = F.lit(Decimal("2.3449")).cast("decimal(10,4)")
    row = spark.range(1).select(money.chain_round(x, [3, 2]).alias("two"), money.chain_round(x, [2]).alias("one")).first()
    assert (row["two"], row["one"]) == (Decimal("2.34"), Decimal("2.34")) and spark.range(1).select(money.chain_round(F.lit(Decimal("2.3455")), [3, 2, 1]), money.chain_round(F.lit(Decimal("2.3455")), [1])).first()[:] == (Decimal("2.4"), Decimal("2.3"))
