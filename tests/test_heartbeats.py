import random
import uuid

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.core.session import shared_dir
from sluice.streaming import heartbeats


@given(st.sets(st.integers(0, 60)), st.integers(1, 9), st.lists(st.integers(0, 80), max_size=4))
def test_gaps_do_not_depend_on_the_steps(pings, limit, marks):
    got, held, come = [], set(), set()
    for mark in [*sorted(marks), 80]:
        # Before the watermark passes a time all pings up to it have come, and some later ones.
        new = {p for p in pings if p <= mark + 3} - come
        come |= new
        alerts, left = heartbeats.gaps(sorted(held | new), limit, mark)
        got, held = got + alerts, set(left)
    assert got == [p for p in sorted(pings) if p + limit <= 80 and not any(p < q <= p + limit for q in pings)]


def test_a_stream_goes_on_from_its_checkpoint(spark):
    """Two runs over files that grow give the alerts of all pings, each once, jobs by themselves."""
    rng = random.Random(4)
    rows = sorted((1_700_000_000 + rng.randrange(40_000), job) for job in range(7) for _ in range(60 if job else 3))
    home = f"{shared_dir(spark)}/test-heartbeats-{uuid.uuid4().hex}"
    schema = "job long, ts timestamp"
    half = len(rows) // 2
    limit = F.lit(500) + F.col("job") * 100

    def add(part):
        part = part[:]
        rng.shuffle(part)
        spark.createDataFrame([(j, t) for t, j in part] + [(None, part[0][0])], "job long, t long").select("job", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{home}/in")

    def run():
        out = heartbeats.run_silences(spark, f"{home}/in", schema, "job", "ts", limit, "1 minute", home=f"{home}/run")
        return sorted((r["job"], int(r["last"].timestamp())) for r in out.collect())

    def want(part):
        mark = max(t for t, _ in part) - 60
        return sorted({(j, t) for t, j in part if t + 500 + 100 * j <= mark and not any(t < u <= t + 500 + 100 * j for u, k in part if k == j)})

    add(rows[:half])
    first = run()
    assert first == want(rows[:half]) and first
    add(rows[half:])
    assert run() == want(rows)
    assert run() == want(rows)
