import random
import uuid

import pytest

from sluice.core.session import shared_dir
from sluice.operators import loads

SCHEMA = "id long, amount double, at long, gone boolean"


def target(spark, **more):
    return loads.Target(spark, f"{shared_dir(spark)}/loads-{uuid.uuid4().hex}", SCHEMA, "id", "at", "gone", buckets=5, **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(t):
    return sorted((r["id"], r["amount"], r["at"]) for r in t.read().collect())


class Plain:
    """The same loads on a dictionary."""

    def __init__(self):
        self.rows, self.mark = {}, None

    def load(self, source):
        new = [r for r in source if r[0] is not None and r[2] is not None and (self.mark is None or r[2] > self.mark)]
        latest = {}
        for r in new:
            if r[0] not in latest or (r[2], r[0], r[1], r[3] or False) > (latest[r[0]][2], latest[r[0]][0], latest[r[0]][1], latest[r[0]][3] or False):
                latest[r[0]] = r
        counts = [0, 0, 0]
        for k, r in latest.items():
            known = k in self.rows
            if r[3]:
                counts[2] += known
                self.rows.pop(k, None)
            else:
                counts[1 if known else 0] += 1
                self.rows[k] = r
        self.mark = max([r[2] for r in new] + ([self.mark] if self.mark is not None else []), default=None)
        return [len(new), *counts]


def test_cycles_against_a_dictionary(spark):
    rng = random.Random(1)
    t, plain, source = target(spark), Plain(), [(i, 1.0 * i, 0, None) for i in range(30)]
    source += [(None, 1.0, 0, None), (99, 1.0, None, None)]
    for cycle in range(1, 5):
        record = t.load(frame(spark, source))
        got = plain.load(source)
        assert [record.extracted, record.inserted, record.updated, record.deleted] == got and record.number == cycle and record.watermark == str(plain.mark)
        assert state(t) == sorted(r[:3] for r in plain.rows.values())
        source = source + [(rng.randrange(40), float(rng.randrange(9)), cycle * 10 + rng.randrange(3), rng.random() < 0.3) for _ in range(12)]
    assert [r["number"] for r in t.log().collect()] == [1, 2, 3, 4]


def test_a_load_that_dies_and_one_done_again_change_nothing(spark):
    t = target(spark)
    t.load(frame(spark, [(1, 1.0, 1, None), (2, 2.0, 1, None)]))
    before = state(t)
    more = frame(spark, [(2, 5.0, 2, None), (3, 3.0, 2, None), (1, 0.0, 2, True)])
    with pytest.raises(InterruptedError):
        t.load(more, stop_before_commit=True)
    assert state(t) == before and t.last().number == 1
    record = t.load(more)
    assert (record.inserted, record.updated, record.deleted) == (1, 1, 1) and state(t) == [(2, 5.0, 2), (3, 3.0, 2)]
    assert t.load(more) == t.last() and t.last().number == 2
    assert t.read(t.records()[0]).count() == 2


def test_of_two_loads_one_fails(spark):
    t = target(spark)
    t.load(frame(spark, [(1, 1.0, 1, None)]))
    with pytest.raises(RuntimeError, match="another run"):
        t._commit(loads.Record(number=1))
    assert t.last().inserted == 1


def test_untouched_buckets_keep_their_files_and_all_may_go(spark):
    t = target(spark)
    first = t.load(frame(spark, [(i, 0.0, 1, None) for i in range(50)]))
    second = t.load(frame(spark, [(7, 1.0, 2, None)]))
    assert sum(first.files[b] != second.files[b] for b in first.files) == 1
    t.load(frame(spark, [(i, 0.0, 3, True) for i in range(50)]))
    assert state(t) == [] and t.last().deleted == 50 and t.load(frame(spark, [])) == t.last()
    with pytest.raises(Exception):
        target(spark).read(loads.Record(files={"0": "data/none"})).collect()


def test_a_stream_of_files_each_once(spark):
    t = target(spark)
    folder = f"{t.home}/in"
    frame(spark, [(1, 1.0, 1, None), (2, 2.0, 9, None)]).coalesce(1).write.mode("append").parquet(folder)
    assert t.load_stream(folder).inserted == 2
    frame(spark, [(1, 7.0, 2, None), (2, 0.0, 3, None), (3, 3.0, 3, None)]).coalesce(1).write.mode("append").parquet(folder)
    record = t.load_stream(folder)
    # The late change of 2 stays out, the late one of 1 is its newest.
    assert (record.inserted, record.updated) == (1, 1) and state(t) == [(1, 7.0, 2), (2, 2.0, 9), (3, 3.0, 3)] and record.watermark == "9"
    assert t.load_stream(folder) == record and t.load(frame(spark, [(4, 4.0, 99, None)]), batch=record.batch) == record
