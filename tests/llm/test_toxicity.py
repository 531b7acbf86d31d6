import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import toxicity as X

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return X.train(docs, labels.where(X.fold(F.col("doc_id"), 4) != 2), docs)


@pytest.mark.parametrize(("given", "want"), [("1d10t", "idiot"), ("st*pid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("w0rthl3ss", "worthless"), ("i d i o t", "idiot"), ("m0r0n!!", "moron"), ("stuuuupid", "stupid"), ("tr4sh", "trash"), ("OF!!", "of"), ("onor***", "onor"), ("The", "the"), ("455", "")])
def test_disguises(model, given, want):
    assert X.Restorer(model.chars).restore(given) == want


def test_signs_at_the_edge_and_signs_alone_are_decoded(model):
    restorer, read = X.Restorer(model.chars), lambda t: X.decode(t, model.chars.logp).split()
    assert restorer.words("@$$") == tuple(read("@$$")) and restorer.words("!!") == () == restorer.words("455")
    assert set(restorer.words("!d!ot")) == {*read("d!ot"), *read("!d!ot")}


def test_decoding_is_the_best_of_all_readings(model):
    def cost(reading):
        a = b = 0
        total = 0.0
        for c in reading + " ":
            z = X.code(c)
            if z or b:
                total += model.chars.logp[a][b][z]
                a, b = b, z
        return total

    def readings(lattice):
        if not lattice:
            return [("", 0.0)]
        return [(p + r, c + s) for p, c in lattice[0] for r, s in readings(lattice[1:])]

    for token in ("1d10t", "a$$", "l0s3r", "t|p", "c1+y"):
        best = max(cost(r) + c for r, c in readings(X.options(token)))
        decoded = X.decode(token, model.chars.logp)
        assert max(cost(r) + c for r, c in readings(X.options(token)) if r.strip() == decoded) == pytest.approx(best)


def test_held_out_quality(spark, model):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(X.fold(F.col("doc_id"), 4) == 2)
    out = X.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.98


def test_disguised_words_score_like_plain_ones(model):
    for plain, hidden in (("you are an idiot", "you are an 1d10t"), ("such a loser", "such a l0s3r"), ("worthless scum", "w0rthless $cum"), ("so stupid", "so s.t.u.p.i.d")):
        assert model.score(hidden) == pytest.approx(model.score(plain), abs=0.15)


def test_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "Ab! ab"), (3, None)], "doc_id long, text string")
    counts = X.char_counts(docs)
    assert counts[(0 * X.A + 1) * X.A + 2] == 3 and counts.sum() == np.count_nonzero(X.trigram_counts("ab\n\nAb! ab\n\n"))


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 0, 0), (None, 1, 1), (7, None, None), (8, 1, 5)], "doc_id long, quality int, toxic int")
    out = X.detect(awkward, labels).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out}[4] == (zlib.crc32(b"4") % 4 == 2)
    assert X.detect(nothing, labels).count() == 0 and X.detect(awkward, labels.where("false")).count() == 9
