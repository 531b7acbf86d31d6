import collections

import corpus_pipeline as P
import pytest

from sluice.llm import langid, mixing, shingles, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert out.columns == names
        if name == "language":
            assert ids(out) == sorted(r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= P.LEAST_LANGUAGE)
        elif name == "toxicity":
            assert ids(out) == sorted(r["doc_id"] for r in toxicity.detect(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect() if not r["predicted"])
        elif name == "near_duplicates":
            # Links of either kind, closed by hand.
            group = {r["doc_id"]: r["doc_id"] for r in docs.collect()}
            for found in (simhash.near_duplicates(docs), shingles.components(docs)):
                for r in found.collect():
                    low, high = sorted((group[r["doc_id"]], group[r["component_id"]]))
                    group = {k: low if v == high else v for k, v in group.items()}
            assert ids(out) == sorted(set(group.values())) and len(ids(out)) < simhash.keep_one(docs).count()
        elif name == "mixture":
            check_targets(docs, out)
        else:
            assert ids(out) == ids(docs) and out.where("not round_trip").count() == 0
        docs = out


def check_targets(docs, out):
    """Each source has its target in words but for its longest document, no row is there more than twice."""
    sized = lambda df: [(r["doc_id"], r["source"], r["n"]) for r in df.select("doc_id", "source", mixing.words_in(df["text"]).alias("n")).collect()]
    before, after = sized(docs), sized(out)
    want = {r["carried"]: r["target"] for r in mixing.mix(docs, carry=docs["source"]).collect()}
    got, most = collections.Counter(), collections.Counter()
    for i, s, n in after:
        got[s] += n
        most[i, s, n] += 1
    for s, target in want.items():
        assert abs(got[s] - target) <= max(n for _, t, n in before if t == s) + 1
    rows = collections.Counter(before)
    assert all(k in rows and v <= 2 * rows[k] for k, v in most.items())


ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 1),
    (1, "an entirely other text shares its number with the first one here", "en", "b", 2),
    (None, "nobody gave this text a number but it is a fine text all the same", "en", "a", 3),
    (None, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 4),
    (5, "", "en", "b", 5),
    (6, "1234 !!", None, "b", 6),
]


@pytest.fixture
def shared_ids(spark):
    rows = [(*r, k, k, "x") for k, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies_taken int, row int, key string")


def test_rows_that_share_an_id_or_have_none(spark, shared_ids):
    numbers = lambda df: sorted(r["n_chars"] for r in df.collect())
    kept = P.language(spark, shared_ids, DATA)
    assert kept.columns == shared_ids.columns and numbers(kept) == [1, 2, 3, 4]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert labels.count() and set(numbers(P.toxic(spark, shared_ids, DATA))) <= {1, 2, 3, 4, 5, 6}
    kept = P.near_duplicates(spark, shared_ids, DATA)
    assert kept.columns == shared_ids.columns and numbers(kept) == [1, 2, 3, 5, 6]
    assert numbers(P.near_duplicates(spark, shared_ids.union(shared_ids), DATA)) == [1, 2, 3, 5, 6]
    mixed = P.mixture(spark, shared_ids, DATA)
    assert mixed.columns == shared_ids.columns
    check_targets(shared_ids, mixed)


def test_no_rows(spark, shared_ids):
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, shared_ids.where("false"), DATA).collect() == [], name


def test_stages_are_as_dealt():
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near_duplicates", "mixture", "tokens"] and P.ORACLE_SQL is None


def test_texts_reach_python_in_small_batches(spark):
    """Stages with Python bound the bytes of an Arrow batch; a session that has set the bound keeps it."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('the quick brown fox ', 25000) as text", "'en' as lang", "'a' as source", "500000 as n_chars")
    sizes = lambda: [r["n"] for r in docs.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    try:
        for name, stage in P.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, DATA)
            assert name == "mixture" or max(sizes()) < 6_000_000, name
        spark.conf.set(key, "2m")
        P.tokens(spark, docs, DATA)
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key)
