"""Text operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.core.session import cut, table
from sluice.operators import text as T
from sluice.queries import query

_DOCS = "documents"


@query("SELECT term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS uses FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def token_frequencies(spark, sf_dir):
    counts = T.term_counts(table(spark, sf_dir, _DOCS), "doc_id", "text")
    return counts.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))


_SEARCH = """
WITH t AS (SELECT doc_id AS key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), c AS (SELECT key, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY key) AS total FROM t GROUP BY 1, 2),
f AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1), w AS (SELECT key, term, n / total * idf AS weight FROM c JOIN f USING (term)), m AS (SELECT key, sqrt(sum(weight ** 2)) AS norm FROM w GROUP BY 1),
q0 AS (SELECT query, term, count(*) AS n FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2), q1 AS (SELECT query, term, n * idf AS q FROM q0 JOIN f USING (term)),
q AS (SELECT query, term, q / sqrt(sum(q ** 2) OVER (PARTITION BY query)) AS q FROM q1), s AS (SELECT query, key, round(sum(weight * q) / any_value(norm), 9) AS score FROM w JOIN q USING (term) JOIN m USING (key) GROUP BY 1, 2),
r AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s)
"""


@query(f"{_SEARCH} SELECT query, CAST(rank AS INTEGER) AS rank, key, score FROM r WHERE rank <= 3")
def token_tfidf_topk(spark, sf_dir):
    return T.search(table(spark, sf_dir, _DOCS), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 3)


@query("""
WITH c AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9)) AS t FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x != '') AS w FROM c), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > 0 THEN CAST(floor(greatest(len(w) - 21, 0) / 80) AS BIGINT) + 1 ELSE 0 END)) AS i FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS position, array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') AS chunk FROM i
""")
def chunk_documents(spark, sf_dir):
    return table(spark, sf_dir, _DOCS).select("doc_id", F.posexplode(T.chunk_words(F.col("text"), 100, 20)).alias("position", "chunk"))


@query("""
WITH n AS (SELECT conv_id, turn, text, CASE WHEN length(text) > 0 THEN greatest(CAST(ceil((length(text) - 50) / 150.0) AS INTEGER), 1) ELSE 0 END AS n FROM conversations), i AS (SELECT *, unnest(range(0, n)) AS i FROM n)
SELECT conv_id, turn, CAST(i AS INTEGER) AS position, substr(text, CAST(i * 150 + 1 AS BIGINT), 200) AS chunk FROM i
""")
def chunk_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.chunk_chars(F.col("text"), 200, 50)).alias("position", "chunk"))


@query("""
WITH h AS (SELECT doc_id AS key, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'), ' ')) AS h FROM documents), g AS (SELECT h, count(*) AS copies, min(key) AS "group" FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT key, "group", copies FROM h JOIN g USING (h)
""")
def exact_dup_documents(spark, sf_dir):
    return T.exact_duplicates(table(spark, sf_dir, _DOCS), "doc_id", "text")


@query()
def near_dup_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return T.shared_shingles(turns, "key", "text")


@query("""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), bg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM b)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
m AS (SELECT item_id, count(*) AS m FROM bg GROUP BY 1)
SELECT doc_id AS key, item_id AS item, round(count(*) / any_value(m), 6) AS share FROM dg JOIN bg USING (g) JOIN m USING (item_id) GROUP BY 1, 2
""")
def contamination_containment(spark, sf_dir):
    return T.containment(table(spark, sf_dir, _DOCS), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query()
def guardrail_actions(spark, sf_dir):
    checked = table(spark, sf_dir, _DOCS).select("doc_id", T.guardrails(F.col("text"), 20000, ("worthless", "scum")).alias("g"))
    return checked.select("doc_id", "g.action", F.array_join("g.reasons", ",").alias("reasons"), F.sha2("g.text", 256).alias("text_hash"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents),
s AS (SELECT doc_id, w, list_transform(w, lambda x, i: (CASE WHEN x IN ('good', 'great', 'excellent', 'love', 'easy', 'fast', 'helpful', 'amazing', 'best', 'happy') THEN 1 WHEN x IN ('bad', 'slow', 'terrible', 'hate', 'hard', 'broken', 'awful', 'worst', 'confusing', 'poor') THEN -1 ELSE 0 END)
* (CASE WHEN (i > 1 AND w[i - 1] IN ('not', 'no', 'never', 'hardly')) OR (i > 2 AND w[i - 2] IN ('not', 'no', 'never', 'hardly')) THEN -1 ELSE 1 END)) AS signs FROM w)
SELECT doc_id, CAST(coalesce(list_sum(signs), 0) AS INTEGER) AS sentiment FROM s
""")
def sentiment_documents(spark, sf_dir):
    return table(spark, sf_dir, _DOCS).select("doc_id", T.sentiment(F.col("text")).alias("sentiment"))


@query(f"""
{_SEARCH}, g AS (SELECT DISTINCT query, min(key) OVER (PARTITION BY query) AS key FROM r WHERE rank IN (1, 3)), top3 AS (SELECT r.query, r.rank, CASE WHEN g.key IS NULL THEN 0 ELSE 1 END AS good FROM r LEFT JOIN g ON r.query = g.query AND r.key = g.key WHERE rank <= 3),
a AS (SELECT query, sum(good) AS hits, count(*) AS got, max(CASE WHEN good = 1 THEN 1.0 / rank END) AS mrr, sum(good / log2(rank + 1)) AS dcg FROM top3 GROUP BY 1)
SELECT query, CAST(hits > 0 AS INTEGER) AS hit, CAST(hits AS DOUBLE) AS recall, round(hits / got, 6) AS precision, round(coalesce(mrr, 0), 6) AS mrr, round(dcg, 6) AS ndcg FROM a
""")
def rank_metrics(spark, sf_dir):
    results = cut(token_tfidf_topk(spark, sf_dir))  # three rows a query, read twice
    gold = results.where("rank in (1, 3)").groupBy("query").agg(F.min("key").alias("key"))
    out = T.rank_metrics(results, gold, 3)
    return out.select("query", "hit", "recall", *[F.round(c, 6).alias(c) for c in ("precision", "mrr", "ndcg")])


@query("""
WITH c AS (SELECT conv_id, role AS model, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM conversations)
SELECT model, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t * CASE model WHEN 'user' THEN 0.5 WHEN 'assistant' THEN 1.5 END / 1000), 6) AS cost FROM c GROUP BY 1
""")
def token_cost_rollup(spark, sf_dir):
    prices = spark.createDataFrame([("user", 0.5, 0.0), ("assistant", 1.5, 0.0)], "model string, price_in double, price_out double")
    calls = table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), "text", F.lit("").alias("answer"))
    out = T.token_costs(calls, prices, "model", "text", "answer")
    return out.groupBy("model").agg(F.sum("tokens_in").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT doc_id, round((CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'einer') AS INTEGER) + CAST(contains(lower(text), 'zebra') AS INTEGER)) / 3.0, 6) AS recall FROM documents")
def keyword_recall_documents(spark, sf_dir):
    return table(spark, sf_dir, _DOCS).select("doc_id", F.round(T.keyword_recall(F.col("text"), F.array(F.lit("The"), F.lit("einer"), F.lit("zebra"))), 6).alias("recall"))


@query("""
WITH v AS (SELECT vec_id AS key, label, [x / sqrt(list_sum([y::DOUBLE * y::DOUBLE for y in embedding])) for x in embedding] AS v FROM embeddings),
p AS (SELECT a.key, b.key AS source, round(list_sum([x[1]::DOUBLE * x[2]::DOUBLE for x in list_zip(a.v, b.v)]), 6) AS score FROM v a LEFT JOIN v b ON a.label = b.label AND b.key < a.key),
m AS (SELECT key, arg_max(source, (score, -source)) AS source, max(score) AS score FROM p GROUP BY 1)
SELECT key, coalesce(score >= 0.3, false) AS hit, CASE WHEN score >= 0.3 THEN source END AS source, CASE WHEN score >= 0.3 THEN score END AS score FROM m
""".replace("[x / sqrt(list_sum([y::DOUBLE * y::DOUBLE for y in embedding])) for x in embedding]", "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))").replace("[x[1]::DOUBLE * x[2]::DOUBLE for x in list_zip(a.v, b.v)]", "list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])"))
def semantic_cache_hits(spark, sf_dir):
    return T.semantic_cache(table(spark, sf_dir, "embeddings").withColumn("at", F.col("vec_id")), "vec_id", "at", "embedding", ["label"], 0.3)
