"""Queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.core.session import table
from sluice.llm import ann, dialogues, langid, media, mixing, ngrams, phrases, pieces, secrets, simhash, sitetree, sql, toxicity, wordpieces

#: Model file whose pieces op3 counts and op5 encodes with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_pictures(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(table(spark, sf_dir, "documents"), wordpieces.vocabulary(PIECES))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_corpus(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(PIECES))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract_pages(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op12_dialogue_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.forked_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_language_id, op2_media, op3_token_counts, op4_lm_scores, op5_sentencepiece, op6_nearest, op7_main_text, op8_mixing, op9_simhash, op10_toxicity, op11_secrets, op12_dialogue_trie, op13_collocations)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_secrets": sql.secrets(secrets.PATTERNS, secrets.CLASSES, secrets.ALLOWED),
        "op12_dialogue_trie": sql.DIALOGUES,
        "op13_collocations": sql.PHRASES,
    }
