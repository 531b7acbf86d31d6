import random

import numpy as np
import sentencepiece

from sluice.llm import pieces
from sluice.llm.registry import PIECES


def test_ids_are_the_models_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode(docs, pieces.load(PIECES)).collect():
        assert r["ids"] == own.encode(texts[r["doc_id"]]) and r["round_trip"]


def test_awkward_texts_have_the_models_ids():
    v, own, rng = pieces.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(6)
    assert v.bpe and v.encoder.__class__ is pieces.MergeEncoder
    texts = ["the information", "  two  spaces ", " ", "     x", "日本語 und 😀", "a\n\nb\t", "x" * 700, "=" * 301, "<s> <0x41> <unk></s>", "a▁b", "ﬁ é é", "ab\u0000c"]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (5, 24, 25, 400, 3000)]
    texts += ["".join(rng.choice(" abcdeé中▁ßあ1.<") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(v.encoder.encode(text), np.int32).tolist() == own.encode(text), text


def test_unigram_models_keep_the_best_path():
    v = pieces.Vocabulary({"ab": (-9.0, 0), "a": (-1.0, 1), "b": (-1.0, 2), "▁": (-1.0, 3)}, None, 9, ["ab", "a", "b", "▁"])
    assert np.frombuffer(v.encoder.encode("ab"), np.int32).tolist() == [3, 1, 2]


def test_the_streaming_window_of_a_bpe_model(spark):
    """Whole texts without the help of word boundaries: same ids, and no more places held than a few pieces are long."""
    v, own = pieces.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = " ".join(r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect())
    for check in (8, 64):
        window = pieces.MergeWindow(v)
        assert window.run(pieces.SPACE + text.replace(" ", pieces.SPACE), check) == own.encode(text)
        assert window.widest <= check + 3 * v.longest
