import random

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import pieces, wordpieces
from sluice.llm.registry import PIECES


def best_path(text, vocabulary):
    """Viterbi over the whole text at once."""
    best, back = {0: 0.0}, {}
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + vocabulary.longest) + 1):
            hit = vocabulary.scores.get(text[i:j]) or ((vocabulary.least, -1) if j == i + 1 else None)
            if hit and best[i] + hit[0] > best.get(j, -np.inf):
                best[j], back[j] = best[i] + hit[0], (i, hit[1])
    out, j = [], len(text)
    while j:
        i, piece = back[j]
        out.append([piece] if piece >= 0 else [vocabulary.bytes_at[b] for b in text[i:j].encode()])
        j = i
    return [x for part in reversed(out) for x in part]


def test_streaming_equals_whole_search(spark):
    v = pieces.load(PIECES)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500").limit(15).collect()] + ["  two  spaces ", "日本語 und 😀", "a\n\nb", "x" * 700]
    for text in texts:
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        window = pieces.Window(v)
        want = best_path(marked, v)
        assert window.run(marked, 16) == want == np.frombuffer(pieces.Encoder(v).encode(text), np.int32).tolist()
        assert pieces.decode(np.array(want), v) == text and pieces.Decoder(v).decode(np.array(want)) == text.encode()


def test_the_window_stays_bounded():
    v = pieces.load(PIECES)
    rng = random.Random(5)
    window = pieces.Window(v)
    window.run("".join(rng.choice("abcdefghij ") for _ in range(20000)).replace(" ", pieces.SPACE), 32)
    assert window.widest < 400


def test_model_without_word_boundaries():
    # Divided at the space the text scores -4; across it -3 plus the score of the piece that holds it.
    for across, want in ((-1.5, [4, 0, 4, 0, 9]), (-0.5, [4, 1, 3, 2, 9])):
        v = pieces.Vocabulary({"ab": (-1.0, 0), "a": (-1.0, 1), "b": (-1.0, 2), "b▁a": (across, 3), "▁": (-1.0, 4)}, None, 9, ["ab", "a", "b", "b▁a", "▁"])
        assert not v.splits and np.frombuffer(pieces.Encoder(v).encode("ab ab?"), np.int32).tolist() == want


def test_awkward_texts_round_trip(awkward, nothing):
    v = pieces.load(PIECES)
    out = pieces.encode(awkward, v).collect()
    assert len(out) == 9 and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in out)
    assert {r["doc_id"]: r["n_ids"] for r in out}[2] == 0
    assert pieces.encode(nothing, v).count() == 0


def greedy(word, initial, continuing):
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (continuing if i else initial)), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(7)
    for _ in range(150):
        made = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(rng.randint(2, 16))]
        initial, continuing = set(made[::2]), set(made[1::2])
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))).encode() for _ in range(80)]
        assert wordpieces.Automaton(initial, continuing).count(words).tolist() == [greedy(w, initial, continuing) for w in words]


def test_moves_that_pop_more_than_255_pieces():
    initial, continuing = {b"a"}, {b"a", b"c", b"a" * 500 + b"b"}
    words = [b"a" * 302 + b"c", b"a" * 402, b"a" * 900 + b"b", b"a" * 499 + b"b" + b"a" * 700]
    assert wordpieces.Automaton(initial, continuing).count(words).tolist() == [greedy(w, initial, continuing) for w in words]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces_ = wordpieces.vocabulary(PIECES)
    initial, continuing = pieces_.initial, pieces_.continuing
    table = {t: i for i, t in enumerate(["[UNK]", *(w.decode() for w in initial), *("##" + w.decode() for w in continuing)])}
    library = Tokenizer(models.WordPiece(table, unk_token="[UNK]", max_input_chars_per_word=10**9))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    got = {r["doc_id"]: r["n_tokens"] for r in wordpieces.token_counts(docs, pieces_).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == len(library.encode(r["text"], add_special_tokens=False).ids)


def test_counts_of_awkward_texts(awkward, nothing):
    vocabulary = wordpieces.vocabulary(PIECES)
    out = {r["doc_id"]: r for r in wordpieces.token_counts(awkward, vocabulary).collect()}
    assert out[2]["n_tokens"] == out[3]["n_tokens"] == 0 and out[4]["n_words"] == 80000
    assert wordpieces.token_counts(nothing, vocabulary).count() == 0 and wordpieces.token_counts(awkward.where(F.lit(True)), vocabulary).count() == 9
