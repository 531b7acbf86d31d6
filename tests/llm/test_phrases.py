import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import phrases


def brute(rows, longest=3, least=10, inside=50, top=2000):
    """All contiguous phrases in one dictionary; whole numbers throughout."""
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    by = {}
    for (lang, p), a in found.items():
        if (lang, p) in longer and 100 * longer[lang, p] >= inside * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in by.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n=900):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["The", "the", "é", "Ünd", " x", "l'a", "日本"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", "?! "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", None, "de"])))
    return rows + [("New York City", "en")] * 40 + [("of the of the of the", "en")] * 30 + [("la " * 400, "fr"), (None, "en"), ("", None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, f long").withColumn("word", F.lit("x")).repartition(6)


@pytest.mark.parametrize("listed", [phrases.LISTED, 60, 0])
def test_against_brute_force(spark, listed):
    """However many words have their counts listed."""
    rows = made(1)
    assert got(phrases.collocations(frame(spark, rows), listed=listed)) == brute(rows)


@pytest.mark.parametrize(("longest", "least", "inside", "top"), [(2, 5, 50, 30), (5, 8, 80, 2000)])
def test_other_lengths(spark, longest, least, inside, top):
    rows = made(2)
    assert got(phrases.collocations(frame(spark, rows), longest=longest, least=least, inside=inside, top=top)) == brute(rows, longest, least, inside, top)


def test_awkward_rows(awkward, nothing):
    assert got(phrases.collocations(awkward, least=1)) == brute([(r["text"], r["lang"]) for r in awkward.collect()], least=1)
    assert phrases.collocations(nothing).count() == 0


def test_each_occurrence_is_in_one_fragment():
    """A phrase is owned by its rarest word; fragments of a run of one word cover every pair and triple once."""
    entry = np.zeros(9, np.int64)
    rows, times = phrases._fragments(np.zeros(9, np.int64), entry, np.zeros(1, np.int64), np.ones(1, bool), 3)
    pairs = sum(t * (r[1] >= 0) + t * (r[3] >= 0) for r, t in zip(rows, times))
    triples = sum(t * ((r[0] >= 0) + (r[1] >= 0 and r[3] >= 0) + (r[4] >= 0)) for r, t in zip(rows, times))
    assert (pairs, triples) == (8, 7)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases.xxhash, "xxh64_intdigest", lambda x, seed: 7)
    langs, words = pa.array(["a", "a", "b"]), pa.array(["y", "x", "x"])
    rank, _ = phrases._ranks(langs, words, np.empty(0, np.int64), np.empty(0, np.int64))
    other, _ = phrases._ranks(langs.take(pa.array([2, 1, 0])), words.take(pa.array([2, 1, 0])), np.empty(0, np.int64), np.empty(0, np.int64))
    assert rank.tolist() == other.tolist()[::-1] == [1, 0, 2]


def test_counts_beyond_sixty_four_bits(spark):
    """The square of a count of 10^12, a million times: 10^30."""
    a, left, right = 10**12 - 7, 10**13 + 1, 10**12
    score = spark.range(1).selectExpr(f"(cast(1000000 as decimal(7,0)) * cast({a}L as decimal(14,0)) * cast({a}L as decimal(14,0))) div (cast({left}L as decimal(14,0)) * cast({right}L as decimal(14,0))) as s").first()["s"]
    assert score == 1000000 * a * a // (left * right)
