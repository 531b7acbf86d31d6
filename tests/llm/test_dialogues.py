import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sluice.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string, path long"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    return {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + own[c][zlib.crc32(str(c).encode()) % 4 :] for c in own}


def brute(rows):
    """The trie in dictionaries: every prefix with its members."""
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        gain = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += node not in children
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def made(seed, n=160, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "bot", None]), rng.choice(["", None, "a", "b  c", "d\te f"])))
    rows += [(41, t, "user", f"turn {t % 7}") for t in range(hot)]
    rows += [rows[0]] * 2 + [(None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("moduli", [dialogues.MODULI, (3, 5), (101, 103)])
def test_against_dictionaries(spark, moduli):
    """With small moduli most prefixes of one depth collide and are split."""
    rows = made(1)
    assert got(dialogues.trie(*dialogues.forked(frame(spark, rows)), moduli=moduli)) == brute(rows)


@pytest.mark.parametrize("moduli", [dialogues.MODULI, (13, 17)])
def test_a_conversation_of_most_turns_over_many_tasks(spark, moduli):
    rows = made(2, 60, hot=700)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, everyone = dialogues.forked(frame(spark, rows, 9))
        found = dialogues.prefixes(turns, moduli)
        spread = found.where("conv_id = 41").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if moduli == dialogues.MODULI else [1] * 6
        assert sum(n > 0 for n in spread) > 5
        assert got(dialogues.trie(turns, everyone, moduli)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_blocks_of_one_representative(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "BLOCK", 3)
    rows = made(3, 80, hot=40)
    assert got(dialogues.forked_trie(frame(spark, rows))) == brute(rows)


def test_no_conversations_and_turnless_ones(spark):
    assert dialogues.forked_trie(frame(spark, []).where("false")).count() == 0
    lone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, 1, "user", "hi")]
    assert got(dialogues.forked_trie(frame(spark, rows))) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_parts_with_left_out_turns(spark):
    rows = [(1, 0, 0, 1, "u", "a"), (1, 1, 2, 1, "u", "x"), (1, 1, 2, 2, "u", "y"), (1, 1, 2, 3, "u", "b"), (2, 0, 1, 5, "u", "z"), (2, 1, 0, 1, "u", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, part int, skip int, turn long, role string, text string")
    out = {(r["conv_id"], r["depth"]): r["text"] for r in dialogues.prefixes(turns).collect()}
    assert out == {(1, 1): "a", (1, 2): "b", (2, 1): "a"}
