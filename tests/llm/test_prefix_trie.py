"""The prefix trie against dictionaries of whole prefixes, with small blocks and buckets so that every level is used."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from restartlab.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, points bigint, k1 string, depth int"


def brute(rows, lend):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    built = dict(own)
    if lend:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            base = c - (c % 100 if c >= 0 else -(-c % 100))
            built[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(set), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].add(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for k in members:
        own_saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += not children[k]
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def found(trie):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in trie.collect())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-5, 45), *range(100, 130), 205, 999, 2_000_000_000_001]:
        turns = rng.choice([1, 2, 3, 4, 5, 8, 9, 13])
        shared = rng.random() < 0.6
        for t in range(turns):
            text = f"common {t}" if shared and t < 9 and rng.random() < 0.9 else rng.choice(["a", "bb", "", None, "ünï", f"own {c}"])
            rows.append((c, t if rng.random() < 0.97 else None, ["user", "assistant", None][t % 3], text, 1, "x", 2))
    rows += [(7, t, "user", f"long {t % 3}", 1, "x", 2) for t in range(100, 240)]  # one long conversation
    rows += [(8, t, "user", f"long {t % 3}", 1, "x", 2) for t in range(100, 190)]
    rows += [(300 + i, t, "user", f"copy {t}", 1, "x", 2) for i in range(60) for t in range(6)]  # many copies
    rows += [(11, 3, "user", "tie", 1, "x", 2)] * 3 + [(None, 1, "user", "nobody", 1, "x", 2)] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,lend", [(1, 4, True), (2, 3, False), (3, 1, True)])
def test_trie_equals_dictionaries(spark, monkeypatch, seed, block, lend):
    for name, value in (("TURNS", 4), ("SUPER", 3), ("IDS", 8)):
        monkeypatch.setattr(pt, name, value)
    rows = conversations(seed)
    # turns with one number are ordered by digest, so equal numbers get equal texts here
    rows = [(c, t, "user" if t is None else r, "none" if t is None else x, *rest) for c, t, r, x, *rest in rows]
    rows = [row if row[:2] != (11, 3) else (11, 3, "user", "tie", *row[4:]) for row in rows]
    got = found(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), pt.borrowed(F.col("conv_id")) if lend else None, block))
    assert got == brute(rows, lend)


def test_empty_table_and_turnless_conversations(spark):
    lend = pt.borrowed(F.col("conv_id"))
    assert found(pt.prefix_trie(spark.createDataFrame([], SCHEMA), lend)) == []
    alone = [c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1][:4]  # no conversation 100, and fewer turns than they give up
    rows = [(c, 0, "user", "gone", 1, "", 0) for c in alone]
    got = found(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), lend))
    assert got == brute(rows, True) and len(got) == 1 and got[0][3] == 4
