import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.llm import prefix_trie as p
from popweave.llm.double_array import DoubleArray

SCHEMA = "conv_id long, turn long, role string, text string, key string, weight int"


def turn_hash(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Nodes of the rebuilt conversations, by plain prefixes."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), turn_hash(role or "", text or ""), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for conv, path in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = own.get(conv - int(np.fmod(conv, 20)), [])
        built = tuple(base[:h] + path[h:])
        for d in range(len(built) + 1):
            nodes.setdefault(built[:d], []).append((conv, len(built) == d))
    out = []
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in nodes}
    for k, members in nodes.items():
        below = [x for x in nodes if x[:len(k)] == k]
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        out.append((
            min(members)[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(members), sum(len(x) == len(k) + 1 for x in below),
            sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below) for x in below),
            sum((len(nodes[x]) - 1) * words[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    turns = p.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    got = p.prefix_nodes(*p.shared_beginnings(turns, F.col("conv") - F.col("conv") % 20, taken, 3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(seed, n):
    r = random.Random(seed)
    pool = ["yes", "no  way\tout", "", None, "a b c", "\x0b", "Ünï ß", "x " * 500]
    rows = []
    for c in r.sample(range(-60, 200), n):
        for i in range(r.choice([1, 1, 2, 3, 5, 9])):
            turn = r.choice([i, i, i, None, 0])
            rows.append((c, turn, r.choice(["user", "assistant", None, ""]), r.choice(pool), "k", 1))
    rows += rows[:5] + [(None, 0, "user", "lost", "k", 1)]
    rows += [(1000 + c, i, "user", f"same {i}", "k", 1) for c in range(30) for i in range(4)]
    rows += [(2000, i, "user", str(i % 3), "k", 1) for i in range(40)]  # the donor of the next one
    rows += [(2005, i, "user", str(i % 3), "k", 1) for i in range(38)]
    return rows


def test_against_brute_force(spark, paths):
    rows = conversations(1, 60)
    assert found(spark, rows) == brute(rows)


def test_short_segments_and_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(p, "SEGMENT", 3)
    monkeypatch.setattr(p, "SHARD_TURNS", 7)
    monkeypatch.setattr(p, "LIST_CHARS", 4)
    rows = conversations(2, 50)
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_conversations_without_turns(spark):
    assert found(spark, []) == []
    # 3 takes as many turns as its crc32 says from 0, which is absent
    bare = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(bare, 0, "user", "gone", None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows)[0][:6] == (bare, 0, None, 1, 0, 1)


def test_many_copies_are_one_path(spark, paths):
    rows = [(c, i, "user", f"turn {i} of all", None, None) for c in range(0, 40000, 20) for i in range(3)]
    got = found(spark, rows)
    assert [r[:7] for r in got] == [(0, d, None if d == 0 else 0, 2000, int(d < 3), 1, 1999 * 4 * min(3, 4 - d)) for d in range(4)]


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    r = np.random.default_rng(seed)
    paths = [tuple(r.integers(1, r.choice([3, 50, 5000]), r.integers(0, 7))) for _ in range(400)]
    trie, states = DoubleArray(), {(): 0}
    for depth in range(1, 8):
        new = sorted({x[:depth] for x in paths if len(x) >= depth})
        parents, symbols = np.array([states[x[:-1]] for x in new], dtype=np.int64), np.array([x[-1] for x in new], dtype=np.int64)
        trie.add(parents, symbols)
        at = trie.step(parents, symbols)
        assert (at > 0).all()
        states |= dict(zip(new, at.tolist()))
        assert (trie.step(parents, symbols + 10000) == -1).all()
    assert len(set(states.values())) == len(states)
    for x, s in states.items():
        if x:
            assert trie.check[s] == states[x[:-1]] and trie.base[states[x[:-1]]] + x[-1] == s
