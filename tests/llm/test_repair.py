import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popweave.llm import queries, repair as r

SCHEMA = "conv_id long, turn long, role string, text string, k string, audit int"
GRAMMAR = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(letters):
    """(cost, audit) by trying edits forwards; all strings compared whole."""
    follow = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = {(0, 0): (0, "")}
    for i in range(len(letters) + 1):
        for _ in range(3):
            for q in range(4):
                if (i, q) in best:
                    for role, to in follow[q].items():
                        if role != "s":
                            c, a = best[i, q]
                            best[i, to] = min(best.get((i, to), (10**9, "")), (c + 5, a + "I"))
        if i < len(letters):
            x = letters[i]
            for q in range(4):
                if (i, q) in best:
                    c, a = best[i, q]
                    options = [(c + 2, a + "D", q)]
                    if x != "d":
                        more = 5 if x.isupper() else 0
                        for role, to in follow[q].items():
                            if role == x.lower():
                                options.append((c + more, a + "K", to))
                            if role != "s":
                                options.append((c + 1 + more, a + "R", to))
                    for cost, audit, to in options:
                        best[i + 1, to] = min(best.get((i + 1, to), (10**9, "")), (cost, audit))
    return min(best[len(letters), q] for q in (0, 3) if (len(letters), q) in best)


def brute(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        seen, letters, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for *_, role, text in turns:
            visible, fault = text.strip(BLANKS), None
            if not visible:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif visible[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            sound = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters.append("d" if fault in ("blank", "duplicate") else sound.upper() if fault else sound)
        cost, audit = cheapest(letters)
        lines, initials, at = [], "", 0
        for edit in audit:
            free = "a" if initials.endswith("u") else "u"
            role, text = ("", "") if edit == "I" else turns[at][3:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[free]
                initials += role[:1]
                lines.append(f"{role}:{text}")
        assert GRAMMAR.fullmatch(initials) and at == len(turns)
        known = [t[1] for t in turns if t[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[3][:1] + b[3][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    got = r.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    both = got.conversations.join(r.repaired_digests(got.turns), "k", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    return sorted((tuple(x) for x in both.collect()), key=str)


def conversations(seed, n):
    g = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for i in range(g.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            role = g.choice(["user", "assistant", ["user", "assistant"][i % 2], ["user", "assistant"][i % 2], "system", "tool", "", None, "Ü"])
            text = g.choice(["fine.", "ok! \t", "why?\x0b", "cut off", "", " \n", None, "Ünï.", f"own {c} {i}.", f"own {c} {i}."])
            rows.append((c, g.choice([i, i, i, i + 2, None]), role, text, "x", 0))
    return rows + [(900, i, ["user", "assistant"][i % 3 % 2], f"text {i}" + "." * (i % 5), "x", 0) for i in range(60)]


def test_against_brute_force(spark, paths):
    rows = conversations(1, 120)
    assert found(spark, rows) == brute(rows)


def test_short_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(r, "CHUNK", 3)
    rows = conversations(2, 60)
    assert found(spark, rows) == brute(rows)


def test_many_equal_conversations(spark, paths):
    rows = [(c, i, "user", "same.", None, None) for c in range(1500) for i in range(2)]
    got = found(spark, rows)
    assert got == brute(rows) and {x[7] for x in got} == {"DD"}


def test_empty_table(spark):
    got = r.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert got.conversations.count() == 0 and got.turns.count() == 0 and r.repaired_digests(got.turns).count() == 0


def test_automata_begin_anew(monkeypatch):
    g = random.Random(5)
    chunks = ["".join(g.choice("suaxSUAXd") for _ in range(g.choice([1, 4, 9]))) for _ in range(30)]
    for most in (1, 5, 1 << 19):
        monkeypatch.setattr(r, "MOST_NODES", most)
        batch = pa.RecordBatch.from_arrays([pa.array(["k"] * 30), pa.array(range(29, -1, -1)), pa.array(chunks[::-1])], names=["k", "chunk", "sig"])
        back = pa.Table.from_batches(r._backwards(iter([batch]))).sort_by("chunk").combine_chunks().to_batches()
        parts = pa.Table.from_batches(r._forwards(iter(back))).to_pylist()
        assert (parts[0]["cost"], "".join(p["audit"] for p in parts)) == cheapest("".join(chunks))
        whole = pa.Table.from_batches(r._solve(iter([pa.RecordBatch.from_arrays([pa.array(chunks)], names=["sig"])]))).to_pylist()
        assert [(x["cost"], x["audit"]) for x in whole] == [cheapest(c) for c in chunks]


def test_equal_ends_are_one_node():
    automaton = r.Automaton()
    automaton.head("suauad")
    before = len(automaton.cost)
    automaton.head("xuauad")
    assert len(automaton.cost) == before + 1


@pytest.mark.parametrize("letters", ["", "s", "u", "a", "ua", "sua", "au", "ss", "dd", "UA", "X", "xa", "uau", "sSuaAU"])
def test_small_signatures(letters):
    a = r.Automaton()
    head = a.head(letters)
    assert (a.cost[head][0], a.walk(head, 0, len(letters))[0]) == cheapest(letters)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (0, 1, None)] + [(None, 3, None, None)]
    got = queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
