import random

import numpy as np
import pytest

from edge import edge_docs, empty_docs, prose
from popweave.llm import line_dedup as d
from popweave.llm.text import lower_ascii

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows):
    """(id, lines, dropped, text) of every (id, text)."""
    order = lambda i: (i is None, i)
    owners = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            owners.setdefault(lower_ascii(line.strip(BLANKS)), set()).add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [lower_ascii(x.strip(BLANKS)) for x in lines]
        gone = [len(k) >= 10 and min(owners[k]) < order(i) for k in keys]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), None if text is None else kept))
    return sorted(out, key=str)


def found(docs):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in d.drop_repeated_lines(docs).collect()), key=str)


def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def texts(seed, n):
    r = random.Random(seed)
    pool = [prose(r.choice([1, 2, 3, 9]), 500 + i) for i in range(40)]
    pool += ["漢字漢字漢字漢字漢", "漢字漢字漢字漢字漢字", "Ünïcödé ß", "\x1c nine chars\x1c", " wide space "]

    def line():
        x = r.choice(pool)
        x = x.upper() if r.random() < 0.3 else x
        return r.choice(["", " ", "\t\r", "\x0b"]) + x + r.choice(["", " ", "\r", "\x0c \t"])
    return ["\n".join(line() for _ in range(r.choice([0, 1, 2, 5, 30]))) + r.choice(["", "\n", "\n\n"]) for _ in range(n)]


def test_against_brute_force(spark):
    docs = edge_docs(spark, [*texts(1, 60), "\n".join(texts(2, 300))]).repartition(7)
    assert found(docs) == brute(given(docs))
    assert d.drop_repeated_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_rows_of_one_id_are_one_document(spark):
    rows = [(2, "a shared line here"), (2, "A shared line here "), (None, "a shared line here\nonly unnamed rows"), (None, "only unnamed rows"),
            (7, "a line of one id\na line of one id"), (7, "a line of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(docs)
    assert got == brute(rows)
    assert sum(r[2] for r in got) == 1


def test_saturated_filters_and_tiny_batches_change_nothing(spark, monkeypatch):
    docs = edge_docs(spark, texts(3, 80)).repartition(5)
    want = brute(given(docs))
    monkeypatch.setattr(d, "LEAST_BITS", 64)
    monkeypatch.setattr(d, "MOST_BITS", 64)
    monkeypatch.setattr(d, "HELD", 3)
    assert found(docs) == want


def test_a_line_in_every_document(spark, paths):
    rows = [(i, f"the very same line\nown line number {i}") for i in range(3000)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    assert sum(r[2] for r in got) == 2999 and got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert d.drop_repeated_lines(empty_docs(spark)).count() == 0
    docs = spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, n_lines int")
    assert [tuple(r) for r in d.drop_repeated_lines(docs).collect()] == [(1, "x", 1, 0)]


@pytest.mark.parametrize("n", [5, d.BLOCK // 32 - 1, d.BLOCK // 32, d.BLOCK])
def test_places_of_a_block(n):
    at = np.sort(np.random.default_rng(1).choice(d.BLOCK, n, replace=False))
    assert (d.unpack(d.pack(at)) == at).all()


def test_filter_holds_every_line_of_two_tasks(spark):
    lines = [f"line number {i} of many" for i in range(5000)]
    docs = spark.createDataFrame([("\n".join(lines[i:i + 100]),) for i in range(0, 5000, 50)], "text string").repartition(9)
    bits = d.filter_bits(10000)
    table = np.zeros(bits, dtype=bool)
    for r in d.twice_seen(docs, bits).collect():
        table[d.unpack(r["twice"]) + r["block"] * d.BLOCK] = True
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    _, at, hashes = d.Lines(data, np.array([0, len(data)])).counted()
    inner = table[d.places(hashes, bits)].all(axis=1)[50:]
    assert inner.all() and table.mean() < 0.75
    fresh = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert table[d.places(fresh, bits)].all(axis=1).mean() < 0.1
